"""The whole normaliser against a plain version of its columns."""

import re
import warnings
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from eventloom.functions import text as T
from eventloom.operators import normalise

reader = pytest.importorskip("dateutil.parser")
NOW, BERLIN = datetime(2026, 3, 29, 9, tzinfo=UTC), ZoneInfo("Europe/Berlin")

TEXTS = [
    "Eintritt frei, 11 bis 12 Uhr, jeden montag im museum", "ab 17 Uhr, parkhaus vorhanden, in englisch", "Tickets 12,50 € Erwachsene: 15€ Kinder: 8€, 3-8 jahre", "auf spendenbasis, spende erbeten, ab 6 jahren", "22 bis 1 Uhr, ausverkauft", "", None,
    "begrenzte plätze, a.b@haus.de, Tel. 0721/1334401", "nachmittags, keine parkplätze, " + "lang. " * 150, "<p>bis 16 Uhr</p>  wald", "bis 12 Jahre",
]
SCHEMA = """id int, title string, description string, summary string, start_datetime string, dtstart string, end_datetime string, location string, venue_name string, city string, postal_code string, price_type string, price string, price_max string,
    price_details string, age_min string, age_max string, is_indoor boolean, language string, capacity string, recurrence_rule string, has_parking boolean, url string, email string, phone string, image_urls array<string>, extra int"""


def cases():
    pick = lambda k, *values: values[k % len(values)]
    for k in range(330):
        yield {
            "id": k, "title": pick(k, "Fest <b>x</b>  im Park", "", None, "y" * 240, "Kurs 5 Euro"), "description": TEXTS[k % 11], "summary": pick(k, "Kurz", None), "start_datetime": pick(k, "14.02.2026", "", "2026-07-01 18:15", "2026-07-01T00:00Z", None, "kein Datum", "29.03.2026"),
            "dtstart": pick(k, None, "20260501T100000", None), "end_datetime": pick(k, None, "15.02.2026", "15.02.2026 20:00"), "location": pick(k, None, "Prinz-Max-Palais, Karlstr. 10, 76133 Karlsruhe", "Siehe  Beschreibung", "Tollhaus", " Weg 3, 76131 Ost-Stadt ", ""),
            "venue_name": pick(k, None, None, "Saal", ""), "city": pick(k, None, "Ettlingen", None), "postal_code": pick(k, None, None, "", "76275"), "price_type": pick(k, None, "free", "teuer", "paid", "donation"), "price": pick(k, None, "9.5", None, "viel"), "price_max": pick(k, None, "20"),
            "price_details": pick(k, None, None, None, "{}"), "age_min": pick(k, None, "3.9", None), "age_max": pick(k, None, "10"), "is_indoor": pick(k, None, None, False), "language": pick(k, None, "Englisch", "Klingonisch"), "capacity": pick(k, "120", None, "viele"), "recurrence_rule": pick(k, None, None, "R"),
            "has_parking": pick(k, None, None, None, False), "url": pick(k, None, "www.haus.de/a", "https://kalender.de/1", "x" * 500), "email": pick(k, None, " a@b.de "), "phone": pick(k, None, "Tel. 0721 / 12-3", "keine", None, None), "image_urls": pick(k, None, [], ["ftp://x", "https://i"], [f"http://{n}" for n in range(12)]), "extra": k,
        }


def instant(text):
    """(as written, distance from UTC) of a date, or null."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            got = reader.parse(text, default=datetime(2026, 3, 29))
    except Exception:
        return None
    off = got.utcoffset() if got.tzinfo else got.replace(tzinfo=BERLIN, fold=1).utcoffset()
    return got.replace(tzinfo=None), off


def plain_times(r, clock):
    start, end = instant(r["start_datetime"] or r["dtstart"]), instant(r["end_datetime"])
    local = NOW.astimezone(BERLIN)
    base = start or (local.replace(tzinfo=None), local.utcoffset())
    on = lambda day, minutes: (day[0].replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(minutes=minutes), day[1])
    first, last = clock
    bare = lambda t: (t[0].hour, t[0].minute) == (0, 0)
    new_start = on(base, first) if first is not None and (start is None or bare(start)) else start
    new_end = end if last is None else on(base, last) if end is None else on(end, last % 1440) if bare(end) else end
    return tuple(t and t[0] - t[1] for t in (new_start, new_end))


#: (start, end) in minutes of the day that the texts above tell.
CLOCKS = [(660, 720), (1020, None), None, None, (1320, 1500), None, None, None, (840, None), (None, 960), None]


def test_against_plain(spark):
    rows = list(cases())
    got = {x.id: x for x in normalise.normalised(spark.createDataFrame(rows, SCHEMA), "2026-03-29 09:00:00").collect()}
    assert len(got) == len(rows)
    squeeze = lambda t: " ".join(t.split())
    for r in rows:
        x, said = got[r["id"]], r["description"] or r["summary"] or ""
        title = squeeze(re.sub("<[^>]+>", "", r["title"] or ""))
        assert x.title == (title[:197] + "..." if len(title) > 200 else title)
        clean = squeeze(re.sub("<[^>]+>", " ", said))
        assert x.description_long == (clean if len(clean) > 500 else None) and (x.description_short or "") in (clean, x.description_short if len(clean) > 500 else clean)
        # the phrases of the list tell these times; only texts of a whole row of digits are left to time_extract's own test
        clock = CLOCKS[r["id"] % 11] or (None, None)
        if r["id"] % 11 not in (2, 7):
            assert (x.start_datetime, x.end_datetime) == plain_times(r, clock), r
        low = f"{r['title'] or ''} {r['description'] or ''}".lower()
        kind, least = r["price_type"] if r["price_type"] in normalise.PRICE_TYPES else "unknown", 9.5 if r["price"] == "9.5" else None
        if kind == "unknown":
            kind = "free" if any(w in low for w in T.FREE + T.DONATION) else "paid" if least is not None else "unknown"
        m = re.search(r"(\d+(?:[,.]\d{2})?)\s*(?:€|euro|eur)", low)
        if least is None and kind != "free" and m:
            kind, least = "paid", float(m[1].replace(",", "."))
        assert (x.price_type, x.price_min, x.price_max) == (kind, 0.0 if kind == "free" and least is None else least, 20.0 if r["price_max"] else None), r
        low_age, high_age = 3 if r["age_min"] else None, 10 if r["age_max"] else None
        if None in (low_age, high_age):
            low_age, high_age = {2: (3, 8), 3: (6, 99), 10: (0, 12)}.get(r["id"] % 11, (low_age, high_age))
        assert (x.age_min, x.age_max) == (low_age, high_age), r
        told = squeeze(r["location"] or "")
        address, venue = (None if told in ("", "Siehe Beschreibung") else told), r["venue_name"] or None
        place = re.search(r"(\d{5})\s+([A-ZÄÖÜa-zäöüß][A-ZÄÖÜa-zäöüß\-\s]+)", address or "")
        city, postal = r["city"], r["postal_code"] or None
        assert (x.city, x.postal_code) == (city or (place and place[2].strip()), postal or (place and place[1])), r
        if not venue and address:
            venue, address = {"Tollhaus": ("Tollhaus", None), "Prinz-Max-Palais, Karlstr. 10, 76133 Karlsruhe": ("Prinz-Max-Palais", "Karlstr. 10,  76133 Karlsruhe")}.get(address, (venue, address))
        assert (x.venue_name, x.location_address) == (venue, address), r
        assert x.language == {"Englisch": "en", "Klingonisch": "Klingonisch"}.get(r["language"], "en" if "in englisch" in said else "de")
        assert (x.capacity, x.has_parking if r["has_parking"] is not None else None) == (120 if r["capacity"] == "120" else None, r["has_parking"])
        assert x.booking_url == ("https://www.haus.de/a" if r["url"] and r["url"].startswith("www") else None)
        assert x.contact_email == ("a@b.de" if r["email"] else "a.b@haus.de" if r["id"] % 11 == 7 else None)
        assert x.contact_phone == {"Tel. 0721 / 12-3": "0721  12-3", "keine": None}.get(r["phone"], "0721/1334401" if r["id"] % 11 == 7 else None)
        assert x.image_urls == [u for u in r["image_urls"] or [] if u.startswith("http")][:10]
        priced = not r["price_details"] and r["id"] % 11 == 2
        assert (x.price_adult, x.price_child) == ((15.0, 8.0) if priced else (None, None)) and (x.price_currency == "EUR") == (not r["price_details"] and r["id"] % 11 in (2, 3))
        if r["is_indoor"] is not None:
            assert x.is_indoor is False and x.is_outdoor is None


def test_few_columns(spark):
    """A table of ids alone, and an empty one."""
    ids = spark.createDataFrame([(1,), (1,)], "id int")
    rows = normalise.normalised(ids, "2026-03-29 09:00:00").collect()
    assert len(rows) == 2 and rows[0].title == "" and rows[0].start_datetime is None and rows[0].price_type == "unknown" and rows[0].image_urls == []
