"""Small column functions on event fields: links, images, labels, buckets, cron times."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.text import is_street

# Parts of calendar pages' links, labels, age buckets.
AGGREGATORS = ["karlsruhe.de", "kalender", "veranstaltungskalender", "eventkalender", "events.karlsruhe"]
BUCKETS = ["0_2", "3_5", "6_9", "10_12", "13_15"]
REASON_KEYS = ["family_fit", "relevance", "stressfree", "quality", "fun"]
SOURCE_LINKS = [("rss", "application/(?:rss|atom)\\+xml"), ("ics", "text/calendar")]


def normal_url(url: Column) -> Column:
    """With a scheme; null for empty ones and over 500 characters."""
    bare = F.trim(url)
    full = F.when(bare.startswith("http://") | bare.startswith("https://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    return F.when((url != "") & (F.length(full) <= 500), full)


def is_aggregator(url: Column) -> Column:
    """Whether a link leads to a calendar page instead of a booking page."""
    low = F.lower(url)
    return F.coalesce(functools.reduce(lambda a, b: a | b, [low.contains(p) for p in AGGREGATORS]), F.lit(False))


def booking_url(*urls: Column) -> Column:
    """The first link, in order of preference, that isn't empty or a calendar page's."""
    return F.coalesce(*[F.when((F.trim(u) != "") & ~is_aggregator(u), F.trim(u)) for u in urls])


def images(urls: Column) -> Column:
    """At most ten http(s) links of at most 500 characters."""
    web = F.filter(urls, lambda u: u.startswith("http://") | u.startswith("https://"))
    return F.slice(F.transform(web, lambda u: F.substring(u, 1, 500)), 1, 10)


def split_venue(address: Column, venue: Column) -> Column:
    """struct(venue, address): text that is no street is a venue; of 'venue, street, town' the first part is."""
    parts = F.split(address, ",")
    first = F.trim(parts[0])
    rest = F.trim(F.array_join(F.transform(F.slice(parts, 2, 100), lambda p: p), ", "))
    made = lambda v, a: F.struct(v.alias("venue"), a.alias("address"))
    none = F.lit(None).cast("string")
    has = F.coalesce(venue != "", F.lit(False))
    return F.when(address.isNull(), made(venue, none)).when(~is_street(address), F.when(has, made(venue, address)).otherwise(made(address, none))).when(~has & (F.size(parts) >= 2) & ~is_street(first), made(first, rest)).otherwise(made(venue, address))


def safe_int(text: Column) -> Column:
    """A number cut to a whole one, null for anything else."""
    return text.try_cast("double").cast("bigint")


def is_slug(text: Column) -> Column:
    """Lower-case words and digits joined by single hyphens."""
    return text.rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def price_label(kind: Column, low: Column, high: Column | None = None) -> Column:
    """A price for readers; zero and unknown prices are not told."""
    cents = lambda c: F.floor(c * 100)
    say = lambda c: F.concat(F.floor(cents(c) / 100).cast("string"), F.lit("."), F.lpad((cents(c) % 100).cast("string"), 2, "0"))
    known = lambda c: F.coalesce(c != 0, F.lit(False))
    out = F.when(kind == "free", "Kostenlos")
    if high is not None:
        out = out.when(known(low) & known(high), F.concat(say(low), F.lit("€ - "), say(high), F.lit("€")))
    return out.when(known(low), F.concat(F.lit("ab "), say(low), F.lit("€"))).otherwise("Unbekannt")


def place_label(indoor: Column, outdoor: Column) -> Column:
    """Where an event is, for readers."""
    return F.when(indoor & outdoor, "Indoor & Outdoor").when(indoor, "Indoor").when(outdoor, "Outdoor").otherwise("Unbekannt")


def age_label(low: Column, high: Column) -> Column:
    """Ages for readers; an age of zero is not told."""
    known = lambda c: F.coalesce(c != 0, F.lit(False))
    return F.when(known(low) & known(high), F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" Jahre"))).when(known(low), F.concat(F.lit("ab "), low.cast("string"), F.lit(" Jahren"))).otherwise("Nicht angegeben")


def age_buckets(given: Column) -> Column:
    """A map of all age buckets, 50 where the given map has none."""
    return F.map_concat(F.map_filter(F.create_map(*[x for b in BUCKETS for x in (F.lit(b), F.lit(50))]), lambda k, v: ~F.map_contains_key(given, k)), given)


def filled_keys(values: Column, most: int = 15) -> Column:
    """The first keys whose value is neither null nor empty."""
    return F.slice(F.map_keys(F.map_filter(values, lambda k, v: v.isNotNull() & (v != ""))), 1, most)


def drop_nulls(values: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(values, lambda k, v: v.isNotNull())


def stable_hash(values: Column) -> Column:
    """A digest of a map that doesn't depend on the order of its keys."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"), F.coalesce(e["value"], F.lit("null")).alias("v"))))), ","), 256)


def why_recommended(reasons: Column) -> Column:
    """The first reason that isn't blank, in a fixed order of kinds."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(reasons, F.lit(k))), F.lit("")) for k in REASON_KEYS])


def age_bucket(now: Column, then: Column) -> Column:
    """How long ago, in whole minutes, hours or days."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))


def progress_times(started: Column, now: Column, done: Column, total: Column, heartbeat_s: Column) -> dict[str, Column]:
    """Seconds since the start and until the end (three an event, before one is done), and how alive the worker looks."""
    elapsed = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(started), F.lit(0))
    left = F.greatest(total - done, F.lit(0))
    eta = F.when(done > 0, F.floor(elapsed / done * left)).otherwise(left * 3)
    return {"elapsed_s": elapsed, "eta_s": eta.cast("bigint"), "alive": F.when(heartbeat_s < 120, "alive").when(heartbeat_s < 300, "slow").otherwise("stale")}


def geocode_confidence(kind: Column) -> Column:
    """How sure a geocoder's hit is, by what it hit."""
    return F.when(kind.isNull(), 0.5).when(kind.isin("house", "building", "residential"), 0.95).when(kind.isin("street", "road", "highway"), 0.75).when(kind.isin("suburb", "neighbourhood", "city"), 0.5).otherwise(0.6)


def importance_confidence(importance: Column) -> Column:
    """How sure a hit is by its importance alone; none and zero count as a half."""
    return F.least(F.lit(1.0), F.coalesce(F.nullif(importance, F.lit(0.0)), F.lit(0.5)))


#: How kinds of sources are called, and what is said of a source that isn't of its kind.
KIND_LABELS = {"rss": "RSS/Atom-Feed", "ics": "ICS-Kalender", "html": "HTML-Seite", "scraper": "HTML (Scraper)", "unknown": "unbekanntes Format"}
IS_PAGE = ("Die URL liefert eine HTML-Seite, kein ", ". Bitte die richtige Feed-URL verwenden (z. B. .ics oder RSS-Link).")
IS_CALENDAR = "Die URL liefert einen ICS-Kalender, aber die Quelle ist als RSS eingetragen. Quelle auf „ICS“ umstellen."
IS_FEED = "Die URL liefert einen RSS/Atom-Feed, aber die Quelle ist als ICS eingetragen. Quelle auf „RSS“ umstellen."
IS_UNKNOWN = ("Der Inhaltstyp konnte nicht erkannt werden. Erwartet: ", ".")
IS_OTHER = ("Die URL liefert ", ", die Quelle ist als ", " eingetragen. Bitte anpassen.")


def type_mismatch(detected: Column, configured: Column) -> Column:
    """What to tell an editor whose source isn't of the kind that was set; empty where it fits."""
    got, want = F.lower(F.coalesce(detected, F.lit(""))), F.lower(F.coalesce(configured, F.lit("")))
    label = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in KIND_LABELS.items()], c)
    around = lambda text, *inner: F.concat(*[x for k, t in enumerate(text) for x in ((F.lit(t), inner[k]) if k < len(inner) else (F.lit(t),))])
    return (
        F.when((got == "html") & want.isin("rss", "ics"), around(IS_PAGE, label(want))).when((got == "ics") & (want == "rss"), IS_CALENDAR).when((got == "rss") & (want == "ics"), IS_FEED)
        .when((got == "html") & (want == "scraper"), "").when(got == "unknown", around(IS_UNKNOWN, label(want))).when(got != want, around(IS_OTHER, label(got), label(want))).otherwise("")
    )


def source_kind(html: Column) -> Column:
    """struct(kind, url): the best machine-readable form that a page names: feed, calendar, JSON-LD events, none."""
    made = lambda kind, url: F.struct(F.lit(kind).alias("kind"), url.alias("url"))
    tries = []
    for kind, mime in SOURCE_LINKS:
        tag = F.regexp_extract(html, rf"(?is)(<link\b(?=[^>]*\brel=[\"']alternate[\"'])(?=[^>]*\btype=[\"']{mime}[\"'])[^>]*>)", 1)
        url = F.nullif(F.regexp_extract(tag, r"(?is)\bhref=[\"']([^\"']+)", 1), F.lit(""))
        tries.append((url.isNotNull(), made(kind, url)))
    none = F.lit(None).cast("string")
    tries.append((html.rlike(r"(?is)<script[^>]*application/ld\+json[^>]*>.*?\"@type\"\s*:\s*\"[A-Za-z]*(?:Event|Festival)\""), made("json-ld", none)))
    out = None
    for condition, value in tries:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(made("html", none))


def sitemap_xml(pages: list[tuple[str, str, str]], base: str, day: str) -> str:
    """The site's own sitemap as a SQL-ready text: (path, change frequency, priority) of each static page."""
    body = "".join(f"<url><loc>{base}{path}</loc><lastmod>{day}</lastmod><changefreq>{often}</changefreq><priority>{rank}</priority></url>" for path, often, rank in pages)
    return f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{body}</urlset>'


def cron_field(text: str, low: int, high: int) -> list[int]:
    """The values that a field of a cron line names; raises on anything else."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = int(span)
            b = high if step else a
        if not low <= a <= b <= high:
            raise ValueError(text)
        out |= set(range(a, b + 1, int(step or 1)))
    return sorted(out)


def cron_next(line: str | None, now):
    """The next minute after `now` that a five-field cron line fires; six hours on for a missing or broken one."""
    from datetime import timedelta

    later = now + timedelta(hours=6)
    try:
        minute, hour, day, month, week = (line or "").split()
        fields = [cron_field(minute, 0, 59), cron_field(hour, 0, 23), cron_field(day, 1, 31), cron_field(month, 1, 12), [d % 7 for d in cron_field(week, 0, 7)]]
    except ValueError:
        return later
    at = now.replace(second=0, microsecond=0) + timedelta(minutes=1)
    either = day != "*" and week != "*"
    for _ in range(366 * 5):
        weekday = (at.weekday() + 1) % 7
        fits = (at.day in fields[2] or weekday in fields[4]) if either else (at.day in fields[2] and weekday in fields[4])
        if at.month in fields[3] and fits:
            for h in fields[1]:
                for m in fields[0]:
                    if (h, m) >= (at.hour, at.minute):
                        return at.replace(hour=h, minute=m)
        at = (at + timedelta(days=1)).replace(hour=0, minute=0)
    return later
