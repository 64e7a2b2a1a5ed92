"""Queries that SQL can't express, against plain versions."""

import re

import pytest
from pyspark.sql import functions as F

from eventloom import catalog
from eventloom.functions import text as T
from eventloom.plans import planning
from eventloom.plans.scoring import near
from eventloom.plans.views import CATALOG_NOW, view
from eventloom.sources import dom


def run(spark, name, d):
    return [r.asDict() for r in catalog.queries()[name](spark, d).collect()]


def descriptions(spark, d):
    return {r["id"]: r["description"] for r in view(spark, d, "event_text").select("id", "description").collect()}


def test_pii(spark, sf_dir):
    import hashlib

    texts = descriptions(spark, sf_dir)
    for r in run(spark, "pii_redact", sf_dir):
        text = texts[r["id"]]
        clean = text
        for name, pattern in T.PII:
            clean = re.sub(pattern, f"[{name}_REDACTED]", clean, flags=re.I)
        streets = re.sub(T.STREET, "[STREET_DE_REDACTED]", clean, flags=re.I)
        found = any(re.search(p, text, re.I) for p in [T.POSTAL, T.STREET, *[p for _, p in T.PII]])
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r["redacted"], r["aggressive"], r["has_pii"]) == (digest(clean), digest(streets), found)


def times(text):
    """Start and end in minutes, by the patterns in order."""
    t = text.lower()
    clock, ok = r"(\d{1,2})(?:[:\.]\s*(\d{2}))?", lambda h, m: 6 <= h <= 23 and m <= 59
    m = re.search(rf"(?:(?:von|zwischen)\s+)?{clock}\s*(?:uhr|h)?\s*(?:bis|und|[-–])\s*{clock}\s*(?:uhr|h)?", t)
    if m:
        a, b, c, e = (int(g or 0) for g in m.groups())
        if ok(a, b) and c <= 23 and e <= 59:
            start, end = a * 60 + b, c * 60 + e
            return start, end + (1440 if end <= start else 0)
    for pattern, is_end in ((rf"(?:um|gegen)\s*{clock}\s*(?:uhr|h)", False), (rf"\bab\s+{clock}\s*(?:uhr|h)\b", False), (rf"\bbis\s+{clock}\s*(?:uhr|h)\b", True), (rf"\b{clock}\s*uhr\b", False)):
        m = re.search(pattern, t)
        if m and ok(int(m[1]), int(m[2] or 0)):
            at = int(m[1]) * 60 + int(m[2] or 0)
            return (None, at) if is_end else (at, None)
    m = re.search(r"\b(vormittags?|nachmittags?|abends?|morgens)\b", t)
    return ({"vormittag": 600, "nachmittag": 840, "abend": 1140, "morgen": 540}[m[1].rstrip("s")], None) if m else (None, None)


def test_times(spark, sf_dir):
    texts = descriptions(spark, sf_dir)
    for r in run(spark, "time_extract", sf_dir):
        assert (r["start_min"], r["end_min"]) == times(texts[r["id"]])


GOLDEN = [
    ("14. Februar 2026, 19 Uhr", "2026-02-14 19:00:00", None), ("5. März 2026, 19:30 Uhr", "2026-03-05 19:30:00", None), ("20. März 2026, 10 bis 14 Uhr", "2026-03-20 10:00:00", "2026-03-20 14:00:00"),
    ("15. April 2026, 19:00–21:30 Uhr", "2026-04-15 19:00:00", "2026-04-15 21:30:00"), ("30. Mai 2026, 22 bis 2 Uhr", "2026-05-30 22:00:00", "2026-05-31 02:00:00"), ("25. Dezember 2026", "2026-12-25 00:00:00", None),
    ("Beginn: 10. Januar 2026, 19.30 Uhr", "2026-01-10 19:30:00", None),
]


def test_golden_dates(spark):
    from eventloom.functions.dates import with_datetime

    d = spark.createDataFrame([(t,) for t, _, _ in GOLDEN] + [(None,), ("",)], "text string")
    for extended in (False, True):
        found = {r["text"]: (r["starts"], r["ends"]) for r in with_datetime(d, "text", extended).collect()}
        for t, a, b in GOLDEN:
            assert tuple(x and str(x) for x in found[t]) == (a, b)
        assert found[None] == found[""] == (None, None)


def test_normalizer_equals_its_parts(spark, sf_dir):
    whole = {r["id"]: r for r in run(spark, "normalize_event", sf_dir)}
    for name, columns in (("time_extract", ("start_min", "end_min")), ("contact_extract", ("email", "phone"))):
        for r in run(spark, name, sf_dir):
            assert all(r[c] == whole[r["id"]][c] for c in columns)


def groups_of(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


@pytest.fixture(scope="module")
def ranked(spark, sf_dir):
    """All events with distances, scores and categories, plainly."""
    slugs = groups_of([r.asDict() for r in view(spark, sf_dir, "event_category").collect()], "event_id")
    rows = [r.asDict() for r in near(spark, sf_dir).where(catalog_displayable()).withColumn("plan", F.round(planning.scoring.plan_score(planning.BUDGET, planning.AGES), 6)).collect()]
    return [r | {"slugs": sorted(s["slug"] for s in slugs.get(r["id"], []))} for r in rows]


def catalog_displayable():
    from eventloom.operators import search

    return search.displayable(CATALOG_NOW)


def test_plan_select(spark, sf_dir, ranked):
    score = lambda r: 0.6 * ((r["family_fit"] or 0) + (r["stressfree"] or 0)) - 4 * (r["distance_km"] or 100.0)
    want = set()
    for provider, rows in groups_of(ranked, "provider_id").items():
        rows = sorted(rows, key=lambda r: (-score(r), r["id"]))[:20]
        taken, seen = [], set()
        if len(rows) <= 3:
            taken = [r["id"] for r in rows]
        else:
            for r in rows:
                if len(taken) < 3 and (len(taken) < 2 or set(r["slugs"]) - seen):
                    taken.append(r["id"])
                    seen |= set(r["slugs"])
            taken += [r["id"] for r in rows if r["id"] not in taken][: 3 - len(taken)]
        want |= {(provider, i, k + 1) for k, i in enumerate(taken)}
    assert {(r["provider_id"], r["id"], r["rank"]) for r in run(spark, "plan_select", sf_dir)} == want


def test_plan_optimise(spark, sf_dir, ranked):
    want = set()
    for provider, rows in groups_of(ranked, "provider_id").items():
        rows = sorted(rows, key=lambda r: (-r["plan"], r["id"]))[:30]
        main, seen, spent = [], set(), 0.0
        for r in rows:
            cost = 0 if r["price_type"] == "free" else (r["price_min"] or 0) * 4
            new = not r["slugs"] or set(r["slugs"]) - seen
            if len(main) < 3 and spent + cost <= planning.BUDGET and (len(main) >= 2 or new or len(rows) <= len(main) + 3):
                main.append(r["id"])
                seen |= set(r["slugs"])
                spent += cost
        indoor = [r["id"] for r in rows if r["is_indoor"] and r["id"] not in main][:3]
        want |= {(provider, i, "main", k + 1) for k, i in enumerate(main)} | {(provider, i, "plan_b", k + 1) for k, i in enumerate(indoor)}
    assert {(r["provider_id"], r["id"], r["slot"], r["rank"]) for r in run(spark, "plan_optimise", sf_dir)} == want


def test_structured_events(spark, sf_dir):
    found = {(r["page_id"], r["title"], r["source"]): r for r in run(spark, "structured_events", sf_dir)}
    pages = [r["page_id"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").collect()]
    for p in pages:
        if p % 3 == 0:
            assert (found[p, f"Page {p}", "json-ld"]["start"], found[p, f"Page {p}", "json-ld"]["place"]) == ("2026-02-14T19:00", "Hall")
        if p % 3 == 1:
            r = found[p, f"Micro {p}", "microdata"]
            assert (r["start"], r["place"], r["price"]) == ("2026-03-01", "Saal", "7")


def test_visible_text(spark, sf_dir):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in run(spark, "visible_text", sf_dir):
        want = "\n".join(dom.parse(html[r["page_id"]]).strings(dom.hidden))
        assert r["text"] == re.sub(r"\n{3,}", "\n\n", want)[:12000]


def test_selectors():
    root = dom.parse('<div id=a class="x y"><p class=y>one</p><section><p>two <b>three</b></p><a href="/q" data-k="v1">link</a></section></div><p>four')
    texts = lambda css: [n.text(" ") for n in dom.select(root, css)]
    assert texts("#a p") == ["one", "two three"] and texts("p.y, section b") == ["one", "three"] and texts("div.x.y section p") == ["two three"]
    assert texts('[data-k^="v"]') == ["link"] and texts('a[href*="q"]') == ["link"] and texts("section div p") == [] and texts("*.y")[1:] == ["one"]
    assert dom.suggest(root, "three") == "b" and dom.suggest(root, "one") == "p.y" and dom.suggest(root, "nothing") is None
    assert dom.list_rows(dom.parse("<div class=event><h2>T</h2></div><div class=event>no</div>"), "") == [{"title": "T"}]


def test_cron():
    from datetime import datetime

    from eventloom.functions.fields import cron_next

    now = datetime(2024, 2, 28, 23, 59, 30)
    cases = {"*/10 * * * *": "2024-02-29 00:00", "0 0 29 2 *": "2024-02-29 00:00", "15 10 * * 0": "2024-03-03 10:15", "0 12 1 * 1": "2024-03-01 12:00", "5-7 4 * * *": "2024-02-29 04:05", "61 * * * *": "2024-02-29 05:59", "": "2024-02-29 05:59"}
    for line, at in cases.items():
        assert cron_next(line, now).strftime("%Y-%m-%d %H:%M") == at
