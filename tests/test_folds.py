"""Order-dependent folds against plain versions and goldens: overrides, candidates, the tip of the day."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from eventloom import catalog
from eventloom.operators import merge, scoring, search, trends
from eventloom.plans.scoring import near
from eventloom.plans.views import CATALOG_NOW, view

ITEMS = [("k", "trending", 0, "fasching", None, 50.0), ("k", "trending", 1, "flohmarkt", None, 40.0), ("k", "suggestion", 0, "flohmarkt", None, 40.0)]
SHAPE = "city string, list string, position bigint, text string, badge string, score double"
RULES = "city string, action string, term string, boost int, replacement string, label string, priority int"


@pytest.mark.parametrize(
    "rule,first,badge,score",
    [
        (("PIN", "Flohmarkt", None, None, None, 1), "Flohmarkt", "📌", 10000.0), (("BOOST", "flohmarkt", 20, None, None, 1), "flohmarkt", None, 60.0), (("HIDE", "fasching", None, None, None, 1), "flohmarkt", None, 40.0),
        (("REPLACE", "fasching", None, "karneval", None, 1), "karneval", None, 50.0), (("PUSH", "zoo", None, None, "neu", 2), "zoo", "neu", 1001.0), (("PUSH", "fasching", None, None, None, 2), "fasching", None, 50.0),
    ],
)
def test_override_goldens(spark, rule, first, badge, score):
    out = trends.apply_overrides(spark.createDataFrame(ITEMS, SHAPE), spark.createDataFrame([("k", *rule)], RULES), "city")
    rows = sorted((r for r in out.collect() if r["list"] == "trending"), key=lambda r: r["position"])
    assert (rows[0]["text"], rows[0]["badge"], rows[0]["score"]) == (first, badge, score)


def test_merge_candidates(spark, sf_dir):
    rank = lambda s: merge.PRIORITY.get(s, max(merge.PRIORITY.values()))
    kind = lambda k: ["rss", "manual", "api", "scraper"][k % 4]
    now = dt.datetime.fromisoformat(CATALOG_NOW)
    news = {}
    for r in view(spark, sf_dir, "raw_item").orderBy("id").collect():
        news.setdefault(r["event_id"], []).append((r["position"], kind(r["source_id"]), r["source_url"] if r["position"] != 3 else None, r["raw_hash"]))
    want = set()
    for e in view(spark, sf_dir, "catalog").collect():
        if e["id"] not in news:
            continue
        for k, field in ((2, "address"), (3, "venue_name")):
            value, source, at, updated, reason = e[field], kind(e["id"]) if field == "address" else None, e["created_at"] if field == "address" else None, False, "null_value"
            for x in sorted(news[e["id"]], key=lambda n: tuple((v is not None, v) for v in n)):
                new, a, b = x[k], rank(source or "scraper"), rank(x[1])
                take, reason = (
                    (False, "locked") if e["id"] % 19 == 0 and field == "address" else (False, "null_value") if new is None else (True, "new_field") if value is None else (True, "source_priority_lower") if b < a
                    else (value != new, "unchanged") if a == b else (True, "stale_data") if at is not None and at < now - dt.timedelta(days=180) else (False, "source_priority_lower")
                )
                if take:
                    value, source, at, updated = new, x[1], now, True
            want.add((e["id"], field, value, source, updated, reason))
    found = {tuple(r) for r in catalog.queries()["merge_candidates"](spark, sf_dir).select("id", "field", "value", "source", "updated", "reason").collect()}
    assert found == want


def test_daily_tip(spark, sf_dir):
    slugs = {}
    for r in view(spark, sf_dir, "event_category").collect():
        slugs.setdefault(r["event_id"], []).append(r["slug"])
    shown = near(spark, sf_dir).where(search.displayable(CATALOG_NOW) & search.allowed_rating() & F.col("district").isNotNull()).withColumn("total", scoring.tip_scores(CATALOG_NOW)["total"])
    groups = {}
    for r in shown.collect():
        groups.setdefault(r["district"], []).append(r)
    want = set()
    for district, rows in groups.items():
        soon = sorted(rows, key=lambda r: (r["start_datetime"], r["id"]))[:50]
        best = sorted(soon, key=lambda r: (-r["total"], r["id"]))
        taken = []
        counts = {}

        def keys(r):
            return [("c", s) for s in slugs.get(r["id"], [])] + [("p", r["venue_name"])]

        def put(r):
            taken.append(r["id"])
            for k in keys(r):
                counts[k] = counts.get(k, 0) + 1

        cheap = next((r for r in best if r["price_type"] == "free" or (r["price_min"] is not None and not math.isnan(r["price_min"]) and r["price_min"] <= 5)), None)
        if cheap:
            put(cheap)
        for r in best:
            if len(taken) < 10 and r["id"] not in taken and all(counts.get(k, 0) < 2 for k in keys(r)):
                put(r)
        for r in best:
            if len(taken) < 10 and r["id"] not in taken:
                put(r)
        want |= {(district, i, k + 1) for k, i in enumerate(taken)}
    assert {tuple(r) for r in catalog.queries()["daily_tip"](spark, sf_dir).select("district", "id", "rank").collect()} == want
