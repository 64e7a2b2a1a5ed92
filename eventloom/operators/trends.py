"""Trending terms, suggestions and their overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import normalize_query
from eventloom.operators.search import ts

MAX_SUGGESTIONS, MAX_TRENDING = 8, 6


def trending_terms(log: DataFrame, now: str, term: str = "query_norm", min_ratio: float = 2.0, min_count: int = 10) -> DataFrame:
    """(term, searches_24h, baseline_7d, trend_ratio, score) in one pass: the day against the week's mean, that day included."""
    since = lambda hours: (F.col("created_at") >= ts(now) - F.expr(f"INTERVAL '{hours}' HOUR")) & (F.col("created_at") < ts(now))
    counts = log.where(since(168)).groupBy(normalize_query(F.col(term)).alias("term")).agg(F.count_if(since(24)).alias("searches_24h"), (F.count("*") / 7).alias("baseline_7d")).where("searches_24h > 0")
    ratio = (F.col("searches_24h") + 1) / (F.col("baseline_7d") + 1)
    out = counts.withColumn("trend_ratio", ratio).withColumn("score", F.col("searches_24h") * F.col("trend_ratio"))
    return out.where((F.col("trend_ratio") >= min_ratio) & (F.col("searches_24h") >= min_count))


def active(now: str, city: str | None = None) -> Column:
    """Overrides in force: switched on, inside their window, for the city or for all."""
    t = ts(now)
    inside = F.col("is_active") & (F.col("starts_at").isNull() | (F.col("starts_at") <= t)) & (F.col("ends_at").isNull() | (F.col("ends_at") >= t))
    return inside if city is None else inside & (F.col("city").isNull() | (F.col("city") == city))


def apply_overrides(items: DataFrame, overrides: DataFrame, group: str) -> DataFrame:
    """(group, list, position, text, badge, score, source): overrides by falling priority on each group's two lists.

    items: group, list (suggestion or trending), position, text, badge, score. overrides: group, term, action, boost,
    replacement, label, priority. The actions act on one another's results, so each group is folded in order; its lists are
    a page of suggestions and its overrides an editor's, which is what bounds it."""

    def norm(x):
        return " ".join((x or "").lower().split())[:120]

    def fold(key, left, right):
        import pandas as pd

        lists = {name: left[left["list"] == name].sort_values("position").to_dict("records") for name in ("suggestion", "trending")}
        for rows in lists.values():
            for r in rows:
                r["source"] = "log"
        for o in right.sort_values("priority", ascending=False, kind="stable").to_dict("records"):
            term, trend = norm(o["term"]), lists["trending"]
            same = lambda r, term=term: norm(r["text"]) == term
            own = lambda badge, base, kind, o=o: {"text": o["term"], "badge": o["label"] or badge, "score": float(base + o["priority"]), "source": kind}
            if o["action"] == "HIDE":
                lists = {n: [r for r in rows if not same(r)] for n, rows in lists.items()}
            elif o["action"] == "REPLACE" and o["replacement"]:
                lists = {n: [r | {"text": o["replacement"], "source": "override_replace"} if same(r) else r for r in rows] for n, rows in lists.items()}
            elif o["action"] == "PUSH" and not any(map(same, trend)):
                trend.append(own("🔥", 999, "override_push"))
            elif o["action"] == "PIN":
                lists["trending"] = [own("📌", 9999, "override_pin")] + [r for r in trend if not same(r)]
            elif o["action"] == "BOOST":
                boost = o["boost"] if o["boost"] == o["boost"] and o["boost"] is not None else 0
                lists["trending"] = [r | {"score": r["score"] + boost, "source": "override_boost"} if same(r) else r for r in trend]
        out = []
        for name, most in (("suggestion", MAX_SUGGESTIONS), ("trending", MAX_TRENDING)):
            unique = list({norm(r["text"]): r for r in reversed(lists[name])}.values())[::-1]
            unique.sort(key=lambda r: next(i for i, x in enumerate(lists[name]) if x is r))
            if name == "trending":
                unique.sort(key=lambda r: -r["score"])
            out += [(key[0], name, i, r["text"], r.get("badge"), r["score"], r["source"]) for i, r in enumerate(unique[:most])]
        return pd.DataFrame(out, columns=["g", "list", "position", "text", "badge", "score", "source"])

    kind = items.schema[group].dataType.simpleString()
    return items.groupBy(group).cogroup(overrides.groupBy(group)).applyInPandas(fold, f"g {kind}, list string, position bigint, text string, badge string, score double, source string").withColumnRenamed("g", group)
