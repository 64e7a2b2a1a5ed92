"""Completeness, publishing decisions, recommendation scores, badges and data-quality checks, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from eventloom.operators.search import RESTRICTED, ts
from eventloom.session import ship_package

#: Publishing thresholds.
CONFIDENCE_PUBLISH, CONFIDENCE_REJECT, FIT_REJECT, FIT_PUBLISH, COMPLETE = 0.75, 0.80, 30, 50, 50


def yes(condition: Column) -> Column:
    """A condition with unknown as false."""
    return F.coalesce(condition, F.lit(False))


def points(*rules: tuple[Column, int]) -> Column:
    """The sum of the points whose condition holds."""
    out = F.lit(0)
    for condition, n in rules:
        out = out + F.when(yes(condition), n).otherwise(0)
    return out


def listed(*rules: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(yes(c), F.lit(n)) for c, n in rules]))


def completeness() -> Column:
    """Weighted completeness out of 100."""
    has = lambda c: F.col(c).isNotNull()
    long, short = yes(F.length("description_long") >= 50), yes(F.length("description_short") >= 20)
    placed, there = yes(F.length("address") >= 10), has("lat") & has("lng")
    known = yes(F.col("price_type") != "unknown")
    return points(
        (F.length("title") >= 5, 10), (long & short, 15), ((long | short) & ~(long & short), 10), (has("start_datetime"), 15), (has("start_datetime") & has("end_datetime"), 5),
        (placed & there, 20), ((placed | there) & ~(placed & there), 12), (known, 7), (known & ((F.col("price_type") == "free") | ((F.col("price_type") == "paid") & has("price_min"))), 3),
        (has("age_min") | has("age_max"), 10), (has("booking_url"), 6), (has("contact_email"), 4), (F.col("n_categories") > 0, 5),
    )


def missing_fields() -> Column:
    """Names of the fields an editor should fill."""
    no = lambda c: F.col(c).isNull()
    return listed((no("start_datetime"), "start_datetime"), (no("address"), "location_address"), (no("price_min") & no("price_max"), "price"), (no("age_min") & no("age_max"), "age_range"), (no("description_short") | (F.col("description_short") == ""), "description_short"))


def ratio_completeness(required: list[str], optional: list[str], df: DataFrame) -> Column:
    """Half for required fields, half for optional ones, cut to a whole number. Empty texts are missing, and so are zero and
    false among the optional fields."""
    kind = dict(df.dtypes)

    def filled(c: str, strict: bool) -> Column:
        present = F.col(c).isNotNull()
        if kind[c] == "string":
            present = present & (F.col(c) != "")
        elif strict:
            present = present & (F.col(c) if kind[c] == "boolean" else F.col(c) != 0 if not kind[c].startswith("timestamp") else F.lit(True))
        return yes(present).cast("int")

    share = lambda names, strict: sum((filled(c, strict) for c in names), F.lit(0)) / len(names) * 50
    return F.floor(share(required, False) + share(optional, True)).cast("bigint")


def initial_status(score: Column) -> Column:
    """The status of a new event by completeness."""
    return F.when(score < 50, "incomplete").when(score < 70, "pending_review").otherwise("pending_ai")


def ai_status() -> Column:
    """The status after scoring, with the import's thresholds."""
    fit = F.col("family_fit")
    return F.when(F.coalesce("completeness", F.lit(0)) < 50, "incomplete").when(yes(fit < 30), "rejected").when(yes((F.col("confidence") >= 0.8) & (fit >= 50)), "published").otherwise("pending_review")


def publish_decision() -> Column:
    """struct(status, flags): restricted ratings, completeness, then scores; any flag means a review."""
    fit, sure = F.col("family_fit"), F.col("confidence")
    no_url, no_scores = F.col("booking_url").isNull(), fit.isNull() | sure.isNull()
    low, border = yes(sure < CONFIDENCE_PUBLISH), yes((fit >= FIT_REJECT) & (fit < FIT_PUBLISH))
    result = lambda status, flags: F.struct(F.lit(status).alias("status"), flags.alias("flags"))
    word = lambda *w: F.array(*map(F.lit, w))
    flags = listed((no_url, "no_booking_url"), (low, "low_confidence"), (border, "borderline_family_fit"))
    return (
        F.when(yes(F.col("age_rating").isin(*RESTRICTED)), result("rejected", word("age_restricted")))
        .when(F.coalesce("completeness", F.lit(0)) < COMPLETE, result("incomplete", word("low_completeness")))
        .when(no_scores, result("pending_review", listed((no_url, "no_booking_url"), (F.lit(True), "no_ai_scores"))))
        .when((fit < FIT_REJECT) & (sure >= CONFIDENCE_REJECT), result("rejected", word("low_family_fit", "high_confidence_reject")))
        .when(F.size(flags) > 0, result("pending_review", flags))
        .when((fit >= FIT_PUBLISH) & (sure >= CONFIDENCE_PUBLISH), result("published", word("auto_published")))
        .otherwise(result("pending_review", F.array().cast("array<string>")))
    )


def can_publish(now: str) -> Column:
    """The first reason against publishing, null if there is none."""
    return (
        F.when(F.col("title").isNull() | (F.length("title") < 3), "title")
        .when(F.col("start_datetime").isNull(), "start")
        .when(F.col("start_datetime") < ts(now), "past")
        .when(F.col("address").isNull() & (F.col("lat").isNull() | F.col("lng").isNull()), "location")
        .when(F.col("is_cancelled"), "cancelled")
        .when(yes(F.col("age_rating").isin(*RESTRICTED)), "age_rating")
    )


def tip_scores(now: str) -> dict[str, Column]:
    """The daily tip's components and their weighted total."""
    share = lambda c, d=0: F.coalesce(F.col(c), F.lit(d)) / 100
    match = F.when(F.col("event_id").isNull(), 0.5).otherwise(share("family_fit") * 0.3 + share("stressfree") * 0.25 + share("relevance") * 0.25 + share("quality") * 0.1 + share("fun", 50) * 0.1)
    popularity = F.least(F.lit(1.0), F.log10(F.col("save_count") * 5 + F.col("view_count") + 2) / 3)
    days = F.timestamp_diff("HOUR", F.col("created_at"), ts(now)) / 24
    fresh = F.when(days <= 0, 1.0).when(days >= 30, 0.2).otherwise(1 - days / 40)
    km = F.col("distance_km")
    near = F.when(km.isNull(), 0.5).when(km <= 2, 1.0).when(km <= 5, 0.85).when(km <= 10, 0.7).when(km <= 20, 0.5).otherwise(F.greatest(F.lit(0.2), 0.5 - (km - 20) / 100))
    return {"match": match, "popularity": popularity, "freshness": fresh, "distance": near, "total": popularity * 0.2 + match * 0.4 + fresh * 0.15 + near * 0.25}


def badges(now: str, largest: Column) -> Column:
    """The first three badges; trending depends on the largest save count of all rows in question, a one-row aggregate."""
    hours = F.timestamp_diff("SECOND", ts(now), F.col("start_datetime")) / 3600
    most = F.greatest(F.lit(1), largest)
    seen = F.col("save_count") + F.col("view_count")
    trending = yes((seen >= 0.5 * most) & (seen > 2))
    found = listed(
        ((hours >= 0) & (hours < 2), "LAST_CHANCE"), ((F.col("price_type") == "free") | (F.col("price_min") <= 5), "BUDGET_PICK"), (F.col("is_indoor"), "WEATHER_SAFE"), (trending, "TRENDING"),
        ((yes(F.col("family_fit") >= 70) | yes(F.col("stressfree") >= 70)) & (seen < 5) & ~trending, "GEHEIMTIPP"), ((F.col("match") >= 0.7) & (F.col("family_fit") >= 70), "MATCH"),
    )
    return F.slice(found, 1, 3)


def validation_checks(now: str) -> Column:
    """Ids of the failed checks, all_ok if none."""
    no = lambda c: F.col(c).isNull()
    found = listed(
        (no("title"), "title_missing"), (no("start_datetime"), "date_missing"), (no("address"), "address_missing"), (no("description_short") | (F.length("description_short") < 30), "desc_short"),
        (no("price_min") & no("price_max"), "price_missing"), (F.lit(True), "image_missing"), (F.col("start_datetime") < ts(now), "date_past"), (F.col("age_min") > F.col("age_max"), "age_invalid"),
        (F.col("price_min") > F.col("price_max"), "price_invalid"), (~no("address") & (no("lat") | no("lng")), "geocode_missing"),
    )
    return F.when(F.size(found) == 0, F.array(F.lit("all_ok"))).otherwise(found)


def review_reason() -> Column:
    """Why a rejected event was rejected."""
    return F.when(F.col("status") != "rejected", None).when(yes(F.col("family_fit") < 30), "AI_REJECTED").otherwise("MANUAL_REJECTED")


def picked(scored: DataFrame, group: str, columns: list[str], pick: Callable[[list[dict]], list[tuple]], made: str) -> DataFrame:
    """(group, made...) for what pick takes of each group's rows (dicts, best first: by total, then the smallest id). Groups travel as
    one row each, many to an Arrow batch; callers bound a group's rows before."""
    import pyarrow as pa

    ship_package(scored.sparkSession)
    schema = f"{group} {scored.schema[group].dataType.simpleString()}, {made}"
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows = sorted(row["rows"], key=lambda r: r["id"])
                rows.sort(key=lambda r: _falling(r["total"]))
                out += [(row[group], *one) for one in pick(rows)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    each = scored.groupBy(group).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return each.mapInArrow(run, schema)


def _falling(total: float | None) -> tuple[bool, float]:
    """Sort key: the largest first, what is missing last."""
    missing = total is None or total != total
    return missing, 0.0 if missing else -total


def varied(scored: DataFrame, group: str, target: int = 3) -> DataFrame:
    """(group, id, rank): the first two by score always, then only events with a category that is new, then the best left over;
    all where there are no more than `target`. Callers bound a group's candidates before."""

    def pick(rows):
        taken, seen = [], set()
        for r in rows if len(rows) > target else []:
            if len(taken) < target and (len(taken) < 2 or any(c not in seen for c in r["slugs"])):
                taken.append(r["id"])
                seen.update(r["slugs"])
        for r in rows:
            if len(taken) < target and r["id"] not in taken:
                taken.append(r["id"])
        return [(i, k + 1) for k, i in enumerate(taken)]

    return picked(scored, group, ["id", "total", "slugs"], pick, "id bigint, rank bigint")


def optimise(scored: DataFrame, group: str, budget: float, heads: int, children: int) -> DataFrame:
    """(group, id, slot, rank): up to three events that the budget allows, the first two with a new category where there is
    choice, and up to three other indoor events as plan B. Rows: group, id, total, price_type, price_min, is_indoor, slugs."""

    def pick(rows):
        main, seen, spent = [], set(), 0.0
        for r in rows:
            if len(main) >= 3:
                break
            low = r["price_min"]
            cost = low * heads if r["price_type"] != "free" and low is not None and low == low else 0.0
            if spent + cost > budget:
                continue
            own = set(r["slugs"])
            if len(main) < 2 and own and own <= seen and len(rows) > len(main) + 3:
                continue
            main.append(r["id"])
            seen |= own
            spent += cost
        other = [r["id"] for r in rows if r["id"] not in main and r["is_indoor"]][:3]
        return [(i, "main", k + 1) for k, i in enumerate(main)] + [(i, "plan_b", k + 1) for k, i in enumerate(other)]

    return picked(scored, group, ["id", "total", "price_type", "price_min", "is_indoor", "slugs"], pick, "id bigint, slot string, rank bigint")


def plan_score(budget: float, ages: list[int]) -> Column:
    """An event's score for a family's day: AI scores (50 where they are zero or missing), distance, price, children of its ages."""
    half = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(50))
    base = F.when(F.col("event_id").isNotNull(), half("family_fit") * 0.3 + half("stressfree") * 0.2 + half("quality") * 0.1).otherwise(50.0)
    price = F.when(F.col("price_type") == "free", 15).when(yes((F.col("price_min") != 0) & (F.col("price_min") <= budget / 4)), 10).otherwise(0)
    suits = sum((yes(F.lit(a).between(F.coalesce("age_min", F.lit(0)), F.coalesce("age_max", F.lit(18)))).cast("int") for a in ages), F.lit(0))
    return base - F.coalesce("distance_km", F.lit(10)) * 2 + price + suits * 5


def rerank(scored: DataFrame, group: str, limit: int = 10, per_key: int = 2) -> DataFrame:
    """Greedy diversity inside each group's candidates: a budget pick first, then by score, at most per_key of a category or
    place; free places are filled by score. Callers bound a group's candidates (a top 50) before."""

    def pick(rows):
        taken, categories, places = [], {}, {}

        def fits(r):
            return all(categories.get(c, 0) < per_key for c in r["slugs"]) and places.get(r["place"], 0) < per_key

        def add(r):
            taken.append(r["id"])
            places[r["place"]] = places.get(r["place"], 0) + 1
            for c in r["slugs"]:
                categories[c] = categories.get(c, 0) + 1

        budget = next((r for r in rows if r["price_type"] == "free" or (r["price_min"] == r["price_min"] and r["price_min"] is not None and r["price_min"] <= 5)), None)
        if budget:
            add(budget)
        for strict in (True, False):
            for r in rows:
                if len(taken) < limit and r["id"] not in taken and (fits(r) or not strict):
                    add(r)
        return [(i, k + 1) for k, i in enumerate(taken)]

    return picked(scored, group, ["id", "total", "price_type", "price_min", "slugs", "place"], pick, "id bigint, rank bigint")
