"""Completeness, decisions, recommendation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.operators import geo, scoring, search
from eventloom.plans.searching import HAVERSINE, METRES
from eventloom.plans.views import CATALOG_NOW, ctes, view

NOW = CATALOG_NOW
WITH_COUNTS = ctes("catalog", "scores", "event_category", more="counted AS (SELECT c.*, coalesce(k.n, 0) AS n_categories FROM catalog c LEFT JOIN (SELECT event_id, count(*) AS n FROM event_category GROUP BY event_id) k ON k.event_id = c.id)")


def counted(spark, d):
    k = view(spark, d, "event_category").groupBy("event_id").agg(F.count("*").alias("n"))
    return view(spark, d, "catalog").join(k, F.col("event_id") == F.col("id"), "left").withColumn("n_categories", F.coalesce("n", F.lit(0))).drop("n", "event_id")


def scored(spark, d):
    return view(spark, d, "catalog").join(view(spark, d, "scores"), F.col("id") == F.col("event_id"), "left")


def text(array):
    """An array of names as one text, which both engines compare alike."""
    return F.array_join(array, ",")


SCORE = """CASE WHEN length(title) >= 5 THEN 10 ELSE 0 END + CASE WHEN coalesce(length(description_long) >= 50, false) AND coalesce(length(description_short) >= 20, false) THEN 15 WHEN coalesce(length(description_long) >= 50, false) OR coalesce(length(description_short) >= 20, false) THEN 10 ELSE 0 END
    + CASE WHEN start_datetime IS NOT NULL THEN 15 + CASE WHEN end_datetime IS NOT NULL THEN 5 ELSE 0 END ELSE 0 END + CASE WHEN coalesce(length(address) >= 10, false) AND lat IS NOT NULL THEN 20 WHEN coalesce(length(address) >= 10, false) OR lat IS NOT NULL THEN 12 ELSE 0 END
    + CASE WHEN price_type <> 'unknown' THEN 7 + CASE WHEN price_type = 'free' OR (price_type = 'paid' AND price_min IS NOT NULL) THEN 3 ELSE 0 END ELSE 0 END + CASE WHEN age_min IS NOT NULL OR age_max IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN booking_url IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN contact_email IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN n_categories > 0 THEN 5 ELSE 0 END"""


@register("completeness", WITH_COUNTS + f"SELECT id, s AS score, (s >= 70) AS complete, CASE WHEN s < 50 THEN 'incomplete' WHEN s < 70 THEN 'pending_review' ELSE 'pending_ai' END AS status FROM (SELECT id, {SCORE} AS s FROM counted)")
def completeness(spark, d):
    s = counted(spark, d).select("id", scoring.completeness().alias("score"))
    return s.select("id", "score", (F.col("score") >= 70).alias("complete"), scoring.initial_status(F.col("score")).alias("status"))


@register("missing_fields", ctes("catalog") + "SELECT id, concat_ws(',', CASE WHEN start_datetime IS NULL THEN 'start_datetime' END, CASE WHEN address IS NULL THEN 'location_address' END, CASE WHEN price_min IS NULL AND price_max IS NULL THEN 'price' END, CASE WHEN age_min IS NULL AND age_max IS NULL THEN 'age_range' END, CASE WHEN coalesce(description_short, '') = '' THEN 'description_short' END) AS missing FROM catalog")
def missing_fields(spark, d):
    return view(spark, d, "catalog").select("id", text(scoring.missing_fields()).alias("missing"))


#: Required and optional fields.
REQUIRED = ["title", "start_datetime", "address", "price_type", "booking_url"]
OPTIONAL = ["description_short", "description_long", "end_datetime", "lat", "lng", "age_min", "age_max", "is_indoor", "is_outdoor", "contact_email", "contact_phone", "n_images"]
_FILLED = {"start_datetime": "start_datetime IS NOT NULL", "end_datetime": "end_datetime IS NOT NULL", "is_indoor": "is_indoor", "is_outdoor": "is_outdoor"} | {c: f"{c} <> 0" for c in ("lat", "lng", "age_min", "age_max", "n_images")}
_share = lambda names: "(" + " + ".join(f"CASE WHEN {_FILLED.get(c, c + chr(60) + chr(62) + repr(str()))} THEN 1 ELSE 0 END" for c in names) + f") / {len(names)} * 50"


@register("completeness_ratio", ctes("catalog") + f"SELECT id, CAST(floor({_share(REQUIRED)} + {_share(OPTIONAL)}) AS BIGINT) AS score FROM catalog")
def completeness_ratio(spark, d):
    c = view(spark, d, "catalog")
    return c.select("id", scoring.ratio_completeness(REQUIRED, OPTIONAL, c).alias("score"))


@register("ai_status", ctes("catalog", "scores") + "SELECT id, CASE WHEN coalesce(completeness, 0) < 50 THEN 'incomplete' WHEN family_fit < 30 THEN 'rejected' WHEN confidence >= 0.8 AND family_fit >= 50 THEN 'published' ELSE 'pending_review' END AS ai_status FROM catalog LEFT JOIN scores ON id = event_id")
def ai_status(spark, d):
    return scored(spark, d).select("id", scoring.ai_status().alias("ai_status"))


@register("publish_decision", ctes("catalog", "scores") + """SELECT id, CASE WHEN age_rating IN ('16+', '18+') THEN 'rejected' WHEN coalesce(completeness, 0) < 50 THEN 'incomplete' WHEN family_fit IS NULL OR confidence IS NULL THEN 'pending_review' WHEN family_fit < 30 AND confidence >= 0.8 THEN 'rejected' WHEN booking_url IS NULL OR confidence < 0.75 OR (family_fit >= 30 AND family_fit < 50) THEN 'pending_review' WHEN family_fit >= 50 AND confidence >= 0.75 THEN 'published' ELSE 'pending_review' END AS decision,
    CASE WHEN age_rating IN ('16+', '18+') THEN 'age_restricted' WHEN coalesce(completeness, 0) < 50 THEN 'low_completeness' WHEN family_fit IS NULL OR confidence IS NULL THEN concat_ws(',', CASE WHEN booking_url IS NULL THEN 'no_booking_url' END, 'no_ai_scores') WHEN family_fit < 30 AND confidence >= 0.8 THEN 'low_family_fit,high_confidence_reject'
    WHEN booking_url IS NULL OR confidence < 0.75 OR (family_fit >= 30 AND family_fit < 50) THEN concat_ws(',', CASE WHEN booking_url IS NULL THEN 'no_booking_url' END, CASE WHEN confidence < 0.75 THEN 'low_confidence' END, CASE WHEN family_fit >= 30 AND family_fit < 50 THEN 'borderline_family_fit' END) WHEN family_fit >= 50 AND confidence >= 0.75 THEN 'auto_published' ELSE '' END AS flags FROM catalog LEFT JOIN scores ON id = event_id""")  # fmt: skip
def publish_decision(spark, d):
    return scored(spark, d).withColumn("p", scoring.publish_decision()).select("id", F.col("p.status").alias("decision"), text(F.col("p.flags")).alias("flags"))


@register("can_publish", ctes("catalog") + f"SELECT id, CASE WHEN title IS NULL OR length(title) < 3 THEN 'title' WHEN start_datetime IS NULL THEN 'start' WHEN start_datetime < TIMESTAMP '{NOW}' THEN 'past' WHEN address IS NULL AND lat IS NULL THEN 'location' WHEN is_cancelled THEN 'cancelled' WHEN age_rating IN ('16+', '18+') THEN 'age_rating' END AS reason FROM catalog")
def can_publish(spark, d):
    return view(spark, d, "catalog").select("id", scoring.can_publish(NOW).alias("reason"))


TIPS = ctes("catalog", "scores", more=f"near AS (SELECT c.*, s.*, floor(2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)) / 1000 * 10 + 0.5) / 10 AS km FROM (SELECT *, {HAVERSINE} AS a FROM catalog) c LEFT JOIN scores s ON s.event_id = c.id)")
MATCH = "CASE WHEN event_id IS NULL THEN 0.5 ELSE CAST(family_fit AS DOUBLE) / 100 * 0.3 + CAST(stressfree AS DOUBLE) / 100 * 0.25 + CAST(relevance AS DOUBLE) / 100 * 0.25 + CAST(quality AS DOUBLE) / 100 * 0.1 + CAST(coalesce(fun, 50) AS DOUBLE) / 100 * 0.1 END"
HOURS = f"CAST(date_diff('hour', created_at, TIMESTAMP '{NOW}') AS DOUBLE)"


def near(spark, d):
    m = geo.metres(F.col("lat"), F.col("lng"), 49.0069, 8.4037)
    return scored(spark, d).withColumn("distance_km", geo.js_round(m / 1000, 1))


@register("tip_scores", TIPS + f"""SELECT id, round(m, 6) AS match, round(p, 6) AS popularity, round(f, 6) AS freshness, round(n, 6) AS distance, round(p * 0.2 + m * 0.4 + f * 0.15 + n * 0.25, 6) AS total FROM (SELECT id, CAST({MATCH} AS DOUBLE) AS m, least(1.0, log10(save_count * 5 + view_count + 2) / 3) AS p,
    CASE WHEN {HOURS} / 24 <= 0 THEN 1.0 WHEN {HOURS} / 24 >= 30 THEN 0.2 ELSE 1 - {HOURS} / 24 / 40 END AS f, CAST(CASE WHEN km IS NULL THEN 0.5 WHEN km <= 2 THEN 1 WHEN km <= 5 THEN 0.85 WHEN km <= 10 THEN 0.7 WHEN km <= 20 THEN 0.5 ELSE greatest(0.2, 0.5 - (km - 20) / 100) END AS DOUBLE) AS n FROM near)""")  # fmt: skip
def tip_scores(spark, d):
    return near(spark, d).select("id", *[F.round(c, 6).alias(n) for n, c in scoring.tip_scores(NOW).items()])


@register("tip_badges", TIPS + f"""SELECT id, array_to_string(list_filter([CASE WHEN h >= 0 AND h < 2 THEN 'LAST_CHANCE' END, CASE WHEN price_type = 'free' OR price_min <= 5 THEN 'BUDGET_PICK' END, CASE WHEN is_indoor THEN 'WEATHER_SAFE' END, CASE WHEN t THEN 'TRENDING' END, CASE WHEN (family_fit >= 70 OR stressfree >= 70) AND save_count + view_count < 5 AND NOT t THEN 'GEHEIMTIPP' END, CASE WHEN round(m, 6) >= 0.7 AND family_fit >= 70 THEN 'MATCH' END], lambda x: x IS NOT NULL)[1:3], ',') AS badges
    FROM (SELECT *, {MATCH} AS m, date_diff('second', TIMESTAMP '{NOW}', start_datetime) / 3600 AS h, (save_count + view_count >= 0.5 * greatest(1, max(save_count) OVER ()) AND save_count + view_count > 2) AS t FROM near)""")  # fmt: skip
def tip_badges(spark, d):
    x = near(spark, d).withColumn("match", F.round(scoring.tip_scores(NOW)["match"], 6))
    return x.select("id", text(scoring.badges(NOW, view(spark, d, "catalog").agg(F.max("save_count")).scalar())).alias("badges"))


@register("daily_tip")
def daily_tip(spark, d):
    """For each district the day's candidates (the 50 soonest), scored and re-ranked for variety."""
    shown = near(spark, d).where(search.displayable(NOW) & search.allowed_rating() & F.col("district").isNotNull())
    soon = search.first_per(shown, "district", [F.asc("start_datetime"), F.asc("id")], 50)
    slugs = view(spark, d, "event_category").groupBy(F.col("event_id").alias("kid")).agg(F.collect_list("slug").alias("slugs"))
    x = soon.withColumn("total", scoring.tip_scores(NOW)["total"]).join(slugs, F.col("kid") == F.col("id"), "left")
    return scoring.rerank(x.select("district", "id", "total", "price_type", "price_min", F.coalesce("slugs", F.array()).alias("slugs"), F.concat_ws("|", "district", "venue_name").alias("place")), "district")


@register("review_reason", ctes("catalog", "scores") + "SELECT id, CASE WHEN d <> 'rejected' THEN NULL WHEN family_fit < 30 THEN 'AI_REJECTED' ELSE 'MANUAL_REJECTED' END AS reason FROM (SELECT *, CASE WHEN is_cancelled OR family_fit < 30 THEN 'rejected' ELSE status END AS d FROM catalog LEFT JOIN scores ON id = event_id)")
def review_reason(spark, d):
    x = scored(spark, d).withColumn("status", F.when(F.col("is_cancelled") | scoring.yes(F.col("family_fit") < 30), "rejected").otherwise(F.col("status")))
    return x.select("id", scoring.review_reason().alias("reason"))


@register("validation_checks", ctes("catalog") + f"SELECT id, concat_ws(',', CASE WHEN title IS NULL THEN 'title_missing' END, CASE WHEN start_datetime IS NULL THEN 'date_missing' END, CASE WHEN address IS NULL THEN 'address_missing' END, CASE WHEN description_short IS NULL OR length(description_short) < 30 THEN 'desc_short' END, CASE WHEN price_min IS NULL AND price_max IS NULL THEN 'price_missing' END, 'image_missing', CASE WHEN start_datetime < TIMESTAMP '{NOW}' THEN 'date_past' END, CASE WHEN age_min > age_max THEN 'age_invalid' END, CASE WHEN price_min > price_max THEN 'price_invalid' END, CASE WHEN address IS NOT NULL AND lat IS NULL THEN 'geocode_missing' END) AS checks FROM catalog")
def validation_checks(spark, d):
    return view(spark, d, "catalog").select("id", text(scoring.validation_checks(NOW)).alias("checks"))


@register("needs_review", ctes("catalog", "scores") + "SELECT id FROM catalog LEFT JOIN scores ON id = event_id WHERE status = 'pending_review' OR confidence < 0.7 OR (family_fit >= 40 AND family_fit < 60)")
def needs_review(spark, d):
    fit = F.col("family_fit")
    return scored(spark, d).where((F.col("status") == "pending_review") | (F.col("confidence") < 0.7) | ((fit >= 40) & (fit < 60))).select("id")


#: When a field counts as filled, as a test that both engines read, and its weight.
FILLED = {
    "title": ("trim(title) <> ''", 3.0), "description": ("length(trim(description_short)) > 10", 2.0), "start_datetime": ("start_datetime IS NOT NULL", 3.0), "end_datetime": ("end_datetime IS NOT NULL", 1.0), "location_address": ("trim(address) <> ''", 2.0), "venue_name": ("trim(venue_name) <> ''", 1.0),
    "price_type": ("price_type <> 'unknown'", 1.5), "price_min": ("price_min IS NOT NULL", 1.0), "age_min": ("age_min IS NOT NULL", 1.0), "image_urls": ("n_images > 0", 1.5), "booking_url": ("booking_url LIKE 'http%'", 1.0),
}
TOTAL = sum(w for _, w in FILLED.values())
_covered = lambda test: f"round_even(count(*) FILTER (WHERE {test}) / count(*) * 100, 1)"


def coverage(spark, d):
    """The share of events with each field, in percent, for each source."""
    return view(spark, d, "catalog").groupBy("source_id").agg(*[F.bround(F.count_if(F.expr(test)) / F.count("*") * 100, 1).alias(f) for f, (test, _) in FILLED.items()])


@register("field_coverage", ctes("catalog") + " UNION ALL ".join(f"SELECT source_id, '{f}' AS field, {_covered(t)} AS percent FROM catalog GROUP BY source_id" for f, (t, _) in FILLED.items()))
def field_coverage(spark, d):
    return coverage(spark, d).unpivot("source_id", list(FILLED), "field", "percent")


@register("quality_score", ctes("catalog") + "SELECT source_id, round_even((" + " + ".join(f"{_covered(t)} * {w}" for t, w in FILLED.values()) + f") / {TOTAL}, 1) AS quality FROM catalog GROUP BY source_id")
def quality_score(spark, d):
    return coverage(spark, d).select("source_id", F.bround(sum((F.col(f) * w for f, (_, w) in FILLED.items()), F.lit(0.0)) / TOTAL, 1).alias("quality"))


@register("plan_select")
def plan_select(spark, d):
    """Three varied events for each provider's day plan, from its 20 best."""
    distance = F.when(F.col("distance_km").isNull() | (F.col("distance_km") == 0), 100.0).otherwise(F.col("distance_km"))
    rank = 0.6 * (F.coalesce("family_fit", F.lit(0)) + F.coalesce("stressfree", F.lit(0))) - 4 * distance
    x = near(spark, d).where(search.displayable(NOW)).withColumn("total", rank)
    best = search.first_per(x, "provider_id", [F.desc("total"), F.asc("id")], 20).drop("rank")
    slugs = view(spark, d, "event_category").groupBy(F.col("event_id").alias("kid")).agg(F.collect_list("slug").alias("slugs"))
    x = best.join(slugs, F.col("kid") == F.col("id"), "left").select("provider_id", "id", "total", "price_type", "price_min", F.coalesce("slugs", F.array()).alias("slugs"), F.coalesce("venue_name", F.lit("unknown")).alias("place"))
    return scoring.varied(x, "provider_id")


@register("review_client_filter", ctes("catalog", "scores") + "SELECT id, coalesce(family_fit, 0) AS score FROM catalog LEFT JOIN scores ON id = event_id WHERE (title ILIKE '%urgent%' OR address ILIKE '%urgent%') AND family_fit >= 20")
def review_client_filter(spark, d):
    return scored(spark, d).where(search.contains_ci("urgent", "title", "address") & (F.col("family_fit") >= 20)).select("id", F.coalesce("family_fit", F.lit(0)).alias("score"))


_ = METRES
