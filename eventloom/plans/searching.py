"""Catalogue search, joins, ranking, pages and geo."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.operators import geo, search
from eventloom.operators.search import ts
from eventloom.plans.views import CATALOG_NOW, ctes, view

NOW = CATALOG_NOW
SHOWN = f"status = 'published' AND NOT is_cancelled AND start_datetime >= TIMESTAMP '{NOW}'"


def simple(name: str, views: tuple, sql: str, build):
    """Register a query on the catalogue: build(catalog) -> DataFrame."""
    register(name, ctes(*views) + sql)(lambda spark, d: build(*[view(spark, d, v) for v in views]))


simple("displayable_events", ("catalog",), f"SELECT id FROM catalog WHERE {SHOWN}", lambda c: c.where(search.displayable(NOW)).select("id"))
simple("search_facets", ("catalog",), f"SELECT id FROM catalog WHERE {SHOWN} AND age_max >= 6 AND age_min <= 9 AND (price_type = 'free' OR price_min <= 20) AND is_indoor", lambda c: c.where(search.facets(NOW, age_min=6, age_max=9, price_max=20, indoor=True)).select("id"))
simple("search_text", ("catalog",), f"SELECT id FROM catalog WHERE {SHOWN} AND (title ILIKE '%event 1%' OR coalesce(description_short ILIKE '%event 1%', false))", lambda c: c.where(search.facets(NOW, free=True, text="event 1")).select("id"))
simple("tab_weekend", ("catalog",), "SELECT id FROM catalog WHERE status = 'published' AND NOT is_cancelled AND start_datetime >= TIMESTAMP '1998-01-03' AND start_datetime < TIMESTAMP '1998-01-05'", lambda c: c.where(search.facets(NOW, tab="wochenende")).select("id"))
simple("tab_weekend_sunday", ("catalog",), "SELECT id FROM catalog WHERE status = 'published' AND NOT is_cancelled AND start_datetime >= TIMESTAMP '1998-01-10' AND start_datetime < TIMESTAMP '1998-01-12'", lambda c: c.where(search.facets("1998-01-04 00:00:00", tab="wochenende")).select("id"))
simple("tab_today", ("catalog",), "SELECT id FROM catalog WHERE status = 'published' AND NOT is_cancelled AND start_datetime >= TIMESTAMP '1998-01-01' AND start_datetime < TIMESTAMP '1998-01-02'", lambda c: c.where(search.facets(NOW, tab="heute")).select("id"))
simple("tab_holidays", ("catalog",), f"SELECT id FROM catalog WHERE {SHOWN} AND start_datetime <= TIMESTAMP '1998-01-31'", lambda c: c.where(search.facets(NOW, tab="ferien")).select("id"))
simple("tab_rain_free", ("catalog",), f"SELECT id, 'rain' AS tab FROM catalog WHERE {SHOWN} AND is_indoor UNION ALL SELECT id, 'free' FROM catalog WHERE {SHOWN} AND price_type = 'free'", lambda c: c.where(search.facets(NOW, tab="regen")).select("id", F.lit("rain").alias("tab")).union(c.where(search.facets(NOW, tab="kostenlos")).select("id", F.lit("free").alias("tab"))))
simple("price_filter", ("catalog",), "SELECT id FROM catalog WHERE price_type = 'free' OR price_min <= 15", lambda c: c.where(search.price_at_most(maximum=15)).select("id"))
simple("age_overlap", ("catalog",), "SELECT id, (coalesce(nullif(age_min, 0), 0) <= 8 AND coalesce(nullif(age_max, 0), 99) >= 5) AS planner FROM catalog WHERE (age_min IS NULL AND age_max IS NULL) OR ((age_min IS NULL OR age_min <= 8) AND (age_max IS NULL OR age_max >= 5))", lambda c: c.where(search.ages_overlap(5, 8)).select("id", search.ages_overlap_defaults(5, 8).alias("planner")))
simple("age_rating_filter", ("catalog",), "SELECT id FROM catalog WHERE age_rating IS NULL OR age_rating NOT IN ('16+', '18+')", lambda c: c.where(search.allowed_rating()).select("id"))
simple("category_semi_join", ("catalog", "event_category"), "SELECT id FROM catalog WHERE id IN (SELECT event_id FROM event_category WHERE slug IN ('economy', 'promo'))", lambda c, e: c.join(e.where(F.col("slug").isin("economy", "promo")), F.col("id") == F.col("event_id"), "left_semi").select("id"))
simple("ai_published", ("catalog", "scores"), "SELECT id, status FROM catalog WHERE (status = 'published' AND id IN (SELECT event_id FROM scores)) OR (status = 'pending_review' AND id IN (SELECT event_id FROM scores WHERE family_fit < 30))", lambda c, s: c.where("status = 'published'").join(s, F.col("id") == F.col("event_id"), "left_semi").union(c.where("status = 'pending_review'").join(s.where("family_fit < 30"), F.col("id") == F.col("event_id"), "left_semi")).select("id", "status"))
simple("missing_ids", ("catalog",), "SELECT id FROM (SELECT o_orderkey * 2 AS id FROM orders) WHERE id NOT IN (SELECT id FROM catalog)", lambda c: c.select((F.col("id") * 2).alias("id")).join(c.select("id"), "id", "left_anti"))
simple("past_published", ("catalog",), f"SELECT id, (start_datetime IS NULL) AS no_date FROM catalog WHERE status = 'published' AND (start_datetime < TIMESTAMP '{NOW}' OR start_datetime IS NULL)", lambda c: c.where((F.col("status") == "published") & ((F.col("start_datetime") < ts(NOW)) | F.col("start_datetime").isNull())).select("id", F.col("start_datetime").isNull().alias("no_date")))
simple("list_filters", ("ingest_run",), "SELECT id, correlation_id FROM ingest_run WHERE status = 'failed' AND source_id IS NULL AND correlation_id LIKE 'cron-%'", lambda r: r.where((F.col("status") == "failed") & F.col("source_id").isNull() & F.col("correlation_id").startswith("cron-")).select("id", "correlation_id"))
simple("log_filters", ("usage_log",), "SELECT id FROM usage_log WHERE model = 'model-error' AND operation = 'op1' AND error_code IS NOT NULL", lambda u: u.where((F.col("model") == "model-error") & (F.col("operation") == "op1") & F.col("error_code").isNotNull()).select("id"))


OVERRIDES = "overrides AS (SELECT p_partkey AS id, p_name AS term, (p_partkey % 4 <> 0) AS is_active, CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2024-01-15' + to_days(CAST(p_partkey % 40 AS INT)) END AS starts_at, CASE WHEN p_partkey % 5 < 2 THEN TIMESTAMP '2024-01-15' + to_days(CAST(p_partkey % 33 AS INT)) END AS ends_at, CASE p_partkey % 3 WHEN 0 THEN 'karlsruhe' WHEN 1 THEN 'berlin' END AS city FROM part)"


@register("override_window", f"WITH {OVERRIDES} SELECT id, term FROM overrides WHERE is_active AND (starts_at IS NULL OR starts_at <= TIMESTAMP '2024-01-31') AND (ends_at IS NULL OR ends_at >= TIMESTAMP '2024-01-31') AND (city IS NULL OR city = 'karlsruhe')")
def override_window(spark, d):
    from eventloom.operators.trends import active
    from eventloom.session import table

    k, day = F.col("p_partkey"), F.lit("2024-01-15").cast("timestamp_ntz")
    after = lambda n: day + F.make_dt_interval((k % n).cast("int"))
    o = table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("term"), (k % 4 != 0).alias("is_active"), F.when(k % 3 == 0, after(40)).alias("starts_at"), F.when(k % 5 < 2, after(33)).alias("ends_at"), F.when(k % 3 == 0, "karlsruhe").when(k % 3 == 1, "berlin").alias("city"))
    return o.where(active("2024-01-31 00:00:00", "karlsruhe")).select("id", "term")


@register("events_with_relations", ctes("catalog", "scores", "provider", "event_category") + "SELECT c.id, s.family_fit, p.name AS provider, coalesce(k.slugs, '') AS slugs, t.title AS moved_to FROM catalog c LEFT JOIN scores s ON s.event_id = c.id LEFT JOIN provider p ON p.id = c.provider_id LEFT JOIN (SELECT event_id, string_agg(slug, ',' ORDER BY slug) AS slugs FROM event_category GROUP BY event_id) k ON k.event_id = c.id LEFT JOIN catalog t ON t.id = c.rescheduled_to")
def events_with_relations(spark, d):
    c, s, p, k = (view(spark, d, v) for v in ("catalog", "scores", "provider", "event_category"))
    slugs = k.groupBy(F.col("event_id").alias("kid")).agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("slugs"))
    moved = c.select(F.col("id").alias("tid"), F.col("title").alias("moved_to"))
    out = c.join(s, F.col("event_id") == c["id"], "left").join(p.select(F.col("id").alias("pid"), F.col("name").alias("provider")), F.col("pid") == c["provider_id"], "left").join(slugs, F.col("kid") == c["id"], "left").join(moved, F.col("tid") == c["rescheduled_to"], "left")
    return out.select(c["id"], "family_fit", "provider", F.coalesce("slugs", F.lit("")).alias("slugs"), "moved_to")


@register("dup_pairs", ctes("catalog") + "SELECT a.id AS a, b.id AS b, a.title AS a_title, b.title AS b_title FROM catalog a JOIN catalog b ON b.id = a.id + 500")
def dup_pairs(spark, d):
    c = view(spark, d, "catalog")
    a, b = c.select(F.col("id").alias("a"), F.col("title").alias("a_title")), c.select(F.col("id").alias("b"), F.col("title").alias("b_title"))
    return a.join(b, F.col("b") == F.col("a") + 500)


@register("similar_events", ctes("catalog", "event_category") + f"""SELECT id, other, rank FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY start_datetime, other) AS rank FROM (SELECT DISTINCT a.event_id AS id, b.id AS other, b.start_datetime FROM event_category a JOIN event_category k ON a.slug = k.slug JOIN catalog b ON b.id = k.event_id JOIN catalog o ON o.id = a.event_id
    WHERE a.event_id <> b.id AND b.status = 'published' AND NOT b.is_cancelled AND b.start_datetime >= TIMESTAMP '{NOW}')) WHERE rank <= 4""")  # fmt: skip
def similar_events(spark, d):
    return search.similar(view(spark, d, "catalog"), view(spark, d, "event_category"), NOW)


@register("domain_match", ctes("source") + "SELECT s.id, min(m.id) AS matched FROM source s LEFT JOIN source m ON regexp_extract(m.url, '://([^/]+)', 1) = regexp_extract(s.url, '://([^/]+)', 1) AND m.url IS NOT NULL GROUP BY s.id")
def domain_match(spark, d):
    s = view(spark, d, "source")
    host = lambda c: F.try_parse_url(c, F.lit("HOST"))
    first = s.where("url is not null").groupBy(host(F.col("url")).alias("host")).agg(F.min("id").alias("matched"))
    return s.select("id", host(F.col("url")).alias("host")).join(first, "host", "left").select("id", "matched")


@register("saved_events", ctes("catalog", "scores") + "SELECT e.user_id, e.event_id AS save_id, c.id AS event, s.family_fit FROM events e JOIN catalog c ON c.id = e.event_id LEFT JOIN scores s ON s.event_id = c.id WHERE e.event_type = 'purchase'")
def saved_events(spark, d):
    from eventloom.session import table

    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("save_id"))
    c, s = view(spark, d, "catalog").select(F.col("id").alias("event")), view(spark, d, "scores")
    return e.join(c, F.col("save_id") == F.col("event")).join(s, F.col("event_id") == F.col("event"), "left").select("user_id", "save_id", "event", "family_fit")


@register("source_union", ctes("raw_item", "catalog") + "SELECT coalesce(a.u, b.u) AS url, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS fields FROM (SELECT source_url AS u, count(*) AS n FROM raw_item GROUP BY 1) a FULL JOIN (SELECT concat('https://x/', id) AS u, count(*) AS n FROM catalog GROUP BY 1) b ON a.u = b.u")
def source_union(spark, d):
    a = view(spark, d, "raw_item").groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n"))
    b = view(spark, d, "catalog").groupBy(F.concat(F.lit("https://x/"), F.col("id").cast("string")).alias("url")).agg(F.count("*").alias("m"))
    return a.join(b, "url", "full").select("url", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))).alias("fields"))


@register("plan_slots", ctes("raw_item", "catalog") + "SELECT run_id, string_agg(concat(position, ':', c.title), ',' ORDER BY position, c.title) AS slots FROM raw_item r JOIN catalog c ON c.id = r.event_id WHERE r.ingest_status = 'created' GROUP BY run_id")
def plan_slots(spark, d):
    c = view(spark, d, "catalog").select(F.col("id").alias("cid"), "title")
    r = view(spark, d, "raw_item").where("ingest_status = 'created'").join(c, F.col("event_id") == F.col("cid"))
    return r.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: F.concat(x["position"].cast("string"), F.lit(":"), x["title"])), ",").alias("slots"))


@register("list_with_parents", ctes("ingest_run", "source") + "SELECT r.id, r.status, s.name AS source FROM ingest_run r LEFT JOIN source s ON s.id = r.source_id ORDER BY s.name DESC NULLS FIRST, r.id LIMIT 50")
def list_with_parents(spark, d):
    s = view(spark, d, "source").select(F.col("id").alias("sid"), F.col("name").alias("source"))
    return view(spark, d, "ingest_run").join(s, F.col("sid") == F.col("source_id"), "left").orderBy(F.col("source").desc_nulls_first(), "id").select("id", "status", "source").limit(50)


RELEVANCE = f"SELECT c.id, s.relevance FROM catalog c LEFT JOIN scores s ON s.event_id = c.id WHERE {SHOWN} ORDER BY s.relevance DESC NULLS FIRST, start_datetime NULLS LAST, c.id"


def scored(spark, d):
    return view(spark, d, "catalog").where(search.displayable(NOW)).join(view(spark, d, "scores"), F.col("id") == F.col("event_id"), "left")


@register("sort_relevance", ctes("catalog", "scores") + RELEVANCE + " LIMIT 20")
def sort_relevance(spark, d):
    return search.page(scored(spark, d), search.order("relevance")).select("id", "relevance")


@register("page_offset", ctes("catalog", "scores") + RELEVANCE + " LIMIT 15 OFFSET 30")
def page_offset(spark, d):
    return search.page(scored(spark, d), search.order("relevance"), 3, 15).select("id", "relevance")


@register("page_info", ctes("catalog") + f"SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages, (2 < ceil(count(*) / 20)) AS has_next, true AS has_prev FROM catalog WHERE {SHOWN}")
def page_info(spark, d):
    return search.page_info(view(spark, d, "catalog").where(search.displayable(NOW)), 2, 20)


@register("sort_newest", ctes("catalog") + f"SELECT id FROM catalog WHERE {SHOWN} ORDER BY created_at DESC NULLS FIRST, id LIMIT 20")
def sort_newest(spark, d):
    return search.page(view(spark, d, "catalog").where(search.displayable(NOW)), search.order("newest")).select("id")


@register("page_keyset", ctes("usage_log") + "SELECT id FROM usage_log WHERE created_at < TIMESTAMP '2024-01-20' OR (created_at = TIMESTAMP '2024-01-20' AND id < 100) ORDER BY created_at DESC, id DESC LIMIT 21")
def page_keyset(spark, d):
    return search.after(view(spark, d, "usage_log"), "created_at", "id", "2024-01-20 00:00:00", 100, 20).select("id")


for _name, _where, _order, _cols in (
    ("top_picks", "family_fit >= 70", "family_fit DESC NULLS FIRST, id", ["family_fit"]),
    ("trending_events", "true", "save_count DESC, view_count DESC, id", ["save_count", "view_count"]),
    ("featured_events", "quality >= 80", "quality DESC NULLS FIRST, id", ["quality"]),
):
    register(_name, ctes("catalog", "scores") + f"SELECT id FROM catalog LEFT JOIN scores ON id = event_id WHERE {SHOWN} AND {_where} ORDER BY {_order} LIMIT 10")(lambda spark, d, w=_where, o=_cols: scored(spark, d).where(w).orderBy(*[F.col(x).desc_nulls_first() for x in o], "id").select("id").limit(10))


@register("latest_snapshot", ctes("search_log") + "SELECT event_id, term FROM search_log WHERE created_at = (SELECT max(created_at) FROM search_log)")
def latest_snapshot(spark, d):
    log = view(spark, d, "search_log")
    return log.join(log.agg(F.max("created_at").alias("created_at")), "created_at").select("event_id", "term")


@register("latest_run_per_source", ctes("ingest_run") + "SELECT source_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS rank FROM ingest_run WHERE source_id IS NOT NULL) WHERE rank <= 3")
def latest_run_per_source(spark, d):
    return search.first_per(view(spark, d, "ingest_run").where("source_id is not null"), "source_id", [F.desc("started_at"), F.desc("id")], 3).select("source_id", "id", F.col("rank").cast("bigint").alias("rank"))


@register("keep_first_dedup", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def keep_first_dedup(spark, d):
    from eventloom.session import table

    return table(spark, d, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@register("time_slots", ctes("catalog") + "SELECT id, slot, 600 + (slot - 1) * 120 + CASE WHEN slot > 2 THEN 60 ELSE 0 END AS start_min, 600 + (slot - 1) * 120 + CASE WHEN slot > 2 THEN 60 ELSE 0 END + 90 AS end_min FROM (SELECT id, row_number() OVER (PARTITION BY provider_id ORDER BY start_datetime, id) AS slot FROM catalog) WHERE slot <= 5")
def time_slots(spark, d):
    x = search.first_per(view(spark, d, "catalog"), "provider_id", [F.asc("start_datetime"), F.asc("id")], 5)
    start = F.lit(600) + (F.col("rank") - 1) * 120 + F.when(F.col("rank") > 2, 60).otherwise(0)
    return x.select("id", F.col("rank").cast("bigint").alias("slot"), start.cast("bigint").alias("start_min"), (start + 90).cast("bigint").alias("end_min"))


@register("audit_recent", ctes("raw_item") + "SELECT id, event_id FROM raw_item WHERE ingest_status = 'updated' AND source_id = 3 ORDER BY seen_at DESC, id DESC LIMIT 50")
def audit_recent(spark, d):
    return view(spark, d, "raw_item").where("ingest_status = 'updated' and source_id = 3").orderBy(F.desc("seen_at"), F.desc("id")).select("id", "event_id").limit(50)


@register("json_path_runs", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) IN (1, 2, 3)")
def json_path_runs(spark, d):
    from eventloom.session import table

    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k")).where(F.col("k").isin(1, 2, 3))


METRES = "2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a))"
HAVERSINE = "pow(sin((radians(49.0069) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(49.0069)) * pow(sin((radians(8.4037) - radians(lng)) / 2), 2)"


@register("geo_radius", ctes("catalog") + f"SELECT id, CAST(floor(m + 0.5) AS BIGINT) AS distance_m, floor(m / 1000 * 10 + 0.5) / 10 AS distance_km FROM (SELECT id, {METRES} AS m FROM (SELECT id, {HAVERSINE} AS a FROM catalog WHERE {SHOWN} AND lat IS NOT NULL)) WHERE m <= 20000")
def geo_radius(spark, d):
    near = geo.within(view(spark, d, "catalog").where(search.displayable(NOW)), 49.0069, 8.4037, 20000)
    return near.select("id", F.floor(F.col("distance_m") + 0.5).cast("bigint").alias("distance_m"), geo.js_round(F.col("distance_m") / 1000, 1).alias("distance_km"))


@register("geo_nearest", ctes("catalog") + f"SELECT id FROM (SELECT id, start_datetime, {METRES} AS m FROM (SELECT id, start_datetime, {HAVERSINE} AS a FROM catalog WHERE lat IS NOT NULL)) WHERE m <= 5000 ORDER BY m, start_datetime, id LIMIT 20")
def geo_nearest(spark, d):
    return search.page(geo.within(view(spark, d, "catalog"), 49.0069, 8.4037, 5000), search.order("nearest")).select("id")


@register("region_filter", ctes("catalog") + f"SELECT id, coalesce({METRES} <= 30000, false) AS inside FROM (SELECT id, {HAVERSINE} AS a FROM catalog)")
def region_filter(spark, d):
    return view(spark, d, "catalog").select("id", F.coalesce(geo.metres(F.col("lat"), F.col("lng"), 49.0069, 8.4037) <= 30000, F.lit(False)).alias("inside"))


@register("district_alias", ctes("catalog") + "SELECT c.id, coalesce(a.name, c.district) AS district FROM catalog c LEFT JOIN (VALUES ('D1', 'Mitte'), ('D11', 'Mitte'), ('D2', 'West')) AS a(alias, name) ON a.alias = c.district")
def district_alias(spark, d):
    names = spark.createDataFrame([("Mitte", ["D1", "D11"]), ("West", ["D2"])], "name string, aliases array<string>").select("name", F.explode("aliases").alias("district"))
    return view(spark, d, "catalog").join(names, "district", "left").select("id", F.coalesce("name", "district").alias("district"))


#: Weather by code, and what is too wet for outdoor events.
WEATHER = {
    0: "clear", 1: "mostly_clear", 2: "partly_cloudy", 3: "overcast", 45: "fog", 48: "fog", 51: "drizzle", 53: "drizzle", 55: "drizzle", 61: "rain", 63: "rain", 65: "rain", 66: "freezing_rain", 67: "freezing_rain",
    71: "snow", 73: "snow", 75: "snow", 77: "snow", 80: "showers", 81: "showers", 82: "showers", 85: "snow_showers", 86: "snow_showers", 95: "thunderstorm", 96: "thunderstorm", 99: "thunderstorm",
}
BAD_WEATHER = ["rain", "showers", "snow", "snow_showers", "thunderstorm", "freezing_rain"]
ADVICE = ["Perfektes Wetter für Outdoor-Aktivitäten!", "Bewölkt, aber trocken - Outdoor möglich", "Indoor-Aktivitäten empfohlen", "Wetterabhängig - Plan B bereithalten"]
FORECASTS = "forecasts AS (SELECT o_orderkey AS id, o_orderkey % 101 AS code, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey * 7 % 101 AS INT) END AS rain, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 3 % 40 - 8 AS INT) END AS warm FROM orders)"


@register("weather_class", f"WITH {FORECASTS} SELECT id, w AS weather, (w NOT IN ({', '.join(map(repr, BAD_WEATHER))}) AND coalesce(rain, 0) < 50 AND coalesce(warm, 20) > 5) AS outdoor, CASE WHEN w IN ('clear', 'mostly_clear', 'partly_cloudy') THEN '{ADVICE[0]}' WHEN w = 'overcast' THEN '{ADVICE[1]}' WHEN w IN ({', '.join(map(repr, BAD_WEATHER))}) THEN '{ADVICE[2]}' ELSE '{ADVICE[3]}' END AS advice FROM (SELECT *, CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in WEATHER.items()) + " ELSE 'unknown' END AS w FROM forecasts)")
def weather_class(spark, d):
    from eventloom.session import table

    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select(k.alias("id"), (k % 101).cast("int").alias("code"), F.when(k % 9 != 0, (k * 7 % 101).cast("int")).alias("rain"), F.when(k % 11 != 0, (k * 3 % 40 - 8).cast("int")).alias("warm"))
    names = F.create_map(*[F.lit(v) for pair in WEATHER.items() for v in pair])
    w, bad = F.col("weather"), F.col("weather").isin(BAD_WEATHER)
    x = f.withColumn("weather", F.coalesce(F.try_element_at(names, F.col("code")), F.lit("unknown")))
    advice = F.when(w.isin("clear", "mostly_clear", "partly_cloudy"), ADVICE[0]).when(w == "overcast", ADVICE[1]).when(bad, ADVICE[2]).otherwise(ADVICE[3])
    return x.select("id", "weather", (~bad & (F.coalesce("rain", F.lit(0)) < 50) & (F.coalesce("warm", F.lit(20)) > 5)).alias("outdoor"), advice.alias("advice"))
