"""Remaining pieces: addresses, zones, candidates from parsed events, batches, sums by day, lists with all their parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.functions import fields as X
from eventloom.functions import text as T
from eventloom.operators import trends
from eventloom.plans.fields import made
from eventloom.plans.scoring import TIPS, near
from eventloom.plans.views import NOW, ctes, view
from eventloom.session import fresh_path, one_time, table

ADDRESSES = "addresses AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat(' Weg  ', o_orderkey, chr(10), ' 76131 Karlsruhe ') WHEN 3 THEN 'Siehe  Beschreibung' WHEN 4 THEN 's. u.' WHEN 5 THEN repeat('Allee 5 ', 60) WHEN 6 THEN 'siehe oben / unten' ELSE 'siehe Karte' END AS address FROM orders)"


@register("address_normalize", f"WITH {ADDRESSES} SELECT id, CASE WHEN a <> '' AND lower(a) NOT IN ({', '.join(map(repr, T.ADDRESS_PLACEHOLDERS))}) THEN a END AS address, regexp_extract(a, '([0-9]{{5}})\\s+([A-ZÄÖÜ][A-Za-zÄÖÜäöüß-]+)', 2) AS city FROM (SELECT id, trim(substr(trim(regexp_replace(address, '\\s+', ' ', 'g')), 1, 300)) AS a FROM addresses)")
def address_normalize(spark, d):
    """Addresses in normal form, null for phrases that stand in for one, and the town after a postal code."""
    a = F.col("address")
    return made(spark, d, ADDRESSES, "addresses").select("id", F.trim(T.address(a)).alias("address"), F.regexp_extract(T.squeeze(a), r"([0-9]{5})\s+([A-ZÄÖÜ][A-Za-zÄÖÜäöüß-]+)", 2).alias("city"))


@register("berlin_time", ctes("catalog") + "SELECT id, (timezone('Europe/Berlin', CAST(strftime(start_datetime + to_hours(id % 24), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)) AT TIME ZONE 'UTC') AS utc FROM catalog")
def berlin_time(spark, d):
    """Texts without a zone are Berlin times; as UTC. Of an hour that comes twice, the second is meant (winter time)."""
    t = F.date_format(F.col("start_datetime") + F.make_dt_interval(F.lit(0), (F.col("id") % 24).cast("int")), "yyyy-MM-dd HH:mm:ss")
    x = view(spark, d, "catalog").select("id", t.try_cast("timestamp").alias("t")).withColumn("u", F.to_utc_timestamp("t", "Europe/Berlin"))
    later = F.col("u") + F.expr("INTERVAL '1' HOUR")
    return x.select("id", F.when(F.from_utc_timestamp(later, "Europe/Berlin") == F.col("t"), later).otherwise(F.col("u")).cast("timestamp_ntz").alias("utc"))


_agg = lambda c: "(" + " OR ".join(f"contains(lower({c}), '{p}')" for p in X.AGGREGATORS) + ")"
PARSED = "parsed AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('Ein Fest ', o_orderkey) ELSE 'Der Veranstalter: x' END AS description, CASE o_orderkey % 3 WHEN 0 THEN concat(' Verein ', o_orderkey, ' ') WHEN 1 THEN ' ' END AS organizer, CASE WHEN o_orderkey % 5 < 2 THEN 'https://kalender.de/1' END AS booking, CASE WHEN o_orderkey % 2 = 0 THEN concat('https://b.de/', o_orderkey) END AS raw_url, concat('https://s.de/', o_orderkey) AS source_url, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS price_min, CASE WHEN o_orderkey % 7 = 0 THEN 12.5 END AS raw_price FROM orders)"


@register("parsed_candidate", f"WITH {PARSED} SELECT id, CASE WHEN trim(coalesce(organizer, '')) = '' THEN nullif(description, '') WHEN coalesce(description, '') = '' THEN concat('Veranstalter: ', trim(organizer)) WHEN contains(lower(description), 'veranstalter') OR contains(lower(description), 'organizer') THEN description ELSE concat('Veranstalter: ', trim(organizer), chr(10), chr(10), description) END AS description, CASE WHEN booking <> '' AND NOT {_agg('booking')} THEN booking WHEN raw_url <> '' AND NOT {_agg('raw_url')} THEN raw_url WHEN NOT {_agg('source_url')} THEN source_url END AS booking_url, coalesce(price_min, CAST(raw_price AS DOUBLE)) AS price_min FROM parsed")
def parsed_candidate(spark, d):
    """Candidates from parsed events: the organiser in front of the text, the best booking link, the first price there is."""
    p = made(spark, d, PARSED, "parsed")
    who, what = F.trim("organizer"), F.col("description")
    told = F.lower(what).contains("veranstalter") | F.lower(what).contains("organizer")
    lead = F.concat(F.lit("Veranstalter: "), who)
    text = F.when(F.coalesce(who, F.lit("")) == "", F.nullif(what, F.lit(""))).when(F.coalesce(what, F.lit("")) == "", lead).when(told, what).otherwise(F.concat(lead, F.lit("\n\n"), what))
    return p.select("id", text.alias("description"), X.booking_url(F.col("booking"), F.col("raw_url"), F.col("source_url")).alias("booking_url"), F.coalesce("price_min", F.col("raw_price").cast("double")).alias("price_min"))


@register("geocode_batch", ctes("catalog") + "SELECT count(*) AS picked, count(*) FILTER (WHERE known) AS from_cache, count(*) FILTER (WHERE NOT known) AS to_ask FROM (SELECT id, sha256(lower(trim(address))) IN (SELECT sha256(lower(trim(address))) FROM catalog WHERE lat IS NOT NULL AND address IS NOT NULL) AS known FROM catalog WHERE address IS NOT NULL AND lat IS NULL ORDER BY id LIMIT 50)")
def geocode_batch(spark, d):
    """The next fifty events without coordinates: how many have an answer in the cache, how many are to be asked for."""
    digest = F.sha2(F.lower(F.trim("address")), 256)
    c = view(spark, d, "catalog").where("address is not null")
    known = c.where("lat is not null").select(digest.alias("h")).distinct()
    picked = c.where("lat is null").orderBy("id").limit(50).select("id", digest.alias("key"))
    return picked.join(known, F.col("h") == F.col("key"), "left").agg(F.count("*").alias("picked"), F.count("h").alias("from_cache"), F.count_if(F.col("h").isNull()).alias("to_ask"))


@register("gold_accuracy", "SELECT count(*) AS total, count(*) FILTER (WHERE quality IS NULL OR (quality = 1) = (n_chars > 300)) AS correct, round(count(*) FILTER (WHERE quality IS NULL OR (quality = 1) = (n_chars > 300)) / count(*), 3) AS accuracy FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def gold_accuracy(spark, d):
    """How often a decision (here: a text of over 300 characters is good) is the expected one; without one it counts as right."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    right = F.coalesce((F.col("quality") == 1) == (F.col("n_chars") > 300), F.lit(True))
    return x.agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.round(F.count_if(right) / F.count("*"), 3).alias("accuracy"))


@register("append_sink", ctes("search_log") + "SELECT term, count(*) AS n, 1 AS batch FROM search_log WHERE user_id % 2 = 0 GROUP BY term UNION ALL SELECT term, count(*), 2 FROM search_log WHERE user_id % 2 = 1 GROUP BY term")
def append_sink(spark, d):
    """Two batches of rows appended to one table, which is then read."""
    out = fresh_path(spark, "appended")
    log = view(spark, d, "search_log")
    for k in (0, 1):
        rows = log.where(F.col("user_id") % 2 == k).groupBy("term").agg(F.count("*").alias("n")).withColumn("batch", F.lit(k + 1))
        with one_time(spark):
            rows.write.mode("append").parquet(out)
    return spark.read.schema("term string, n long, batch int").parquet(out)


@register("trending_city", ctes("search_log") + f"""SELECT term, city, c AS searches_24h, b AS baseline_7d, round((c + 1) / (b + 1), 6) AS trend_ratio, round(c * ((c + 1) / (b + 1)), 6) AS score FROM (SELECT term, city, count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-16 00:00:00' - INTERVAL '24' HOUR) AS c, count(*) / 7 AS b
    FROM search_log WHERE created_at >= TIMESTAMP '2024-01-16 00:00:00' - INTERVAL '168' HOUR AND created_at < TIMESTAMP '2024-01-16 00:00:00' GROUP BY term, city) WHERE c >= 10 AND (c + 1) / (b + 1) >= 2""")
def trending_city(spark, d):
    """Trending terms of each city, with the production thresholds: twice the baseline and ten searches a day."""
    t, now = F.col("created_at"), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    recent = view(spark, d, "search_log").where((t >= now - F.expr("INTERVAL '168' HOUR")) & (t < now))
    g = recent.groupBy("term", "city").agg(F.count_if(t >= now - F.expr("INTERVAL '24' HOUR")).alias("searches_24h"), (F.count("*") / 7).alias("baseline_7d"))
    ratio = (F.col("searches_24h") + 1) / (F.col("baseline_7d") + 1)
    return g.where((F.col("searches_24h") >= 10) & (ratio >= 2)).withColumns({"trend_ratio": F.round(ratio, 6), "score": F.round(F.col("searches_24h") * ratio, 6)})


@register("usage_by_day", ctes("usage_log") + "SELECT strftime(created_at, '%Y-%m-%d') AS day, model, operation, count(*) AS calls, round(sum(cost), 4) AS cost FROM usage_log GROUP BY GROUPING SETS ((1), (model), (operation))")
def usage_by_day(spark, d):
    """Calls and costs by day, by model and by operation, in one pass."""
    u = view(spark, d, "usage_log").withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    return u.groupingSets([["day"], ["model"], ["operation"]], "day", "model", "operation").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


@register("recent_calls", ctes("usage_log") + "SELECT id, model, operation, round(cost, 6) AS cost FROM usage_log ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_calls(spark, d):
    """The last fifty calls."""
    return view(spark, d, "usage_log").orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "model", "operation", F.round("cost", 6).alias("cost"))


@register("job_summary", ctes("job") + "SELECT type, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS succeeded, count(*) FILTER (WHERE status IN ('failed', 'dead')) AS failed, sum(processed) AS processed FROM job GROUP BY type")
def job_summary(spark, d):
    """What became of the jobs of each type."""
    s = F.col("status")
    return view(spark, d, "job").groupBy("type").agg(F.count("*").alias("total"), F.count_if(s == "completed").alias("succeeded"), F.count_if(s.isin("failed", "dead")).alias("failed"), F.sum("processed").alias("processed"))


@register("plan_totals", TIPS + "SELECT provider_id, round(sum(CASE WHEN price_type = 'free' THEN 0 ELSE coalesce(price_min, 0) * 4 END), 4) AS cost, round(sum(coalesce(km, 0)), 2) AS distance FROM near GROUP BY provider_id")
def plan_totals(spark, d):
    """Costs for four and distances of each provider's plan."""
    cost = F.when(F.col("price_type") == "free", 0.0).otherwise(F.coalesce("price_min", F.lit(0.0)) * 4)
    return near(spark, d).groupBy("provider_id").agg(F.round(F.sum(cost), 4).alias("cost"), F.round(F.sum(F.coalesce("distance_km", F.lit(0.0))), 2).alias("distance"))


PARENTS = {"provider": ("provider", "id", "catalog", "provider_id"), "source": ("source", "id", "catalog", "source_id"), "run": ("ingest_run", "id", "raw_item", "run_id")}


@register("parent_counts", ctes("provider", "source", "catalog", "ingest_run", "raw_item", "event_category") + " UNION ALL ".join(f"SELECT '{n}' AS parent, CAST(p.{k} AS VARCHAR) AS id, count(c.id) AS children FROM {p} p LEFT JOIN {c} c ON c.{f} = p.{k} GROUP BY p.{k}" for n, (p, k, c, f) in PARENTS.items()) + " UNION ALL SELECT 'category', slug, count(event_id) FROM event_category GROUP BY slug")
def parent_counts(spark, d):
    """How many children every provider, source, run and category has, none included."""
    out = view(spark, d, "event_category").groupBy(F.col("slug").alias("id")).agg(F.count("event_id").alias("children")).select(F.lit("category").alias("parent"), "id", "children")
    for name, (parent, key, child, foreign) in PARENTS.items():
        n = view(spark, d, child).groupBy(F.col(foreign).alias("__k")).agg(F.count("*").alias("n"))
        p = view(spark, d, parent).select(key).join(n, F.col(key) == F.col("__k"), "left")
        out = out.union(p.select(F.lit(name), F.col(key).cast("string"), F.coalesce("n", F.lit(0))))
    return out


@register("saved_list", ctes("catalog", "scores", "event_category") + "SELECT e.user_id, c.id, s.family_fit, (SELECT string_agg(slug, ',' ORDER BY slug) FROM event_category k WHERE k.event_id = c.id) AS slugs, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, c.id) AS place FROM events e JOIN catalog c ON c.id = e.event_id LEFT JOIN scores s ON s.event_id = c.id WHERE e.event_type = 'purchase'")
def saved_list(spark, d):
    """Each user's saved events, the newest first, with scores and categories."""
    from pyspark.sql import Window

    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("save_id"), "ts")
    slugs = view(spark, d, "event_category").groupBy(F.col("event_id").alias("kid")).agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("slugs"))
    c, s = view(spark, d, "catalog").select("id"), view(spark, d, "scores").select("event_id", "family_fit")
    x = e.join(c, F.col("save_id") == F.col("id")).join(s, F.col("event_id") == F.col("id"), "left").join(slugs, F.col("kid") == F.col("id"), "left")
    return x.select("user_id", "id", "family_fit", "slugs", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "id")).alias("place"))


@register("run_items", ctes("raw_item", "ingest_run", "catalog") + "SELECT r.id, r.run_id, n.status AS run_status, c.title FROM raw_item r LEFT JOIN ingest_run n ON n.id = r.run_id LEFT JOIN catalog c ON c.id = r.event_id AND c.status = 'published'")
def run_items(spark, d):
    """Items with their run and, if it is published, their event."""
    n = view(spark, d, "ingest_run").select(F.col("id").alias("nid"), F.col("status").alias("run_status"))
    c = view(spark, d, "catalog").where("status = 'published'").select(F.col("id").alias("cid"), "title")
    return view(spark, d, "raw_item").join(n, F.col("nid") == F.col("run_id"), "left").join(c, F.col("cid") == F.col("event_id"), "left").select("id", "run_id", "run_status", "title")


@register("tab_afternoon", ctes("catalog") + "SELECT id FROM catalog WHERE hour(start_datetime + to_hours(id % 24)) >= 14")
def tab_afternoon(spark, d):
    """The afternoon tab."""
    from eventloom.operators.search import tab_range

    c = view(spark, d, "catalog").withColumn("start_datetime", F.col("start_datetime") + F.make_dt_interval(F.lit(0), (F.col("id") % 24).cast("int")))
    return c.where(tab_range("nachmittags", NOW)["hour"]).select("id")


@register("normalize_event")
def normalize_event(spark, d):
    """The whole normaliser in one pass over event texts: description, price, ages, flags, availability, contacts, time. Its
    columns equal those of the single queries (tests/test_brute.py)."""
    x = view(spark, d, "event_text").select("id", "description", F.lower("description").alias("t"))
    t, text = F.col("t"), F.col("description")
    contacts = T.contacts(text)
    y = x.select("id", T.short_description(text).alias("description_short"), T.price(t).alias("p"), T.age_range(t).alias("a"), *[c.alias(n) for n, c in T.flags(t).items()], T.availability(t).alias("availability"), *[c.alias(n) for n, c in contacts.items()], T.time_of_day(t).alias("c"))
    return y.select("id", "description_short", F.col("p.type").alias("price_type"), F.col("p.min").alias("price_min"), F.col("a.low").alias("age_min"), F.col("a.high").alias("age_max"), "indoor", "outdoor", "language", "limited", "recurrence", "parking", "availability", "email", "phone", F.col("c.start").alias("start_min"), F.col("c.ending").alias("end_min"))


_ = trends
