"""Dashboards, costs, trends and operational counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.operators import ops, trends
from eventloom.operators.search import ts
from eventloom.plans.views import CATALOG_NOW, NOW, ctes, view
from eventloom.session import table

B = "bigint"


@register("trending_terms", ctes("search_log") + f"""SELECT term, c AS searches_24h, b AS baseline_7d, round((c + 1) / (b + 1), 6) AS trend_ratio, round(c * ((c + 1) / (b + 1)), 6) AS score FROM (
    SELECT term, count(*) FILTER (WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL '24' HOUR) AS c, count(*) / 7 AS b FROM (SELECT trim(lower(query_norm)) AS term, created_at FROM search_log)
    WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL '168' HOUR AND created_at < TIMESTAMP '{NOW}' GROUP BY term) WHERE c >= 5 AND (c + 1) / (b + 1) >= 0.5""")  # fmt: skip
def trending_terms(spark, d):
    return trends.trending_terms(view(spark, d, "search_log"), NOW, min_ratio=0.5, min_count=5).withColumns({"trend_ratio": F.round("trend_ratio", 6), "score": F.round("score", 6)})


@register("dashboard_counts", ctes("catalog", "scores") + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'published') AS published, count(*) FILTER (WHERE status = 'pending_review') AS review, count(*) FILTER (WHERE event_id IS NOT NULL) AS processed,
    count(*) FILTER (WHERE event_id IS NOT NULL AND family_fit < 30) AS low_fit, count(*) FILTER (WHERE event_id IS NOT NULL AND status = 'published') AS ai_published,
    count(*) FILTER (WHERE event_id IS NOT NULL) - count(*) FILTER (WHERE event_id IS NOT NULL AND status = 'published') - count(*) FILTER (WHERE event_id IS NOT NULL AND family_fit < 30) AS ai_pending FROM catalog LEFT JOIN scores ON id = event_id""")  # fmt: skip
def dashboard_counts(spark, d):
    scored = F.col("event_id").isNotNull()
    low, pub = F.count_if(scored & (F.col("family_fit") < 30)), F.count_if(scored & (F.col("status") == "published"))
    joined = view(spark, d, "catalog").join(view(spark, d, "scores"), F.col("id") == F.col("event_id"), "left")
    return joined.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "published").alias("published"), F.count_if(F.col("status") == "pending_review").alias("review"), F.count_if(scored).alias("processed"), low.alias("low_fit"), pub.alias("ai_published"), (F.count_if(scored) - pub - low).alias("ai_pending"))


HEALTH = ["healthy", "degraded", "failing", "dead", "unknown"]


@register("source_health_histogram", ctes("source") + "SELECT " + ", ".join(f"count(*) FILTER (WHERE coalesce(health, 'unknown') = '{h}') AS {h}" for h in HEALTH) + " FROM source")
def source_health_histogram(spark, d):
    return view(spark, d, "source").agg(*[F.count_if(F.coalesce("health", F.lit("unknown")) == h).alias(h) for h in HEALTH])


@register("unique_terms", ctes("search_log") + "SELECT count(DISTINCT term) AS terms, count(DISTINCT city) AS cities FROM search_log")
def unique_terms(spark, d):
    return view(spark, d, "search_log").agg(F.count_distinct("term").alias("terms"), F.count_distinct("city").alias("cities"))


TOTALS = "count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 4) AS cost, round(avg(response_ms), 4) AS avg_ms, round(count(*) FILTER (WHERE error_code IS NOT NULL) / greatest(count(*), 1), 6) AS error_rate, round(count(*) FILTER (WHERE was_cached) / greatest(count(*), 1), 6) AS cache_rate"


def totals():
    n = F.greatest(F.count("*"), F.lit(1))
    return [F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.avg("response_ms"), 4).alias("avg_ms"), F.round(F.count("error_code") / n, 6).alias("error_rate"), F.round(F.count_if("was_cached") / n, 6).alias("cache_rate")]


@register("usage_totals", ctes("usage_log") + f"SELECT {TOTALS} FROM usage_log")
def usage_totals(spark, d):
    return view(spark, d, "usage_log").agg(*totals())


@register("usage_by_model", ctes("usage_log") + f"SELECT model, {TOTALS} FROM usage_log GROUP BY model")
def usage_by_model(spark, d):
    return view(spark, d, "usage_log").groupBy("model").agg(*totals())


@register("usage_by_operation", ctes("usage_log") + f"SELECT operation, {TOTALS} FROM usage_log GROUP BY operation")
def usage_by_operation(spark, d):
    return view(spark, d, "usage_log").groupBy("operation").agg(*totals())


@register("usage_rollup", ctes("usage_log") + "SELECT model, operation, count(*) AS calls, round(sum(cost), 4) AS cost FROM usage_log GROUP BY GROUPING SETS ((model), (operation), ())")
def usage_rollup(spark, d):
    return view(spark, d, "usage_log").groupingSets([["model"], ["operation"], []], "model", "operation").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


@register("daily_costs", ctes("usage_log") + "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(cost), 4) AS cost FROM usage_log GROUP BY 1")
def daily_costs(spark, d):
    return view(spark, d, "usage_log").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


MONTH = "2024-01-25 00:00:00"


@register("cost_budget", ctes("usage_log") + f"""SELECT round(m, 4) AS month, round(p, 4) AS previous, round(t, 4) AS today, round(m / 25 * 31, 4) AS projected, CASE WHEN greatest(t / 200, m / 4000) >= 1 THEN 'exceeded' WHEN greatest(t / 200, m / 4000) >= 0.9 THEN 'critical' WHEN greatest(t / 200, m / 4000) >= 0.7 THEN 'warning' ELSE 'ok' END AS level FROM (
    SELECT coalesce(sum(cost) FILTER (WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '{MONTH}'), 0) AS m, coalesce(sum(cost) FILTER (WHERE created_at >= TIMESTAMP '2023-12-01' AND created_at <= TIMESTAMP '2023-12-31'), 0) AS p, coalesce(sum(cost) FILTER (WHERE created_at >= TIMESTAMP '{MONTH}' AND created_at < TIMESTAMP '2024-01-26'), 0) AS t FROM usage_log)""")  # fmt: skip
def cost_budget(spark, d):
    """The previous month ends at midnight of its last day, whose rows stay out."""
    total = lambda a, b, last=False: F.coalesce(F.sum(F.when((F.col("created_at") >= ts(a)) & ((F.col("created_at") <= ts(b)) if last else (F.col("created_at") < ts(b))), F.col("cost"))), F.lit(0.0))
    x = view(spark, d, "usage_log").agg(total("2024-01-01 00:00:00", MONTH).alias("m"), total("2023-12-01 00:00:00", "2023-12-31 00:00:00", True).alias("p"), total(MONTH, "2024-01-26 00:00:00").alias("t"))
    return x.select(F.round("m", 4).alias("month"), F.round("p", 4).alias("previous"), F.round("t", 4).alias("today"), F.round(F.col("m") / 25 * 31, 4).alias("projected"), ops.budget_level(F.col("t"), 200, F.col("m"), 4000).alias("level"))


@register("cost_projection", ctes("usage_log") + "SELECT day, cost, round(avg(c) OVER () * 1.1, 4) AS projected FROM (SELECT strftime(created_at, '%Y-%m-%d') AS day, sum(cost) AS c, round(sum(cost), 4) AS cost FROM usage_log GROUP BY 1) ORDER BY day DESC LIMIT 7")
def cost_projection(spark, d):
    days = view(spark, d, "usage_log").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.sum("cost").alias("c"))
    return days.select("day", F.round("c", 4).alias("cost"), F.round(F.avg("c").over(Window.partitionBy(F.lit(0))) * 1.1, 4).alias("projected")).orderBy(F.desc("day")).limit(7)


@register("run_stats_24h", ctes("ingest_run") + f"SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running, CAST(sum(events_found) AS BIGINT) AS found, CAST(sum(events_created) AS BIGINT) AS created, CAST(sum(events_updated) AS BIGINT) AS updated, CAST(sum(events_skipped) AS BIGINT) AS skipped FROM ingest_run WHERE started_at >= TIMESTAMP '{CATALOG_NOW}' - INTERVAL '24' HOUR AND started_at < TIMESTAMP '{CATALOG_NOW}'")
def run_stats_24h(spark, d):
    now = ts(CATALOG_NOW)
    runs = view(spark, d, "ingest_run").where((F.col("started_at") >= now - F.expr("INTERVAL '24' HOUR")) & (F.col("started_at") < now))
    return runs.agg(F.count("*").alias("runs"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running")], *[F.sum(f"events_{x}").alias(x) for x in ("found", "created", "updated", "skipped")])


@register("run_kpis", ctes("ingest_run") + "SELECT count(*) AS runs, round(count(*) FILTER (WHERE status = 'completed') * 100 / greatest(count(*) FILTER (WHERE status <> 'running'), 1), 4) AS success, round(avg(events_found), 4) AS avg_found FROM ingest_run")
def run_kpis(spark, d):
    return view(spark, d, "ingest_run").agg(F.count("*").alias("runs"), F.round(F.count_if(F.col("status") == "completed") * 100 / F.greatest(F.count_if(F.col("status") != "running"), F.lit(1)), 4).alias("success"), F.round(F.avg("events_found"), 4).alias("avg_found"))


@register("top_sources", ctes("ingest_run", "source") + "SELECT source_id, coalesce(name, 'Unknown') AS name, created FROM (SELECT source_id, CAST(sum(events_created) AS BIGINT) AS created FROM ingest_run WHERE source_id IS NOT NULL GROUP BY source_id ORDER BY created DESC, source_id LIMIT 5) LEFT JOIN source ON source_id = id")
def top_sources(spark, d):
    top = view(spark, d, "ingest_run").where("source_id is not null").groupBy("source_id").agg(F.sum("events_created").alias("created")).orderBy(F.desc("created"), "source_id").limit(5)
    return top.join(view(spark, d, "source"), F.col("source_id") == F.col("id"), "left").select("source_id", F.coalesce("name", F.lit("Unknown")).alias("name"), "created")


@register("run_item_status", ctes("raw_item") + "SELECT run_id, count(*) FILTER (WHERE ingest_status = 'created') AS created, count(*) FILTER (WHERE ingest_status = 'updated') AS updated, count(*) FILTER (WHERE ingest_status = 'ignored') AS ignored FROM raw_item WHERE ingest_status IS NOT NULL GROUP BY run_id")
def run_item_status(spark, d):
    return view(spark, d, "raw_item").where("ingest_status is not null").groupBy("run_id").agg(*[F.count_if(F.col("ingest_status") == s).alias(s) for s in ("created", "updated", "ignored")])


@register("popular_queries", ctes("search_log") + f"SELECT term, count(*) AS n FROM search_log WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL '7' DAY GROUP BY term ORDER BY n DESC, term LIMIT 4")
def popular_queries(spark, d):
    return view(spark, d, "search_log").where(F.col("created_at") >= ts(NOW) - F.expr("INTERVAL '7' DAY")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(4)


@register("prefix_suggestions", ctes("search_log") + "SELECT term AS text, CAST(count(*) AS DOUBLE) AS score, 'log' AS src FROM search_log WHERE term LIKE 'c%' GROUP BY term UNION ALL SELECT text, 0.5, 'entity' FROM (VALUES ('city park'), ('castle'), ('museum')) AS v(text) WHERE text LIKE 'c%'")
def prefix_suggestions(spark, d):
    """The log's terms by count, capped at ten, and the fixed entities."""
    log = view(spark, d, "search_log").where(F.col("term").like("c%")).groupBy(F.col("term").alias("text")).agg(F.count("*").cast("double").alias("score")).orderBy(F.desc("score"), "text").limit(10)
    entities = spark.createDataFrame([("city park",), ("castle",), ("museum",)], "text string").where(F.col("text").like("c%"))
    return log.withColumn("src", F.lit("log")).unionByName(entities.select("text", F.lit(0.5).alias("score"), F.lit("entity").alias("src")))


@register("default_suggestions", ctes("search_log") + "SELECT term AS text FROM (SELECT query_norm AS term, count(*) AS n FROM search_log GROUP BY 1) WHERE term NOT IN ('view', 'museum') UNION ALL SELECT text FROM (VALUES ('View'), ('Museum')) AS v(text)")
def default_suggestions(spark, d):
    """Fixed categories, then the log's queries that are not among them, whatever the case."""
    fixed = spark.createDataFrame([("View",), ("Museum",)], "text string")
    log = view(spark, d, "search_log").select(F.col("query_norm").alias("text")).distinct()
    return fixed.union(log.join(fixed.select(F.lower("text").alias("known")), F.lower("text") == F.col("known"), "left_anti"))


@register("pending_per_source", ctes("raw_item", "catalog") + "SELECT r.source_id, count(DISTINCT r.event_id) AS pending FROM raw_item r JOIN catalog c ON r.event_id = c.id WHERE c.status = 'pending_review' GROUP BY r.source_id")
def pending_per_source(spark, d):
    pending = view(spark, d, "catalog").where("status = 'pending_review'").select("id")
    return view(spark, d, "raw_item").drop("id").join(pending, F.col("event_id") == F.col("id")).groupBy("source_id").agg(F.count_distinct("event_id").alias("pending"))


@register("missing_field_stats", ctes("catalog") + "SELECT *, (no_address / total > 0.1) AS crawl, (no_price / total > 0.25) AS prices, (no_age / total > 0.4) AS ages FROM (SELECT source_id, count(*) AS total, count(*) FILTER (WHERE address IS NULL) AS no_address, count(*) FILTER (WHERE price_min IS NULL) AS no_price, count(*) FILTER (WHERE age_min IS NULL) AS no_age FROM catalog GROUP BY source_id)")
def missing_field_stats(spark, d):
    c = view(spark, d, "catalog").groupBy("source_id").agg(F.count("*").alias("total"), *[F.count_if(F.col(f).isNull()).alias(n) for f, n in (("address", "no_address"), ("price_min", "no_price"), ("age_min", "no_age"))])
    return c.withColumns({"crawl": F.col("no_address") / F.col("total") > 0.1, "prices": F.col("no_price") / F.col("total") > 0.25, "ages": F.col("no_age") / F.col("total") > 0.4})


@register("child_counts", ctes("provider", "catalog") + "SELECT p.id, count(c.id) AS events FROM provider p LEFT JOIN catalog c ON c.provider_id = p.id GROUP BY p.id")
def child_counts(spark, d):
    counts = view(spark, d, "catalog").groupBy(F.col("provider_id").alias("id")).agg(F.count("*").alias("n"))
    return view(spark, d, "provider").select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("events"))


@register("unconfirmed_counts", "SELECT lower(p_type) AS slug, count(*) FILTER (WHERE l_linestatus = 'O') AS unconfirmed FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def unconfirmed_counts(spark, d):
    """How many of each kind's entries nobody has confirmed yet (line status O), kinds without entries included."""
    p, l = table(spark, d, "part"), table(spark, d, "lineitem").select("l_partkey", "l_linestatus")
    return p.join(l, p.p_partkey == l.l_partkey, "left").groupBy(F.lower("p_type").alias("slug")).agg(F.count_if(F.col("l_linestatus") == "O").alias("unconfirmed"))


JOB_STATES = ["queued", "running", "completed", "failed", "dead"]


@register("queue_stats_pivot", ctes("job") + "SELECT type, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in JOB_STATES) + " FROM job GROUP BY type")
def queue_stats_pivot(spark, d):
    return view(spark, d, "job").groupBy("type").pivot("status", JOB_STATES).count().fillna(0)


@register("status_score_stats", ctes("catalog", "scores") + "SELECT status, count(*) AS n, count(family_fit) AS scored, count(*) - count(family_fit) AS unscored, min(family_fit) AS low, max(family_fit) AS high, round(avg(family_fit), 4) AS mean FROM catalog LEFT JOIN scores ON id = event_id GROUP BY status")
def status_score_stats(spark, d):
    j = view(spark, d, "catalog").join(view(spark, d, "scores"), F.col("id") == F.col("event_id"), "left")
    return j.groupBy("status").agg(F.count("*").alias("n"), F.count("family_fit").alias("scored"), (F.count("*") - F.count("family_fit")).alias("unscored"), F.min("family_fit").alias("low"), F.max("family_fit").alias("high"), F.round(F.avg("family_fit"), 4).alias("mean"))


@register("ai_success_rate", ctes("catalog", "scores") + "SELECT count(*) AS n, CAST(floor(count(*) FILTER (WHERE confidence >= 0.5 AND family_fit IS NOT NULL) * 100 / greatest(count(*), 1) + 0.5) AS BIGINT) AS percent, max(created_at)::DATE::VARCHAR AS latest FROM catalog JOIN scores ON id = event_id")
def ai_success_rate(spark, d):
    j = view(spark, d, "catalog").join(view(spark, d, "scores"), F.col("id") == F.col("event_id"))
    good = F.count_if((F.col("confidence") >= 0.5) & F.col("family_fit").isNotNull())
    return j.agg(F.count("*").alias("n"), F.floor(good * 100 / F.greatest(F.count("*"), F.lit(1)) + 0.5).cast(B).alias("percent"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("latest"))


@register("today_summary", ctes("usage_log") + "SELECT operation, count(*) AS calls, round(sum(cost), 4) AS cost FROM usage_log WHERE created_at >= TIMESTAMP '2024-01-25' AND created_at < TIMESTAMP '2024-01-26' GROUP BY operation")
def today_summary(spark, d):
    return view(spark, d, "usage_log").where((F.col("created_at") >= ts(MONTH)) & (F.col("created_at") < ts("2024-01-26 00:00:00"))).groupBy("operation").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


@register("dedup_ratio", "SELECT count(*) AS total, count(DISTINCT text) AS kept, round(CASE WHEN count(*) = 0 THEN 0 ELSE (count(*) - count(DISTINCT text)) / count(*) END, 6) AS ratio FROM documents")
def dedup_ratio(spark, d):
    from eventloom.session import table

    c = table(spark, d, "documents").groupBy(F.xxhash64("text"), "text").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kept"))
    return c.select("total", "kept", F.round(F.when(F.col("total") == 0, 0.0).otherwise((F.col("total") - F.col("kept")) / F.col("total")), 6).alias("ratio"))


@register("plan_cost", ctes("catalog") + "SELECT provider_id, round(sum(CASE WHEN price_type = 'free' THEN 0 ELSE coalesce(price_min, 0) * 4 END), 4) AS cost FROM catalog GROUP BY provider_id")
def plan_cost(spark, d):
    return view(spark, d, "catalog").groupBy("provider_id").agg(F.round(F.sum(F.when(F.col("price_type") == "free", 0.0).otherwise(F.coalesce("price_min", F.lit(0.0)) * 4)), 4).alias("cost"))


@register("queue_alerts", ctes("job") + "SELECT count(*) FILTER (WHERE status = 'queued') AS backlog, count(*) FILTER (WHERE status = 'dead') AS dlq, (count(*) FILTER (WHERE status = 'dead') > 10) AS dlq_alert, (count(*) FILTER (WHERE status = 'queued') > 100) AS backlog_alert FROM job")
def queue_alerts(spark, d):
    queued, dead = F.count_if(F.col("status") == "queued"), F.count_if(F.col("status") == "dead")
    return view(spark, d, "job").agg(queued.alias("backlog"), dead.alias("dlq"), (dead > 10).alias("dlq_alert"), (queued > 100).alias("backlog_alert"))


@register("progress_percent", ctes("job") + "SELECT type, CAST(floor(count(*) FILTER (WHERE status = 'completed') * 100 / greatest(count(*), 1) + 0.5) AS BIGINT) AS percent, round(least(100, greatest(5, count(*) * 100 / max(count(*)) OVER ())), 4) AS bar FROM job GROUP BY type")
def progress_percent(spark, d):
    c = view(spark, d, "job").groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("done"))
    return c.select("type", F.floor(F.col("done") * 100 / F.greatest("n", F.lit(1)) + 0.5).cast(B).alias("percent"), F.round(F.least(F.lit(100.0), F.greatest(F.lit(5.0), F.col("n") * 100 / F.max("n").over(Window.partitionBy(F.lit(0))))), 4).alias("bar"))


@register("due_sources", ctes("source") + "SELECT id, priority FROM source WHERE is_active AND url IS NOT NULL AND (next_fetch_in_min <= 0 OR (next_fetch_in_min IS NULL AND last_fetch_min_ago IS NULL) OR (next_fetch_in_min IS NULL AND last_fetch_min_ago >= 360)) ORDER BY priority, id LIMIT 10")
def due_sources(spark, d):
    return view(spark, d, "source").where(ops.due()).select("id", "priority").orderBy("priority", "id").limit(10)


@register("stuck_runs", ctes("ingest_run") + "SELECT id FROM ingest_run WHERE status = 'running' AND age_min > 10")
def stuck_runs(spark, d):
    return view(spark, d, "ingest_run").where("status = 'running' and age_min > 10").select("id")


@register("stale_jobs", ctes("job") + "SELECT id FROM job WHERE status = 'running' AND heartbeat_s > CASE WHEN processed = 0 THEN 120 ELSE 300 END")
def stale_jobs(spark, d):
    return view(spark, d, "job").where(ops.stale_job()).select("id")


@register("job_dequeue", ctes("job") + "SELECT id, type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY priority DESC, scheduled_at, id) AS n FROM job WHERE status = 'queued') WHERE n = 1")
def job_dequeue(spark, d):
    from eventloom.operators.search import first_per

    return first_per(view(spark, d, "job").where("status = 'queued'"), "type", [F.desc("priority"), F.asc("scheduled_at"), F.asc("id")]).select("id", "type")


@register("health_eval", ctes("source") + """SELECT id, CASE WHEN failures >= 3 THEN 'failing' WHEN last_success_days >= 7 THEN 'failing' WHEN last_success_days IS NULL AND failures > 0 THEN 'failing' WHEN last_success_days IS NULL THEN 'unknown' WHEN expected_count > 0 AND last_count < 0.5 * expected_count THEN 'degraded' WHEN partial THEN 'degraded' ELSE 'healthy' END AS status,
    CASE WHEN failures >= 5 THEN 'dead' WHEN failures >= 3 THEN 'failing' WHEN failures > 0 THEN 'degraded' ELSE 'healthy' END AS by_failures, CAST(least(300 * power(2, least(failures, 8)), 86400) AS BIGINT) AS backoff FROM source""")  # fmt: skip
def health_eval(spark, d):
    return view(spark, d, "source").select("id", ops.health()["status"].alias("status"), ops.failure_health().alias("by_failures"), ops.backoff_seconds(F.col("failures")).alias("backoff"))


@register("token_cost", ctes("usage_log") + "SELECT u.id, round(u.input_tokens / 1000 * coalesce(p.price, 0.01) + u.output_tokens / 1000 * coalesce(p.price, 0.01) * 2, 8) AS price FROM usage_log u LEFT JOIN (VALUES ('model-view', 0.002), ('model-click', 0.003)) AS p(model, price) ON u.model = p.model")
def token_cost(spark, d):
    prices = spark.createDataFrame([("model-view", 0.002), ("model-click", 0.003)], "model string, price double")
    u = view(spark, d, "usage_log").join(prices, "model", "left")
    p = F.coalesce("price", F.lit(0.01))
    return u.select("id", F.round(F.col("input_tokens") / 1000 * p + F.col("output_tokens") / 1000 * p * 2, 8).alias("price"))


@register("metrics_text", ctes("job") + "SELECT string_agg(line, chr(10) ORDER BY line) AS text FROM (SELECT concat('queue_depth{type=\"', type, '\"} ', count(*)) AS line FROM job GROUP BY type)")
def metrics_text(spark, d):
    lines = view(spark, d, "job").groupBy("type").agg(F.count("*").alias("n")).select(F.concat(F.lit('queue_depth{type="'), "type", F.lit('"} '), F.col("n").cast("string")).alias("line"))
    return lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))


@register("event_ewma")
def event_ewma(spark, d):
    """Moving mean of events for each source over all its runs, 0.7 old + 0.3 new, the first run's count to begin with: a sum
    in which the run that k others follow weighs 0.3 * 0.7^k, the first 0.7^k."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("id"))
    runs = view(spark, d, "ingest_run").where("source_id is not null")
    runs = runs.select("source_id", "events_found", (F.row_number().over(newest) - 1).alias("k"), F.lead("id").over(newest).isNull().alias("first"))
    weight = F.pow(F.lit(0.7), F.col("k")) * F.when(F.col("first"), 1.0).otherwise(0.3)
    return runs.groupBy("source_id").agg(F.round(F.sum(weight * F.col("events_found")), 6).alias("ewma"))


#: Entries that wait, by provider group, with places, times and images that are missing at rates that differ by group.
WAITING = {
    "grp": "provider_id % 20",
    "place": "CASE WHEN id % 5 < provider_id % 4 THEN '  ' ELSE address END",
    "starts": "CASE WHEN id % 7 >= provider_id % 5 THEN start_datetime END",
    "ends": "end_datetime",
    "images": "CASE WHEN id % 3 <> provider_id % 2 THEN 1 ELSE 0 END",
}
#: The share of missing values above which a crawl is suggested, and how it is put.
CRAWL_ABOVE = [("no_place", 0.35, "% ohne Adresse"), ("no_start", 0.25, "% ohne Startdatum"), ("no_image", 0.4, "% ohne Bild")]
_why = ", ".join(f"CASE WHEN {n} / total > {share} THEN concat(CAST(floor({n} * 100.0 / total + 0.5) AS BIGINT), '{text}') END" for n, share, text in CRAWL_ABOVE)


@register("pending_missing", ctes("catalog") + f"""SELECT *, nullif(concat_ws(', ', {_why}), '') AS crawl_why FROM (
    SELECT grp, count(*) AS total, count(*) FILTER (WHERE place IS NULL OR trim(place) = '') AS no_place, count(*) FILTER (WHERE starts IS NULL) AS no_start,
        count(*) FILTER (WHERE ends IS NULL) AS no_end, count(*) FILTER (WHERE images = 0) AS no_image
    FROM (SELECT {", ".join(f"{e} AS {n}" for n, e in WAITING.items())} FROM catalog WHERE status <> 'published') GROUP BY grp)""")
def pending_missing(spark, d):
    """What waiting entries lack, by group, and why a crawl is suggested: null where no share is above its threshold."""
    w = view(spark, d, "catalog").where("status <> 'published'").select(*[F.expr(e).alias(n) for n, e in WAITING.items()])
    gone = {"no_place": F.col("place").isNull() | (F.trim("place") == ""), "no_start": F.col("starts").isNull(), "no_end": F.col("ends").isNull(), "no_image": F.col("images") == 0}
    stats = w.groupBy("grp").agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in gone.items()])
    part = lambda n: F.col(n) / F.col("total")
    why = [F.when(part(n) > share, F.concat(F.floor(F.col(n) * 100 / F.col("total") + 0.5).cast("string"), F.lit(text))) for n, share, text in CRAWL_ABOVE]
    return stats.withColumn("crawl_why", F.nullif(F.concat_ws(", ", *why), F.lit("")))
