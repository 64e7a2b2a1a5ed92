"""Streaming queries over the events and runs, run over all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.plans.views import K
from eventloom.session import ship_package, table
from eventloom.streaming import jobs, ordered
from eventloom.streaming.ordered import DAY


def stream(spark, d, name):
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@register("stream_trends", f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, concat(lower(trim(event_type)), ':', CAST(floor({K} / 25) AS INT)) AS term, count(*) AS n FROM events GROUP BY 1, 2")
def stream_trends(spark, d):
    """Daily counts of terms by a watermarked window, in update mode: the newest row of a window is its count, open or not."""
    e = stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lower(F.trim("event_type")), F.lit(":"), F.floor(F.expr(K) / 25).cast("int").cast("string")).alias("term"))
    out = jobs.run_to_table(jobs.term_counts(e, "6 hours", "1 day", "1 day"), "trends", "update", keep_epoch=True)
    newest = out.groupBy("start", "term").agg(F.max_by("n", "epoch").alias("n"))
    return newest.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "term", "n")


@register("stream_dedup", f"SELECT count(DISTINCT concat(event_type, {K})) AS kept FROM events")
def stream_dedup(spark, d):
    """Event fingerprints, each once."""
    e = stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", F.expr(K).cast("string")).alias("fingerprint"))
    out = jobs.run_to_table(jobs.first_seen(e, "fingerprint", "60 days"), "dedup")
    return out.agg(F.count("*").alias("kept"))


def timed(spark, d, name, when, *columns):
    """A table's rows with ts, and its milliseconds first, for streams in order of event time."""
    ship_package(spark)
    ts = F.col(when).cast("timestamp")
    return table(spark, d, name).select(ts.alias("ts"), F.expr(f"unix_millis(cast({when} as timestamp))").alias("ms"), *columns)


#: Slices that events arrive in, up to so many seconds late.
SLICES, LATE = 3, 3600


@register("stream_rate_limit")
def stream_rate_limit(spark, d):
    """Calls of a user in windows of a day from the first call; 5 are allowed. Calls arrive late and out of order."""
    calls = timed(spark, d, "events", "ts", "user_id", "event_id")
    return ordered.run_slices(ordered.arriving(calls, "event_id", LATE, SLICES), lambda s: ordered.rate_limit(s, 5, DAY), "limits")


@register("stream_health")
def stream_health(spark, d):
    """Moving means, failures and health of sources, after their last runs."""
    status = F.when(F.col("o_orderstatus") == "O", "failed").when(F.col("o_orderstatus") == "F", "success").otherwise("partial")
    found = (F.col("o_orderkey") % 50).cast("double")
    runs = timed(spark, d, "orders", "o_orderdate", (F.col("o_orderkey") % 10).alias("source_id"), F.col("o_orderkey").alias("id"), found.alias("found"), status.alias("status"))
    slices = ordered.arriving(runs.withColumnRenamed("ms", "started_ms"), "id", LATE, SLICES)
    after = ordered.run_slices(slices, ordered.source_health, "health")
    last = after.groupBy("source_id").agg(F.max_by(F.struct("mean", "failures", "status"), "at").alias("last"))
    return last.select("source_id", "last.*")


def logins(spark, d):
    """Events as attempts to log in; a third of them is right."""
    tries = timed(spark, d, "events", "ts", "user_id", "event_id", (F.expr(K) % 3 == 0).alias("ok"))
    return ordered.arriving(tries, "event_id", LATE, SLICES)


@register("stream_lockout")
def stream_lockout(spark, d):
    """What becomes of logins when three failures in a row lock a user for two days."""
    return ordered.run_slices(logins(spark, d), lambda s: ordered.lockouts(s, 3, 2 * DAY), "lockouts")


@register("stream_account_lock")
def stream_account_lock(spark, d):
    """What becomes of logins by the service's own rule: five failures in a row lock an account for a quarter of an hour."""
    return ordered.run_slices(logins(spark, d), ordered.lockouts, "locks")


def commands(spark, d):
    """Events as commands to the queues of ten domains: views and signups bring jobs (signups more urgent ones), clicks ask for work,
    purchases end it well and errors badly."""
    k, kinds = F.expr(K), F.array(*[F.lit(x) for x in ordered.RETRIES])
    command = F.when(F.col("event_type") == "click", "pull").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").otherwise("enqueue")
    return timed(
        spark, d, "events", "ts", F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("domain"), command.alias("command"),
        F.concat(F.get(kinds, k % 5), F.lit(":"), k.cast("string")).alias("job"), F.get(kinds, k % 5).alias("kind"), (k % 7).cast("long").alias("source"),
        F.when(F.col("event_type") == "signup", 7200).otherwise(0).cast("long").alias("priority"), (k % 4 * 600_000).cast("long").alias("delay_ms"),
        F.pmod(F.floor(F.col("user_id") / 10), F.lit(3)).cast("long").alias("worker"),
    )


@register("stream_job_log")
def stream_job_log(spark, d):
    """What happens to each job of the queues, in leases of an hour and locks of two, two jobs at once in a domain."""
    slices = ordered.arriving(commands(spark, d), "seq", LATE, SLICES)
    return ordered.run_slices(slices, lambda s: ordered.job_queue(s, 2, 3_600_000, 7_200_000), "queue")


@register("stream_silent_jobs")
def stream_silent_jobs(spark, d):
    """Jobs (users) without a sign of life for two days: each silence once, when it becomes known."""
    beats = timed(spark, d, "events", "ts", F.col("user_id").alias("job_id"), "event_id")
    return ordered.run_slices(ordered.arriving(beats, "event_id", LATE, SLICES), lambda s: ordered.silences(s, 2 * DAY), "silent")


@register("stream_dead_letters", f"SELECT count(*) FILTER (WHERE {K} % 8 < 3) AS done, count(*) FILTER (WHERE {K} % 8 >= 3) AS dead, sum(CASE WHEN {K} % 8 < 3 THEN {K} % 8 + 1 ELSE 0 END) AS attempts FROM events")
def stream_dead_letters(spark, d):
    """Micro-batches whose rows get three tries; what never succeeds goes to the dead letters. A row here succeeds at the try
    that its number names."""
    from eventloom.session import fresh_path

    done, dead, state = (fresh_path(spark, n) for n in ("done", "dead", "dead-state"))

    def put(batch, epoch):
        work = lambda k: F.struct((F.col("k") % 8 <= k).alias("ok"), F.col("k").alias("value"))
        jobs.with_retries(batch, work, 3, f"{dead}/epoch={epoch}").write.mode("overwrite").parquet(f"{done}/epoch={epoch}")

    e = stream(spark, d, "events").select("event_id", F.expr(K).alias("k"))
    e.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    good = spark.read.schema("event_id long, k int, value int, attempts int").option("recursiveFileLookup", "true").parquet(done)
    bad = spark.read.schema("event_id long, k int, attempts int").option("recursiveFileLookup", "true").parquet(dead)
    a, b = good.agg(F.count("*").alias("done"), F.sum("attempts").alias("attempts")), bad.agg(F.count("*").alias("dead"))
    return a.select("done", b.scalar().alias("dead"), "attempts")


@register("changed_since", f"SELECT event_id AS id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-29 12:00:00'")
def changed_since(spark, d):
    """Rows changed after the last poll's newest one."""
    return table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")).select(F.col("event_id").alias("id"), "event_type")
