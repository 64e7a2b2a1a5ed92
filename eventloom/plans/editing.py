"""What editors see and do: suggested actions, bulk actions, id lists, job streams, selectors for a value."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.plans.fields import made
from eventloom.plans.views import K, ctes, view
from eventloom.session import fresh_path, ship_package, table
from eventloom.streaming import jobs

CRAWL, CRAWLED = "coalesce(booking_url, '') <> '' AND id % 4 <> 0", "id % 4 = 0"
#: The actions in order, each with what calls for it, as tests that both engines read.
ACTIONS = {
    "crawl_address": f"address IS NULL AND {CRAWL}", "ai_datetime": "start_datetime IS NULL", "ai_summary": "coalesce(length(description_short), 0) < 50", "crawl_images": f"n_images = 0 AND {CRAWL}",
    "confirm_geocode": "address IS NOT NULL AND coalesce(lat, 0) = 0", "generate_summary": "description_long IS NULL",
}


@register("suggested_actions", ctes("catalog") + "SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in ACTIONS.items()) + ") AS actions FROM catalog")
def suggested_actions(spark, d):
    """What could be done next for each event; the long description stands for the AI's summary."""
    return view(spark, d, "catalog").select("id", F.concat_ws(",", *[F.when(F.expr(t), n) for n, t in ACTIONS.items()]).alias("actions"))


BULK = "bulk AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'publish' ELSE 'ai_rerun' END AS action FROM events)"


@register("bulk_actions", ctes("catalog", more=BULK + ", c AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'rejected' ELSE status END AS status FROM catalog)") + "SELECT c.id, CASE action WHEN 'reject' THEN 'rejected' WHEN 'publish' THEN CASE WHEN status = 'rejected' THEN status ELSE 'published' END WHEN 'ai_rerun' THEN 'pending_ai' ELSE status END AS status, CASE WHEN action = 'reject' THEN 'Bulk reject: score < 30' END AS rejection_reason, CASE WHEN action = 'publish' AND status = 'rejected' THEN 'Already rejected' WHEN action = 'publish' THEN 'Published' WHEN action = 'reject' THEN 'Rejected' WHEN action = 'ai_rerun' THEN 'Queued' END AS message FROM c LEFT JOIN bulk b ON b.id = c.id")
def bulk_actions(spark, d):
    """Reject, publish (rejected ones stay) and run again, for lists of events."""
    b = made(spark, d, BULK, "bulk", "events").withColumnRenamed("id", "bid")
    c = view(spark, d, "catalog").select("id", F.when(F.col("id") % 7 == 0, "rejected").otherwise(F.col("status")).alias("status"))
    x, a, was = c.join(b, F.col("bid") == F.col("id"), "left"), F.col("action"), F.col("status")
    status = F.when(a == "reject", "rejected").when((a == "publish") & (was != "rejected"), "published").when(a == "ai_rerun", "pending_ai").otherwise(was)
    message = F.when((a == "publish") & (was == "rejected"), "Already rejected").when(a == "publish", "Published").when(a == "reject", "Rejected").when(a == "ai_rerun", "Queued")
    return x.select("id", status.alias("status"), F.when(a == "reject", "Bulk reject: score < 30").alias("rejection_reason"), message.alias("message"))


@register("id_list", ctes("catalog") + "SELECT id, title FROM catalog WHERE id IN (SELECT event_id FROM events WHERE event_type = 'click')")
def id_list(spark, d):
    """Events of a list of ids, which is a table of its own."""
    ids = table(spark, d, "events").where("event_type = 'click'").select("event_id").distinct()
    return view(spark, d, "catalog").join(ids, F.col("event_id") == F.col("id"), "left_semi").select("id", "title")


@register("stream_job_queue", f"SELECT count(*) AS jobs, count(*) FILTER (WHERE k % 6 < 3) AS done, count(*) FILTER (WHERE k % 6 >= 3) AS dead FROM (SELECT DISTINCT {K} AS k, event_type FROM events)")
def stream_job_queue(spark, d):
    """Jobs that arrive again under the same key within the watermark run once; what fails three times is a dead letter."""
    done, dead, state = (fresh_path(spark, n) for n in ("jobs-done", "jobs-dead", "jobs-state"))

    def put(batch, epoch):
        work = lambda n: F.struct((F.col("k") % 6 <= n).alias("ok"), F.col("k").alias("value"))
        jobs.with_retries(batch, work, 3, f"{dead}/epoch={epoch}").write.mode("overwrite").parquet(f"{done}/epoch={epoch}")

    e = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    keyed = e.select(F.col("ts").cast("timestamp").alias("ts"), F.expr(K).alias("k"), F.concat("event_type", F.expr(K).cast("string")).alias("key"))
    jobs.first_seen(keyed, "key", "60 days").writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    read = lambda path, more="": spark.read.schema(f"ts timestamp, k int, key string{more}, attempts int").option("recursiveFileLookup", "true").parquet(path)
    a, b = read(done, ", value int").agg(F.count("*").alias("done")), read(dead).agg(F.count("*").alias("dead"))
    return a.select((F.col("done") + b.scalar()).alias("jobs"), "done", b.scalar().alias("dead"))


@register("selector_suggest", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '#o' WHEN 1 THEN '[itemprop=\"location\"]' WHEN 2 THEN 'p.wo' ELSE 'div b' END AS css FROM pages")
def selector_suggest(spark, d):
    """A selector for the element that holds a value, which an editor has marked on a page."""
    ship_package(spark)
    boxes = ['<div><p id="o">Haus am See</p><p>mehr</p></div>', '<p>x</p><span itemprop="location">Haus am See</span>', '<p class="alt">y</p><p class="alt wo">Haus am See</p>', '<b>nein</b><div><b>Haus am See</b></div>']
    html = F.coalesce(*[F.when(F.col("page_id") % 4 == k, b) for k, b in enumerate(boxes)])

    def run(batches):
        from eventloom.sources import dom

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([dom.suggest(dom.parse(h), "Haus am See") for h in b.column("html").to_pylist()], pa.string())], ["page_id", "css"])

    pages = table(spark, d, "pages").select("page_id", html.alias("html"))
    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, css string")
