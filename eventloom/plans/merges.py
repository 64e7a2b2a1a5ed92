"""Merges, change sets and deletions over all the fields and tables that they have."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.operators import merge
from eventloom.plans.views import ctes, view
from eventloom.session import table

#: The fields that a worker merges, and those that an editor may change.
WORKER_FIELDS = ["title", "description_short", "description_long", "start_datetime", "end_datetime", "location_address", "location_lat", "location_lng", "price_type", "price_min", "price_max", "age_min", "age_max", "is_indoor", "is_outdoor", "booking_url", "contact_email", "contact_phone", "image_urls"]
EDITABLE = ["title", "description_short", "description_long", "start_datetime", "end_datetime", "is_all_day", "location_address", "location_district", "location_lat", "location_lng", "price_type", "price_min", "price_max", "age_min", "age_max", "is_indoor", "is_outdoor", "booking_url", "contact_email", "contact_phone", "image_urls"]
COLUMN = {"location_address": "address", "location_district": "district", "location_lat": "lat", "location_lng": "lng", "image_urls": "CASE WHEN n_images > 0 THEN concat('i', n_images) ELSE '' END", "is_all_day": "(id % 31 = 0)"}
_of = lambda fields, shift=0: ", ".join(f"{COLUMN.get(f, f)} AS {f}" for f in fields)


def pair(fields):
    """Two versions of each event, the second of a neighbour's values, as SQL that both engines read."""
    return f"olds AS (SELECT id, id % 4 AS rank, {_of(fields)} FROM catalog), news AS (SELECT id - 1 AS id, id % 3 AS rank, {_of(fields)} FROM catalog)"


def both(spark, d, fields):
    c = view(spark, d, "catalog")
    each = [F.expr(COLUMN.get(f, f)).alias(f) for f in fields]
    return c.select("id", (F.col("id") % 4).alias("rank"), *each), c.select((F.col("id") - 1).alias("id"), (F.col("id") % 3).alias("rank"), *each)


_empty = lambda c: f"({c} IS NULL OR CAST({c} AS VARCHAR) = '')"


@register("worker_merge", ctes("catalog", more=pair(WORKER_FIELDS)) + "SELECT o.id, " + ", ".join(f"CASE WHEN {_empty('n.' + f)} THEN o.{f} WHEN {_empty('o.' + f)} OR n.rank < o.rank THEN n.{f} ELSE o.{f} END AS {f}" for f in WORKER_FIELDS) + ", concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_empty('n.' + f)} AND NOT {_empty('o.' + f)} AND n.rank = o.rank AND o.{f} <> n.{f} THEN '{f}' END" for f in WORKER_FIELDS) + ") AS conflicts FROM olds o JOIN news n ON n.id = o.id")
def worker_merge(spark, d):
    return merge.worker_merge_all(*both(spark, d, WORKER_FIELDS), WORKER_FIELDS)


@register("edit_changeset", ctes("catalog", more=pair(EDITABLE)) + "SELECT o.id, concat_ws(',', " + ", ".join(f"CASE WHEN n.{f} IS NULL THEN NULL WHEN o.{f} IS NULL THEN '+{f}' WHEN o.{f} <> n.{f} THEN '{f}' END" for f in EDITABLE) + ") AS changed FROM olds o JOIN news n ON n.id = o.id")
def edit_changeset(spark, d):
    """Which of all editable fields an edit adds (+) or changes; fields that it doesn't give stay."""
    old, new = both(spark, d, EDITABLE)
    x = merge.changes(old, new, "id", EDITABLE).where("kind <> 'unchanged'")
    at = F.array_position(F.array(*map(F.lit, EDITABLE)), F.col("field"))
    named = F.concat(F.when(F.col("kind") == "added", "+").otherwise(""), "field")
    g = x.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), named.alias("n")))), lambda s: s["n"]), ",").alias("c"))
    return old.join(new.select("id"), "id").select("id").join(g, "id", "left").select("id", F.coalesce("c", F.lit("")).alias("changed"))


KINDS = "CASE source_id % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'manual' WHEN 2 THEN 'api' ELSE 'scraper' END"
VALUES = f"vals AS (SELECT event_id, 'raw_hash' AS field, position AS seq, {KINDS} AS source, raw_hash AS value FROM raw_item UNION ALL SELECT event_id, 'status', position, {KINDS}, ingest_status FROM raw_item), known AS (SELECT id AS event_id, 'status' AS field, 'editor' AS source FROM catalog WHERE id % 3 = 0)"


@register("conflict_winners", ctes("raw_item", "catalog", more=VALUES) + "SELECT v.event_id, v.field, n_values, coalesce(k.source, first) AS winner, (k.source IS NOT NULL) AS resolved FROM (SELECT event_id, field, count(DISTINCT value) AS n_values, arg_min(source, (seq, source)) AS first FROM vals WHERE value <> '' GROUP BY event_id, field HAVING count(*) >= 2 AND count(DISTINCT value) > 1) v LEFT JOIN known k ON k.event_id = v.event_id AND k.field = v.field")
def conflict_winners(spark, d):
    r = view(spark, d, "raw_item")
    own = lambda f, c: r.select("event_id", F.lit(f).alias("field"), F.col("position").alias("seq"), F.expr(KINDS).alias("source"), F.col(c).alias("value"))
    known = view(spark, d, "catalog").where("id % 3 = 0").select(F.col("id").alias("event_id"), F.lit("status").alias("field"), F.lit("editor").alias("source"))
    return merge.conflict_winners(own("raw_hash", "raw_hash").union(own("status", "ingest_status")), known)


OWNED = {"event_category": ("event_category", "event_id"), "event_score": ("scores", "event_id"), "raw_item": ("raw_item", "event_id"), "event": ("catalog", "id"), "saved": ("events", "event_id"), "plan_slot": ("events", "event_id"), "revision": ("events", "event_id"), "amenity": ("event_category", "event_id"), "event_source": ("raw_item", "event_id")}
WHERE = {"saved": "event_type = 'purchase'", "plan_slot": "event_type = 'click'", "revision": "event_type = 'error'", "amenity": "slug LIKE '%a%'", "event_source": "position = 1"}
GONE = "gone AS (SELECT id FROM catalog WHERE is_cancelled)"


@register("cascade_tables", ctes("event_category", "scores", "raw_item", "catalog", more=GONE) + " UNION ALL ".join(f"SELECT '{n}' AS tbl, count(*) AS kept FROM {t} WHERE {WHERE.get(n, 'true')} AND {k} NOT IN (SELECT id FROM gone)" for n, (t, k) in OWNED.items()))
def cascade_tables(spark, d):
    """What is left in all nine tables that belong to events when the cancelled ones are deleted."""
    read = lambda n, t: (table(spark, d, t) if t == "events" else view(spark, d, t)).where(WHERE.get(n, "true"))
    gone = view(spark, d, "catalog").where("is_cancelled").select("id")
    kept = merge.cascade({n: (read(n, t), k) for n, (t, k) in OWNED.items()}, gone)
    out = None
    for n, df in kept.items():
        one = df.agg(F.lit(n).alias("tbl"), F.count("*").alias("kept"))
        out = one if out is None else out.union(one)
    return out


@register("source_delete", ctes("source", "catalog") + "SELECT s.id, CASE WHEN n > 0 THEN 'disabled' ELSE 'deleted' END AS action FROM source s LEFT JOIN (SELECT source_id, count(*) AS n FROM catalog WHERE id % 3 = 0 GROUP BY source_id) c ON c.source_id = s.id WHERE s.id % 2 = 0")
def source_delete(spark, d):
    """Deleting a source that still has events only disables it."""
    n = view(spark, d, "catalog").where("id % 3 = 0").groupBy("source_id").agg(F.count("*").alias("n"))
    return view(spark, d, "source").where("id % 2 = 0").join(n, F.col("source_id") == F.col("id"), "left").select("id", F.when(F.col("n") > 0, "disabled").otherwise("deleted").alias("action"))


@register("job_delay", ctes("job") + "SELECT id, least(5.0 * power(2, greatest(attempts, 1) - 1), 60.0) AS least_s, 1.5 * least(5.0 * power(2, greatest(attempts, 1) - 1), 60.0) AS most_s, true AS inside FROM job")
def job_delay(spark, d):
    """When a job is tried again: doubling up to a minute, plus up to half of it by chance; the bounds and whether it is inside."""
    base = F.least(F.lit(5.0) * F.pow(F.lit(2.0), F.greatest("attempts", F.lit(1)) - 1), F.lit(60.0))
    x = view(spark, d, "job").select("id", base.alias("least_s"), (base * 1.5).alias("most_s"), (base * (1 + F.rand(7) * 0.5)).alias("delay"))
    return x.select("id", "least_s", "most_s", F.col("delay").between(F.col("least_s"), F.col("most_s")).alias("inside"))


PRICES = [("model-view", 0.00015, 0.0006), ("model-cl", 0.0025, 0.01), ("default", 0.0001, 0.0004)]
_price = lambda k: f"CASE WHEN model = 'model-view' THEN {PRICES[0][k]} WHEN contains(model, 'model-cl') THEN {PRICES[1][k]} ELSE {PRICES[2][k]} END"


@register("model_cost", ctes("usage_log") + f"SELECT id, round(input_tokens / 1000 * CAST({_price(1)} AS DOUBLE) + output_tokens / 1000 * CAST({_price(2)} AS DOUBLE), 9) AS cost FROM usage_log")
def model_cost(spark, d):
    """What calls cost: by the model's name, else by the first listed name that is part of it or that it is part of, else the default."""
    names = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).cast("double").alias("i"), F.lit(o).cast("double").alias("o")) for n, i, o in PRICES[:2]])
    model = F.lower("model")
    exact = F.try_element_at(F.filter(names, lambda p: p["n"] == F.col("model")), F.lit(1))
    partial = F.try_element_at(F.filter(names, lambda p: F.contains(model, p["n"]) | F.contains(p["n"], model)), F.lit(1))
    default = F.struct(F.lit("default").alias("n"), F.lit(PRICES[2][1]).cast("double").alias("i"), F.lit(PRICES[2][2]).cast("double").alias("o"))
    x = view(spark, d, "usage_log").withColumn("p", F.coalesce(exact, partial, default))
    return x.select("id", F.round(F.col("input_tokens") / 1000 * F.col("p.i") + F.col("output_tokens") / 1000 * F.col("p.o"), 9).alias("cost"))


STAGES = {"custom": 0.95, "structured": 0.90, "heuristic": 0.60, "ai": 0.70}
FROM = {"title": ["CASE WHEN id % 5 = 0 THEN title END", "CASE WHEN id % 3 = 0 THEN concat('S', id) END", "CASE WHEN id % 2 = 0 THEN concat('H', id) END", "concat('A', id)"], "place": ["CASE WHEN id % 7 = 0 THEN venue_name END", "district", "address", "CASE WHEN id % 4 = 0 THEN 'AI' END"], "email": ["contact_email", "CASE WHEN id % 6 = 0 THEN 's@x.de' END", "CASE WHEN id % 10 = 0 THEN 'h@x.de' END", "CASE WHEN id % 11 = 0 THEN 'a@x.de' END"]}


@register("stage_fields", ctes("catalog") + " UNION ALL ".join(f"SELECT id, '{f}' AS field, coalesce({', '.join(cs)}) AS value, CASE " + " ".join(f"WHEN {c} IS NOT NULL THEN '{s}'" for s, c in zip(STAGES, cs)) + " END AS stage, CAST(CASE " + " ".join(f"WHEN {c} IS NOT NULL THEN {v}" for v, c in zip(STAGES.values(), cs)) + f" END AS DOUBLE) AS confidence FROM catalog WHERE coalesce({', '.join(cs)}) IS NOT NULL" for f, cs in FROM.items()))
def stage_fields(spark, d):
    """Each field's value from the first stage that has one, with the stage's confidence."""
    first = lambda cs: F.coalesce(*[F.when(F.expr(c).isNotNull(), F.struct(F.expr(c).alias("value"), F.lit(s).alias("stage"), F.lit(v).alias("confidence"))) for (s, v), c in zip(STAGES.items(), cs)])
    each = F.array_compact(F.array(*[F.when(first(cs).isNotNull(), F.struct(F.lit(f).alias("field"), first(cs)["value"].alias("value"), first(cs)["stage"].alias("stage"), first(cs)["confidence"].alias("confidence"))) for f, cs in FROM.items()]))
    return view(spark, d, "catalog").select("id", F.inline(each))
