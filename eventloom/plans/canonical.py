"""Creating, ingesting and changing canonical events."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.operators import canonical as C
from eventloom.plans.views import CATALOG_NOW, NOW, ctes, view

KIND = "CASE WHEN price_type IN ('free', 'paid', 'range', 'unknown', 'donation') THEN price_type ELSE 'unknown' END"
#: A new event in SQL, in three steps: price kind, what the AI may fill, the row.
CREATED = f"""k0 AS (SELECT *, {KIND} AS k FROM candidate), k1 AS (SELECT *, CASE WHEN k = 'unknown' AND price_min = 0 THEN 'free' WHEN k = 'unknown' AND price_min IS NOT NULL THEN 'paid' ELSE k END AS kind FROM k0),
    k2 AS (SELECT *, (price_min IS NULL OR kind = 'unknown') AND coalesce(ai_price_type, '') <> '' AND price_conf >= 0.7 AS asks, coalesce(venue_conf >= 0.7, false) AND coalesce(ai_venue, '') <> '' AS named FROM k1),
    made AS (SELECT id, source_type, title, nullif(description[1:500], '') AS description_short, nullif(description, '') AS description_long,
    CASE WHEN start_at IS NOT NULL THEN start_at WHEN dt_conf >= 0.7 THEN ai_start END AS start_datetime, CASE WHEN end_at IS NOT NULL THEN end_at WHEN dt_conf >= 0.7 THEN ai_end END AS end_datetime,
    CASE WHEN coalesce(address, '') <> '' THEN address WHEN loc_conf >= 0.7 AND coalesce(ai_address, '') <> '' THEN ai_address WHEN named THEN nullif(ai_line, '') END AS location_address,
    CASE WHEN coalesce(address, '') = '' AND loc_conf >= 0.7 AND coalesce(ai_address, '') <> '' THEN nullif(ai_district, '') END AS location_district,
    CASE WHEN coalesce(lat, 0) <> 0 THEN lat WHEN geo_lat <> 0 THEN geo_lat END AS location_lat, CASE WHEN coalesce(lng, 0) <> 0 THEN lng WHEN geo_lng <> 0 THEN geo_lng END AS location_lng,
    CASE WHEN coalesce(venue_name, '') <> '' THEN venue_name WHEN named THEN ai_venue END AS venue_name, CASE WHEN coalesce(city, '') <> '' THEN city WHEN named THEN nullif(ai_city, '') END AS city, CASE WHEN coalesce(postal_code, '') <> '' THEN postal_code WHEN named THEN nullif(ai_postal, '') END AS postal_code, 'DE' AS country_code,
    CASE WHEN asks AND ai_price_type IN ('free', 'donation') THEN 0.0 WHEN asks AND ai_price_min IS NOT NULL THEN ai_price_min ELSE price_min END AS price_min,
    CASE WHEN asks AND ai_price_type NOT IN ('free', 'donation') AND ai_price_min IS NOT NULL AND ai_price_max IS NOT NULL THEN ai_price_max ELSE price_max END AS price_max,
    CASE WHEN asks AND ai_price_type IN ('free', 'donation') THEN ai_price_type WHEN asks AND ai_price_min IS NOT NULL THEN 'paid' ELSE kind END AS price_type,
    CASE WHEN age_min > 0 THEN age_min WHEN ai_age_min > 0 THEN ai_age_min END AS age_min, CASE WHEN age_max > 0 THEN age_max WHEN ai_age_max > 0 THEN ai_age_max END AS age_max,
    coalesce(is_indoor, false) OR coalesce(ai_indoor, false) AS is_indoor, coalesce(is_outdoor, false) AS is_outdoor, nullif(booking_url, '') AS booking_url, CASE WHEN availability_status IS NOT NULL THEN availability_status WHEN ai_cancelled THEN 'cancelled' END AS availability_status FROM k2)"""


@register("create_canonical", ctes("candidate") + ", " + CREATED + " SELECT * FROM made")
def create_canonical(spark, d):
    return C.create(view(spark, d, "candidate"))


FIELDS = "title description_short description_long start_datetime end_datetime location_address location_district location_lat location_lng venue_name city postal_code country_code price_min price_max price_type age_min age_max is_indoor is_outdoor booking_url availability_status".split()
BY_AI = {
    "venue_name": "sv AND coalesce(c.venue_name, '') = '' AND coalesce(ai_venue, '') <> ''", "city": "sv AND coalesce(c.city, '') = '' AND coalesce(ai_city, '') <> ''", "postal_code": "sv AND coalesce(c.postal_code, '') = '' AND coalesce(ai_postal, '') <> ''",
    "price_min": "price_conf >= 0.7 AND (c.price_min IS NULL OR m.price_type = 'unknown')", "price_type": "price_conf >= 0.7 AND (c.price_min IS NULL OR m.price_type = 'unknown')",
    "location_address": "coalesce(c.address, '') = '' AND ((sv AND coalesce(ai_line, '') <> '') OR coalesce(ai_address, '') <> '')", "start_datetime": "dt_conf >= 0.7 AND start_at IS NULL AND ai_start IS NOT NULL", "end_datetime": "dt_conf >= 0.7 AND end_at IS NULL AND ai_end IS NOT NULL",
}
_ai = lambda f: f"(has_ai AND ({BY_AI[f]}))" if f in BY_AI else "false"
_from = lambda f: f"CASE WHEN {_ai(f)} THEN 'ai' ELSE c.source_type END"
_sure = {"location_address": "coalesce(venue_conf, 0.7)", "start_datetime": "dt_conf", "end_datetime": "dt_conf"}
_told = lambda f: f"concat('{f}=', CASE WHEN m.{f} IS NULL THEN 'missing' ELSE concat('filled:', {_from(f)}) END, CASE WHEN {_ai(f)} THEN concat('@', CAST(round(CAST({_sure[f]} AS DOUBLE), 3) AS VARCHAR)) ELSE '' END)"


@register("initial_provenance", ctes("candidate") + ", " + CREATED + ", c AS (SELECT *, coalesce(venue_conf >= 0.7, false) AS sv FROM candidate) SELECT c.id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN m.{f} IS NOT NULL THEN concat('{f}=', {_from(f)}) END" for f in FIELDS) + "], lambda x: x IS NOT NULL)), ',') AS provenance, concat_ws(',', 'ai_summary_short=missing', " + ", ".join(_told(f) for f in ("end_datetime", "location_address", "start_datetime")) + ") AS fill_status FROM c JOIN made m ON m.id = c.id")
def initial_provenance(spark, d):
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return C.provenance(view(spark, d, "candidate")).select("id", text("provenance").alias("provenance"), text("fill_status").alias("fill_status"))


CITY, PLACEHOLDER = C.CITY_ONLY, C.ADDRESS_PLACEHOLDER


@register("apply_ai_result", ctes("candidate") + f""", x AS (SELECT *, model = 'fallback' AS fb, CASE WHEN start_at IS NOT NULL THEN start_at WHEN dt_conf >= 0.7 THEN ai_start END AS st, trim(coalesce(address, '')) AS cur, trim(coalesce(ai_address, '')) AS off, CASE WHEN fit < 30 THEN 'rejected' WHEN confidence >= 0.8 AND fit >= 50 THEN 'published' ELSE 'pending_review' END AS s0,
    price_conf >= 0.7 AND coalesce(ai_price_type, '') <> '' AND (price_type IS NULL OR price_type = 'unknown') AS pr FROM candidate WHERE has_ai)
    SELECT id, CASE WHEN fb THEN 'pending_ai' WHEN s0 = 'published' AND st IS NULL THEN 'incomplete' WHEN s0 = 'published' AND st < TIMESTAMP '{CATALOG_NOW}' THEN 'archived' ELSE s0 END AS status, CASE WHEN fb THEN start_at ELSE st END AS start_datetime, CASE WHEN fb OR end_at IS NOT NULL THEN end_at WHEN dt_conf >= 0.7 THEN ai_end END AS end_datetime,
    CASE WHEN NOT fb AND loc_conf >= 0.7 AND (cur = '' OR length(cur) < 20 OR regexp_matches(cur, '{CITY}')) AND off <> '' AND NOT regexp_matches(regexp_replace(off, '\\s+', ' ', 'g'), '{PLACEHOLDER}') AND (regexp_matches(off, '[0-9]') OR contains(off, ',')) THEN off ELSE address END AS location_address,
    CASE WHEN NOT fb AND loc_conf >= 0.7 THEN nullif(ai_district, '') END AS location_district, CASE WHEN NOT fb AND pr THEN lower(ai_price_type) ELSE price_type END AS price_type, CASE WHEN NOT fb AND pr AND ai_price_min IS NOT NULL THEN ai_price_min WHEN NOT fb AND pr AND ai_price_type = 'free' THEN 0 ELSE price_min END AS price_min,
    CASE WHEN NOT fb AND ai_age_min IS NOT NULL THEN ai_age_min ELSE age_min END AS age_min, CASE WHEN NOT fb AND ai_age_max IS NOT NULL THEN ai_age_max ELSE age_max END AS age_max, CASE WHEN NOT fb AND contact_conf >= 0.7 THEN nullif(trim(ai_email), '') END AS contact_email FROM x""")  # fmt: skip
def apply_ai_result(spark, d):
    return C.apply_ai(view(spark, d, "candidate"), CATALOG_NOW)


INGEST = ["description_short", "location_address", "price_type", "price_min", "price_max", "booking_url", "contact_email", "contact_phone", "description_long", "location_district"]
OLD = "old AS (SELECT id, description_short, address AS location_address, price_type, price_min, price_max, booking_url, contact_email, contact_phone, description_long, district AS location_district, source_id % 4 AS priority, CASE WHEN id % 4 = 0 THEN 'price_min,booking_url' WHEN id % 9 = 0 THEN 'contact_email' ELSE '' END AS locks FROM catalog)"
COME = "come AS (SELECT id, 'n' || description AS description_short, address AS location_address, price_type, price_min, price_max, booking_url, CASE WHEN id % 5 = 0 THEN 'new@x.de' END AS contact_email, CASE WHEN id % 7 = 0 THEN '0721' END AS contact_phone, description AS description_long, ai_district AS location_district, source_id % 5 AS priority FROM candidate WHERE id % 3 <> 1)"
_take = lambda f: f"(n.priority <= o.priority AND n.{f} IS NOT NULL AND NOT list_contains(string_split(locks, ','), '{f}'))"


@register("ingest_update", ctes("catalog", "candidate", more=f"{OLD}, {COME}") + "SELECT o.id, CASE WHEN " + " OR ".join(map(_take, INGEST)) + " THEN 'updated' ELSE 'skipped' END AS action, " + " + ".join(f"CASE WHEN {_take(f)} THEN 1 ELSE 0 END" for f in INGEST) + " AS n_fields, " + ", ".join(f"CASE WHEN {_take(f)} THEN n.{f} ELSE o.{f} END AS {f}" for f in INGEST) + " FROM old o JOIN come n ON n.id = o.id")
def ingest_update(spark, d):
    c, n = view(spark, d, "catalog"), view(spark, d, "candidate")
    old = c.select("id", F.col("address").alias("location_address"), F.col("district").alias("location_district"), *[f for f in INGEST if not f.startswith("location")], (F.col("source_id") % 4).alias("priority"), F.split(F.when(F.col("id") % 4 == 0, "price_min,booking_url").when(F.col("id") % 9 == 0, "contact_email").otherwise(""), ",").alias("locked"))
    new = n.where("id % 3 <> 1").select("id", F.concat(F.lit("n"), "description").alias("description_short"), F.col("address").alias("location_address"), "price_type", "price_min", "price_max", "booking_url", F.when(F.col("id") % 5 == 0, "new@x.de").alias("contact_email"), F.when(F.col("id") % 7 == 0, "0721").alias("contact_phone"), F.col("description").alias("description_long"), F.col("ai_district").alias("location_district"), (F.col("source_id") % 5).alias("priority"))
    return C.ingest_update(old, new, INGEST)


EDITED = ["title", "price_min", "age_min", "is_indoor", "status"]
EDITS = "edits AS (SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'title' WHEN 1 THEN 'price_min' WHEN 2 THEN 'age_min' WHEN 3 THEN 'is_indoor' WHEN 4 THEN 'owner' WHEN 5 THEN 'price_min' ELSE 'status' END AS field, CASE event_id % 7 WHEN 0 THEN concat('T', event_id) WHEN 1 THEN '12.5' WHEN 2 THEN '3' WHEN 3 THEN 'true' WHEN 5 THEN '' ELSE 'x' END AS value, user_id, CASE WHEN event_id % 2 = 0 THEN 'why' ELSE '' END AS reason FROM events)"


def edits(spark, d):
    from eventloom.session import table

    return spark.sql(EDITS.replace("edits AS (", "").rstrip(")").replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))


@register("manual_override", ctes("catalog", more=EDITS) + "SELECT c.id, CASE WHEN field = 'title' THEN nullif(value, '') ELSE title END AS title, CASE WHEN field = 'price_min' THEN TRY_CAST(nullif(value, '') AS DOUBLE) ELSE price_min END AS price_min, CASE WHEN field = 'age_min' THEN TRY_CAST(value AS INT) ELSE age_min END AS age_min, CASE WHEN field = 'is_indoor' THEN TRY_CAST(value AS BOOLEAN) ELSE is_indoor END AS is_indoor, CASE WHEN field IS NOT NULL THEN concat('manual:', field) END AS provenance FROM catalog c LEFT JOIN (SELECT * FROM edits WHERE field IN ('title', 'price_min', 'age_min', 'is_indoor')) e ON e.id = c.id")
def manual_override(spark, d):
    fields = ["title", "price_min", "age_min", "is_indoor"]
    return C.override(view(spark, d, "catalog"), edits(spark, d), fields)[0].select("id", *fields, "provenance")


@register("override_log", ctes("catalog", more=EDITS) + "SELECT c.id, field, CASE field WHEN 'title' THEN title WHEN 'age_min' THEN CAST(age_min AS VARCHAR) WHEN 'is_indoor' THEN CAST(is_indoor AS VARCHAR) END AS old_value, value, user_id, nullif(reason, '') AS reason FROM catalog c JOIN edits e ON e.id = c.id WHERE field IN ('title', 'age_min', 'is_indoor')")
def override_log(spark, d):
    return C.override(view(spark, d, "catalog"), edits(spark, d), ["title", "age_min", "is_indoor"])[1]


REVISIONS = "revisions AS (SELECT event_id AS id, user_id AS event_id, 'title' AS field, concat('R', event_id) AS new_value, CASE event_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM events), decisions AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'approve' ELSE 'reject' END AS decision FROM events WHERE event_id % 5 < 3)"


@register("revision_review", f"WITH {REVISIONS} SELECT r.id, event_id, field, new_value, CASE WHEN status = 'pending' AND decision = 'approve' THEN 'approved' WHEN status = 'pending' AND decision = 'reject' THEN 'rejected' ELSE status END AS status, (status = 'pending' AND coalesce(decision = 'approve', false)) AS applied, CASE WHEN decision IS NOT NULL AND status <> 'pending' THEN concat('already ', status) END AS error FROM revisions r LEFT JOIN decisions d ON d.id = r.id")
def revision_review(spark, d):
    from eventloom.session import table

    e = table(spark, d, "events")
    r = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("event_id"), F.lit("title").alias("field"), F.concat(F.lit("R"), "event_id").alias("new_value"), F.when(e.event_id % 4 == 0, "approved").when(e.event_id % 4 == 1, "rejected").otherwise("pending").alias("status"))
    return C.review(r, e.where("event_id % 5 < 3").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "approve").otherwise("reject").alias("decision")))


MOVES = "moves AS (SELECT id, id + 1000000 AS new_id, start_datetime + INTERVAL '7' DAY AS new_start, CASE WHEN id % 2 = 0 THEN start_datetime + INTERVAL '8' DAY END AS new_end, CASE WHEN id % 3 = 0 THEN 'rain' ELSE '' END AS reason FROM catalog WHERE id % 5 = 2)"


@register("reschedule", ctes("catalog", more=MOVES) + "SELECT c.id, title, CASE WHEN m.id IS NULL THEN status ELSE 'cancelled' END AS status, (is_cancelled OR m.id IS NOT NULL) AS is_cancelled, start_datetime, end_datetime, CASE WHEN m.id IS NULL THEN rescheduled_to ELSE new_id END AS rescheduled_to, CASE WHEN m.id IS NOT NULL THEN coalesce(nullif(reason, ''), 'Rescheduled') END AS cancellation_reason, CASE WHEN m.id IS NOT NULL THEN start_datetime END AS previous_start FROM catalog c LEFT JOIN moves m ON m.id = c.id UNION ALL SELECT new_id, title, 'pending_review', false, new_start, coalesce(new_end, end_datetime), NULL, NULL, NULL FROM catalog c JOIN moves m ON m.id = c.id")
def reschedule(spark, d):
    c = view(spark, d, "catalog").select("id", "title", "status", "is_cancelled", "start_datetime", "end_datetime", "rescheduled_to")
    moves = c.where("id % 5 = 2").select("id", (F.col("id") + 1000000).alias("new_id"), (F.col("start_datetime") + F.expr("INTERVAL '7' DAY")).alias("new_start"), F.when(F.col("id") % 2 == 0, F.col("start_datetime") + F.expr("INTERVAL '8' DAY")).alias("new_end"), F.when(F.col("id") % 3 == 0, "rain").otherwise("").alias("reason"))
    return C.reschedule(c, moves)


UPDATES = "updates AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' WHEN 3 THEN 'running' WHEN 4 THEN 'failed' END AS new_status, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 9 AS INT) END AS new_found, CASE WHEN event_id % 6 = 4 THEN false END AS needs_attention, CASE event_id % 5 WHEN 0 THEN 'now' WHEN 1 THEN '2024-01-05 10:00:00' END AS finish FROM events)"


@register("run_update", ctes("ingest_run", more=UPDATES) + f"SELECT r.id, coalesce(new_status, status) AS status, coalesce(new_found, events_found) AS events_found, CASE WHEN finish = 'now' THEN TIMESTAMP '{NOW}' WHEN finish IS NOT NULL THEN CAST(finish AS TIMESTAMP) WHEN new_status IN ('success', 'partial', 'failed') THEN TIMESTAMP '{NOW}' END AS finished_at, coalesce(needs_attention, CASE WHEN new_status = 'failed' THEN true END) AS needs_attention FROM ingest_run r LEFT JOIN updates u ON u.id = r.id")
def run_update(spark, d):
    from eventloom.session import table

    u = spark.sql(UPDATES.replace("updates AS (", "").rstrip(")").replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    return C.run_update(view(spark, d, "ingest_run"), u, NOW)


@register("job_create", ctes("job", more="offered AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'crawl' WHEN 1 THEN 'classify' ELSE 'score' END AS type, concat('k', o_orderkey % 400) AS job_key, 'queued' AS status FROM orders)") + "SELECT id, type, concat('k', id % 300) AS job_key, status FROM job UNION ALL SELECT min(id) AS id, type, job_key, 'queued' FROM offered o WHERE NOT EXISTS (SELECT 1 FROM job j WHERE j.type = o.type AND concat('k', j.id % 300) = o.job_key) GROUP BY type, job_key")
def job_create(spark, d):
    """Jobs are made once for each type and key."""
    from eventloom.session import table

    jobs = view(spark, d, "job").select("id", "type", F.concat(F.lit("k"), F.col("id") % 300).alias("job_key"), "status")
    k = F.col("o_orderkey")
    offered = table(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, "crawl").when(k % 3 == 1, "classify").otherwise("score").alias("type"), F.concat(F.lit("k"), k % 400).alias("job_key"), F.lit("queued").alias("status"))
    return C.insert_missing(jobs, offered, ["type", "job_key"])


@register("job_retry", ctes("job") + "SELECT id, type, CASE WHEN status IN ('failed', 'dead') AND id % 4 = 0 THEN 'queued' ELSE status END AS status, CASE WHEN status IN ('failed', 'dead') AND id % 4 = 0 THEN NULL ELSE scheduled_at END AS started_at FROM job")
def job_retry(spark, d):
    """Failed jobs that an operator picks go back to the queue."""
    again = F.col("status").isin("failed", "dead") & (F.col("id") % 4 == 0)
    return view(spark, d, "job").select("id", "type", F.when(again, "queued").otherwise(F.col("status")).alias("status"), F.when(~again, F.col("scheduled_at")).alias("started_at"))


@register("job_cleanup", ctes("job") + f"SELECT id, status FROM job WHERE NOT (status IN ('completed', 'failed') AND scheduled_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY)")
def job_cleanup(spark, d):
    """Without finished jobs that are older than seven days."""
    old = F.col("status").isin("completed", "failed") & (F.col("scheduled_at") < F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL '7' DAY"))
    return view(spark, d, "job").where(~old).select("id", "status")


@register("score_upsert", ctes("scores", "candidate") + "SELECT coalesce(n.id, s.event_id) AS event_id, CASE WHEN n.id IS NOT NULL THEN n.fit ELSE s.family_fit END AS family_fit, CASE WHEN n.id IS NOT NULL THEN CAST(n.confidence * 100 AS BIGINT) ELSE s.relevance END AS relevance FROM scores s FULL JOIN (SELECT * FROM candidate WHERE has_ai AND id % 3 = 0) n ON n.id = s.event_id")
def score_upsert(spark, d):
    new = view(spark, d, "candidate").where("has_ai and id % 3 = 0").select(F.col("id").alias("event_id"), F.col("fit").alias("family_fit"), F.round(F.col("confidence") * 100).cast("long").alias("relevance"))
    return C.upsert(view(spark, d, "scores").select("event_id", "family_fit", "relevance"), new, "event_id")


@register("category_link", ctes("event_category", more="offered AS (SELECT o_orderkey AS event_id, lower(p_type) AS slug FROM orders JOIN part ON p_partkey = o_orderkey % 150)") + "SELECT event_id, slug FROM event_category UNION SELECT event_id, slug FROM offered")
def category_link(spark, d):
    """New links of events and categories; those that are there stay as they are."""
    from eventloom.session import table

    o, p = table(spark, d, "orders"), table(spark, d, "part")
    offered = o.join(p, p.p_partkey == o.o_orderkey % 150).select(o.o_orderkey.alias("event_id"), F.lower("p_type").alias("slug"))
    return C.insert_missing(view(spark, d, "event_category"), offered, ["event_id", "slug"])


AUDITED = ["title", "status", "price_min", "age_min", "contact_email"]


@register("audit_diff", ctes("catalog", "candidate", more="after AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'New' ELSE concat('Candidate ', id) END AS title, CASE WHEN id % 5 = 0 THEN 'published' END AS status, price_min, age_min, CAST(NULL AS VARCHAR) AS contact_email FROM candidate)") + "SELECT c.id, concat_ws(',', " + ", ".join(f"CASE WHEN c.{f} IS DISTINCT FROM a.{f} THEN '{f}' END" for f in AUDITED) + ") AS changed FROM catalog c JOIN after a ON a.id = c.id")
def audit_diff(spark, d):
    """Names of the audited fields that differ; null and a value differ, null and null do not."""
    k = F.col("id")
    after = view(spark, d, "candidate").select(k, F.when(k % 4 == 0, "New").otherwise(F.concat(F.lit("Candidate "), k)).alias("title"), F.when(k % 5 == 0, "published").alias("status"), "price_min", "age_min", F.lit(None).cast("string").alias("contact_email"))
    a = after.select(k, *[F.col(f).alias(f"new_{f}") for f in AUDITED])
    return view(spark, d, "catalog").join(a, "id").select("id", F.concat_ws(",", *[F.when(~F.col(f).eqNullSafe(F.col(f"new_{f}")), f) for f in AUDITED]).alias("changed"))
