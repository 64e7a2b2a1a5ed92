"""Identity, merges, revisions and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.functions import fingerprint as fp
from eventloom.operators import hierarchy, merge, resolve
from eventloom.operators.search import ts
from eventloom.plans.views import CATALOG_NOW, ctes, view
from eventloom.session import ship_package, table

NOW = CATALOG_NOW
DAY = "strftime(start_datetime, '%Y-%m-%d')"
CLEAN = lambda allowed: f"regexp_replace(trim(regexp_replace(lower(title), '[^{allowed}\\s]', '', 'g')), '\\s+', ' ', 'g')"


@register("fingerprints", ctes("catalog") + f"""SELECT id, substr(sha256(concat(trim(lower(title)), '|', {DAY}, '|', substr(coalesce(lower(venue_name), ''), 1, 50))), 1, 32) AS feed, substr(sha256(coalesce(booking_url || '|' || {DAY}, concat({CLEAN('a-z0-9_äöüß')}, '|', {DAY}, '|', substr(coalesce(lower(address), ''), 1, 50)))), 1, 32) AS candidate,
    substr(sha256(concat({CLEAN('A-Za-z0-9_')}, '|', {DAY}, '|', CASE WHEN lat IS NOT NULL THEN printf('%.3f', lat + CASE WHEN lat * 16 = floor(lat * 16) THEN 0.0001 ELSE 0 END) ELSE '' END, '|', CASE WHEN lng IS NOT NULL THEN printf('%.3f', lng + CASE WHEN lng * 16 = floor(lng * 16) THEN 0.0001 ELSE 0 END) ELSE '' END)), 1, 32) AS backend, substr(sha256(concat(title, {DAY})), 1, 32) AS import FROM catalog""")  # fmt: skip
def fingerprints(spark, d):
    c, day = view(spark, d, "catalog"), F.date_format("start_datetime", "yyyy-MM-dd")
    t, s = F.col("title"), F.col("start_datetime")
    return c.select("id", fp.fp_feed(t, s, F.col("venue_name")).alias("feed"), fp.fp_candidate(F.lit(None).cast("string"), F.col("booking_url"), t, s, F.col("address")).alias("candidate"), fp.fp_backend(t, s, F.col("lat"), F.col("lng")).alias("backend"), fp.fp_import(t, day).alias("import"))


@register("fingerprint_dedup")
def fingerprint_dedup(spark, d):
    """Title without stop words, local hour and geohash."""
    return view(spark, d, "catalog").select("id", fp.fp_dedup(F.col("title"), F.col("start_datetime"), F.col("lat"), F.col("lng")).alias("fingerprint"))


@register("fuzzy_match")
def fuzzy_match(spark, d):
    """Each event's first match among all earlier ones: equal fingerprints, else the same day and similar titles."""
    ship_package(spark)
    c = view(spark, d, "catalog").select("id", "title", F.to_date("start_datetime").alias("day"), fp.fp_backend(F.col("title"), F.col("start_datetime"), F.col("lat"), F.col("lng")).alias("fingerprint"))
    return resolve.matches(c, c, earlier=True)


RANK = lambda c: f"CASE {c} WHEN 'manual' THEN 1 WHEN 'partner' THEN 1 WHEN 'provider' THEN 2 WHEN 'api' THEN 3 WHEN 'rss' THEN 4 WHEN 'ics' THEN 4 ELSE 5 END"
SOURCE = lambda k: f"CASE {k} % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'manual' WHEN 2 THEN 'api' ELSE 'scraper' END"


def source_kind(k):
    return F.when(k % 4 == 0, "rss").when(k % 4 == 1, "manual").when(k % 4 == 2, "api").otherwise("scraper")


@register("merge_fields", ctes("catalog") + f"""SELECT id, CASE WHEN locked THEN 'locked' WHEN new IS NULL THEN 'null_value' WHEN old IS NULL THEN 'new_field' WHEN b < a THEN 'source_priority_lower' WHEN a = b THEN 'unchanged' WHEN stale THEN 'stale_data' ELSE 'source_priority_lower' END AS reason,
    (NOT locked AND new IS NOT NULL AND (old IS NULL OR b < a OR (a = b AND old <> new) OR (b > a AND stale))) AS updated FROM (SELECT id, (id % 19 = 0) AS locked, address AS old, CASE WHEN id % 5 <> 0 THEN concat('Street ', id % 7, ', 76131 Karlsruhe') END AS new, {RANK(SOURCE('id'))} AS a, {RANK(SOURCE('(id + id // 4)'))} AS b, (created_at < TIMESTAMP '{NOW}' - INTERVAL '180' DAY) AS stale FROM catalog)""")  # fmt: skip
def merge_fields(spark, d):
    c, k = view(spark, d, "catalog"), F.col("id")
    new = F.when(k % 5 != 0, F.concat(F.lit("Street "), (k % 7).cast("string"), F.lit(", 76131 Karlsruhe")))
    r = merge.decide(F.col("address"), new, source_kind(k), source_kind(k + F.floor(k / 4)), k % 19 == 0, F.col("created_at"), NOW)
    return c.select("id", r.alias("r")).select("id", F.col("r.reason").alias("reason"), F.col("r.update").alias("updated"))


@register("merge_candidates")
def merge_candidates(spark, d):
    """Fold each event's candidates, in order, into two fields with their provenance."""
    c = view(spark, d, "catalog")
    current = c.select("id", "address", "venue_name", F.create_map(F.lit("address"), source_kind(F.col("id"))).alias("provenance"), F.create_map(F.lit("address"), F.col("created_at")).alias("updated_at"), F.when(F.col("id") % 19 == 0, F.array(F.lit("address"))).otherwise(F.array().cast("array<string>")).alias("locked"))
    news = view(spark, d, "raw_item").select(F.col("event_id").alias("id"), F.col("position").alias("seq"), source_kind(F.col("source_id")).alias("source"), F.when(F.col("position") != 3, F.col("source_url")).alias("address"), F.col("raw_hash").alias("venue_name"))
    return merge.merge_fields(current, news, ["address", "venue_name"], NOW)


@register("merge_reasons", ctes("raw_item") + "SELECT coalesce(ingest_status, 'none') AS reason, count(*) AS n FROM raw_item GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def merge_reasons(spark, d):
    r = view(spark, d, "raw_item").groupBy(F.coalesce("ingest_status", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))
    return r.orderBy(F.desc("n"), "reason").limit(10)


@register("upsert_raw", ctes("raw_item") + "SELECT source_id, raw_hash, count(*) AS seen_count FROM raw_item GROUP BY source_id, raw_hash")
def upsert_raw(spark, d):
    """Items of odd runs arrive after those of even runs are stored."""
    r = view(spark, d, "raw_item")
    stored = r.where("run_id % 2 = 0").groupBy("source_id", "raw_hash").agg(F.count("*").alias("seen_count"), F.max("seen_at").alias("last_seen"), F.max("run_id").alias("last_run"))
    return merge.upsert_raw(stored, r.where("run_id % 2 = 1")).select("source_id", "raw_hash", "seen_count")


@register("ingest_action", ctes("raw_item", "catalog") + "SELECT r.id, CASE WHEN c.id IS NULL THEN 'create' WHEN c.source_id = r.source_id % 10 THEN 'update' ELSE 'link' END AS action FROM raw_item r LEFT JOIN catalog c ON c.id = r.event_id AND c.id % 4 <> 0")
def ingest_action(spark, d):
    c = view(spark, d, "catalog").where("id % 4 <> 0").select(F.col("id").alias("cid"), F.col("source_id").alias("own"))
    r = view(spark, d, "raw_item").join(c, F.col("cid") == F.col("event_id"), "left")
    return r.select("id", F.when(F.col("cid").isNull(), "create").when(F.col("own") == F.col("source_id") % 10, "update").otherwise("link").alias("action"))


@register("priority_merge", ctes("catalog") + "SELECT id, CASE WHEN contact_email IS NULL THEN booking_url WHEN booking_url IS NULL THEN contact_email WHEN id % 4 < id % 3 THEN contact_email ELSE booking_url END AS value, coalesce(contact_email IS NOT NULL AND booking_url IS NOT NULL AND NOT id % 4 < id % 3 AND booking_url <> contact_email, false) AS conflict FROM catalog")
def priority_merge(spark, d):
    r = merge.worker_merge(F.col("booking_url"), F.col("contact_email"), F.col("id") % 3, F.col("id") % 4)
    return view(spark, d, "catalog").select("id", r.alias("r")).select("id", F.col("r.value").alias("value"), F.col("r.conflict").alias("conflict"))


@register("deep_fetch_merge", ctes("catalog") + "SELECT id, CASE WHEN length(l) > 1.5 * length(s) OR length(s) < 100 THEN coalesce(l, s) ELSE s END AS description, concat_ws(',', CASE WHEN address IS NULL OR length(address) < 15 THEN 'address' END, CASE WHEN end_datetime IS NULL THEN 'end' END, CASE WHEN price_min IS NULL THEN 'price' END) AS triggers FROM (SELECT *, coalesce(description_short, '') AS s, description_long AS l FROM catalog)")
def deep_fetch_merge(spark, d):
    s, long = F.coalesce("description_short", F.lit("")), F.col("description_long")
    triggers = F.array_compact(F.array(F.when(F.col("address").isNull() | (F.length("address") < 15), F.lit("address")), F.when(F.col("end_datetime").isNull(), F.lit("end")), F.when(F.col("price_min").isNull(), F.lit("price"))))
    return view(spark, d, "catalog").select("id", F.when((F.length(long) > 1.5 * F.length(s)) | (F.length(s) < 100), F.coalesce(long, s)).otherwise(s).alias("description"), F.array_join(triggers, ",").alias("triggers"))


@register("stage_coalesce", ctes("catalog", "scores") + "SELECT id, coalesce(contact_email, booking_url, address, 'ai') AS value, CASE WHEN contact_email IS NOT NULL THEN 'custom' WHEN booking_url IS NOT NULL THEN 'structured' WHEN address IS NOT NULL THEN 'heuristic' ELSE 'ai' END AS stage FROM catalog")
def stage_coalesce(spark, d):
    stages = [("custom", F.col("contact_email")), ("structured", F.col("booking_url")), ("heuristic", F.col("address")), ("ai", F.lit("ai"))]
    first = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(n).alias("stage"))) for n, v in stages])
    return view(spark, d, "catalog").select("id", first.alias("f")).select("id", F.col("f.value").alias("value"), F.col("f.stage").alias("stage"))


FIELDS = ["title", "address", "price_type", "booking_url", "age_rating"]


@register("changeset", ctes("catalog", more="two AS (SELECT a.id, a.title AS title, a.address, a.price_type, a.booking_url, a.age_rating, b.title AS title2, b.address AS address2, b.price_type AS price_type2, b.booking_url AS booking_url2, b.age_rating AS age_rating2 FROM catalog a JOIN catalog b ON b.id = a.id + 1)") + " UNION ALL ".join(f"SELECT id, '{f}' AS field, CASE WHEN {f}2 IS NULL THEN 'unchanged' WHEN {f} IS NULL THEN 'added' WHEN {f} <> {f}2 THEN 'changed' ELSE 'unchanged' END AS kind FROM two" for f in FIELDS))
def changeset(spark, d):
    c = view(spark, d, "catalog").select("id", *FIELDS)
    return merge.changes(c, c.withColumn("id", F.col("id") - 1), "id", FIELDS).select("id", "field", "kind")


@register("revision_conflicts", ctes("catalog") + "SELECT a.id, (a.price_type IS DISTINCT FROM b.price_type) AS conflict FROM catalog a JOIN catalog b ON b.id = a.id + 7 WHERE a.status = 'pending_review'")
def revision_conflicts(spark, d):
    c = view(spark, d, "catalog")
    old = c.select((F.col("id") - 7).alias("rid"), F.col("price_type").alias("expected"))
    return c.where("status = 'pending_review'").join(old, F.col("rid") == F.col("id")).select("id", (~F.col("price_type").eqNullSafe(F.col("expected"))).alias("conflict"))


@register("field_conflicts", ctes("raw_item") + "SELECT event_id, 'raw_hash' AS field, count(DISTINCT raw_hash) AS n_values FROM raw_item GROUP BY event_id HAVING count(*) >= 2 AND count(DISTINCT raw_hash) > 1")
def field_conflicts(spark, d):
    return merge.conflicts(view(spark, d, "raw_item").select("event_id", F.lit("raw_hash").alias("field"), F.col("raw_hash").alias("value")))


@register("cascade_delete", ctes("catalog", "event_category") + "SELECT 'category' AS tbl, count(*) AS kept FROM event_category WHERE event_id NOT IN (SELECT id FROM catalog WHERE is_cancelled) UNION ALL SELECT 'event', count(*) FROM catalog WHERE NOT is_cancelled")
def cascade_delete(spark, d):
    c = view(spark, d, "catalog")
    kept = merge.cascade({"category": (view(spark, d, "event_category"), "event_id"), "event": (c.select("id"), "id")}, c.where("is_cancelled").select("id"))
    return kept["category"].agg(F.lit("category").alias("tbl"), F.count("*").alias("kept")).union(kept["event"].agg(F.lit("event").alias("tbl"), F.count("*").alias("kept")))


@register("event_merge", ctes("raw_item") + "SELECT event_id - event_id % 2 AS event_id, count(*) AS sources, string_agg(DISTINCT CASE WHEN event_id % 2 = 1 THEN CAST(event_id AS VARCHAR) END, ',') AS merged_from FROM raw_item GROUP BY 1")
def event_merge(spark, d):
    """Odd events are merged into the even one before them: their sources move, their ids are remembered."""
    moved = F.col("event_id") - F.col("event_id") % 2
    odd = F.when(F.col("event_id") % 2 == 1, F.col("event_id").cast("string"))
    g = view(spark, d, "raw_item").groupBy(moved.alias("event_id")).agg(F.count("*").alias("sources"), F.collect_set(odd).alias("m"))
    return g.select("event_id", "sources", F.nullif(F.array_join(F.array_sort("m"), ","), F.lit("")).alias("merged_from"))


@register("bulk_status", ctes("catalog") + f"SELECT id, CASE WHEN status = 'published' AND start_datetime < TIMESTAMP '{NOW}' THEN 'archived' WHEN status = 'pending_review' AND completeness IS NULL THEN 'incomplete' ELSE status END AS status FROM catalog")
def bulk_status(spark, d):
    return view(spark, d, "catalog").select("id", F.when((F.col("status") == "published") & (F.col("start_datetime") < ts(NOW)), "archived").when((F.col("status") == "pending_review") & F.col("completeness").isNull(), "incomplete").otherwise(F.col("status")).alias("status"))


@register("counters", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS saves FROM events GROUP BY user_id")
def counters(spark, d):
    from eventloom.session import table

    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("saves"))


@register("config_merge", "SELECT s_suppkey AS id, f AS field, CASE f WHEN 'title' THEN coalesce(CASE WHEN s_suppkey % 2 = 0 THEN concat('h', s_suppkey % 4) END, CASE WHEN s_suppkey % 5 <> 0 THEN 'h1' END) WHEN 'date' THEN CASE WHEN s_suppkey % 5 <> 0 THEN '.d' END ELSE CASE WHEN s_suppkey % 3 = 0 THEN '.p' END END AS css FROM supplier CROSS JOIN (VALUES ('title'), ('date'), ('place')) t(f) WHERE css IS NOT NULL")
def config_merge(spark, d):
    """Each source's selectors laid over the defaults, field by field; a source in mode 'replace' has no defaults."""
    k = F.col("s_suppkey")
    pick = lambda *pairs: F.map_filter(F.create_map(*[x for n, v in pairs for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    base, own = pick(("title", F.when(k % 5 != 0, "h1")), ("date", F.when(k % 5 != 0, ".d"))), pick(("title", F.when(k % 2 == 0, F.concat(F.lit("h"), k % 4))), ("place", F.when(k % 3 == 0, ".p")))
    return table(spark, d, "supplier").select(k.alias("id"), F.explode(F.map_zip_with(base, own, lambda _, a, b: F.coalesce(b, a))).alias("field", "css"))


TREE = "WITH RECURSIVE category_tree AS ({}), walk AS (SELECT id, CAST(0 AS BIGINT) AS depth, name AS path FROM category_tree WHERE parent_id IS NULL UNION ALL SELECT c.id, w.depth + 1, w.path || ' > ' || c.name FROM category_tree c JOIN walk w ON c.parent_id = w.id) "


def _tree(sql):
    from eventloom.plans.views import VIEWS

    return TREE.format(VIEWS["category_tree"]) + sql


@register("category_paths", _tree("SELECT id, depth, path FROM walk"))
def category_paths(spark, d):
    return hierarchy.paths(view(spark, d, "category_tree"))


@register("subtree_search", _tree("SELECT id, max(m) AS matched FROM (SELECT id, lower(name) LIKE '%supplier#00000000%' AS m FROM category_tree WHERE lower(name) LIKE '%supplier#00000000%' UNION ALL SELECT p.id, false FROM category_tree c JOIN category_tree n ON c.parent_id = n.id JOIN category_tree p ON p.id = n.id OR p.id = n.parent_id WHERE lower(c.name) LIKE '%supplier#00000000%') GROUP BY id"))
def subtree_search(spark, d):
    return hierarchy.search(view(spark, d, "category_tree"), "supplier#00000000")


LINKED = "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 6 <> 5 THEN CAST((n_nationkey * 7 + 3) % 25 AS BIGINT) END AS parent_id FROM nation"


@register("cycle_check", f"WITH RECURSIVE linked AS ({LINKED}), up AS (SELECT id, parent_id AS a, 1 AS n FROM linked WHERE parent_id IS NOT NULL UNION ALL SELECT u.id, l.parent_id, n + 1 FROM up u JOIN linked l ON l.id = u.a WHERE l.parent_id IS NOT NULL AND n < 30) SELECT DISTINCT id FROM up WHERE id = a")
def cycle_check(spark, d):
    """Nations linked by a rule that makes cycles: those that are their own ancestors."""
    return hierarchy.on_cycle(spark.sql(LINKED.replace("FROM nation", "FROM {nation}"), nation=table(spark, d, "nation")))


NEW_ORDER = "new_order AS (SELECT id, parent_id, (sort_order * 7) % 11 AS sort_order FROM category_tree WHERE sort_order % 2 = 1)"


@register("category_reorder", ctes("category_tree", more=NEW_ORDER) + "SELECT c.id, coalesce(n.sort_order, c.sort_order) AS sort_order, row_number() OVER (PARTITION BY c.parent_id ORDER BY coalesce(n.sort_order, c.sort_order), c.id) AS place FROM category_tree c LEFT JOIN new_order n ON n.id = c.id")
def category_reorder(spark, d):
    """A batch of new positions; places are counted among the children of a parent. A batch that makes a cycle is refused."""
    from pyspark.sql import Window

    c = view(spark, d, "category_tree")
    moved = c.where("sort_order % 2 = 1").select("id", (F.col("sort_order") * 7 % 11).alias("new"))
    if not hierarchy.on_cycle(c.select("id", "parent_id")).isEmpty():
        raise ValueError("the batch makes a cycle")
    x = c.join(moved, "id", "left").withColumn("sort_order", F.coalesce("new", "sort_order"))
    return x.select("id", "sort_order", F.row_number().over(Window.partitionBy("parent_id").orderBy("sort_order", "id")).alias("place"))


@register("category_moves")
def category_moves(spark, d):
    """A batch of moves to other parents, some of which close cycles: regions below nations, nations below each other, suppliers below
    other nations. SQL can't take moves back round by round; tests/test_moves.py has a plain walk."""
    c = view(spark, d, "category_tree")
    n = F.substring("id", 2, 10).cast("bigint")
    to = F.when(F.col("id").startswith("r"), F.concat(F.lit("n"), n * 3 % 25)).when(F.col("id").startswith("n"), F.concat(F.lit("n"), n + 1 - n % 2 * 2)).otherwise(F.concat(F.lit("n"), n % 25))
    moves = c.where((F.col("sort_order") % 3 != 1)).select("id", F.when(n % 10 != 0, to).alias("parent_id"), (F.col("sort_order") * 7 % 11).alias("sort_order"), F.concat(F.col("sort_order") % 5, F.lit("-"), "id").alias("ord"))
    return hierarchy.moved(c.select("id", "parent_id", "sort_order"), moves)
