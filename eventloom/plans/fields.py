"""Small functions on event fields, source checks and list filters, each as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.functions import answers as A
from eventloom.functions import fields as X
from eventloom.plans.views import CATALOG_NOW, NOW, ctes, view
from eventloom.session import table

LINKS = "links AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat(' tickets.de/', o_orderkey) WHEN 3 THEN concat('https://www.karlsruhe.de/e/', o_orderkey) WHEN 4 THEN repeat('x', 600) WHEN 5 THEN concat('http://Kalender.x/', o_orderkey) ELSE concat('https://b.de/', o_orderkey, ' ') END AS a, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat('http://r.de/', o_orderkey) ELSE concat('https://events.karlsruhe.x/', o_orderkey) END AS b, concat('https://s.de/', o_orderkey) AS c FROM orders)"
_agg = lambda c: "(" + " OR ".join(f"contains(lower({c}), '{p}')" for p in X.AGGREGATORS) + ")"


def made(spark, d, sql, name, base="orders"):
    """A generated table of this module as a DataFrame."""
    text = f"WITH {sql} SELECT * FROM {name}".replace("{", "{{").replace("}", "}}").replace(f"FROM {base}", f"FROM {{{base}}}")
    return spark.sql(text, **{base: table(spark, d, base)})


@register("url_normalize", f"WITH {LINKS} SELECT id, CASE WHEN a <> '' AND length(u) <= 500 THEN u END AS url, coalesce({_agg('a')}, false) AS aggregator, CASE " + " ".join(f"WHEN trim({c}) <> '' AND NOT {_agg(c)} THEN trim({c})" for c in "bac") + " END AS booking FROM (SELECT *, CASE WHEN starts_with(trim(a), 'http://') OR starts_with(trim(a), 'https://') THEN trim(a) ELSE concat('https://', trim(a)) END AS u FROM links)")
def url_normalize(spark, d):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return made(spark, d, LINKS, "links").select("id", X.normal_url(a).alias("url"), X.is_aggregator(a).alias("aggregator"), X.booking_url(b, a, c).alias("booking"))


PLACES = "places AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Stadthalle' WHEN 2 THEN concat('Palais, Karlstraße ', o_orderkey, ', 76133 Karlsruhe') WHEN 3 THEN concat('Weg ', o_orderkey, ', Durlach') WHEN 4 THEN 'Saal, Foyer' ELSE concat('Allee ', o_orderkey) END AS address, CASE WHEN o_orderkey % 4 = 0 THEN 'Haus' WHEN o_orderkey % 4 = 1 THEN '' END AS venue FROM orders)"
STREET = lambda c: f"(regexp_matches({c}, '(?:^|[^0-9A-Za-z_])[0-9]{{5}}(?:$|[^0-9A-Za-z_])') OR regexp_matches(lower({c}), '(?:str\\.|straße|strasse|weg|platz|allee|gasse|ring|damm|ufer)\\s*[0-9]+'))"


@register("venue_split", f"WITH {PLACES} SELECT id, CASE WHEN address IS NULL THEN venue WHEN NOT {STREET('address')} AND coalesce(venue, '') = '' THEN address WHEN {STREET('address')} AND coalesce(venue, '') = '' AND contains(address, ',') AND NOT {STREET('f')} THEN f ELSE venue END AS venue, CASE WHEN address IS NULL THEN NULL WHEN NOT {STREET('address')} THEN CASE WHEN coalesce(venue, '') = '' THEN NULL ELSE address END WHEN coalesce(venue, '') = '' AND contains(address, ',') AND NOT {STREET('f')} THEN trim(array_to_string(string_split(address, ',')[2:], ', ')) ELSE address END AS address FROM (SELECT *, trim(string_split(address, ',')[1]) AS f FROM places)")
def venue_split(spark, d):
    return made(spark, d, PLACES, "places").select("id", X.split_venue(F.col("address"), F.col("venue")).alias("s")).select("id", "s.venue", "s.address")


@register("image_clean", "SELECT o_orderkey AS id, array_to_string(list_transform(list_filter(l, lambda u: starts_with(u, 'http://') OR starts_with(u, 'https://')), lambda u: u[1:500])[1:10], '|') AS images FROM (SELECT o_orderkey, list_transform(range(0, o_orderkey % 16), lambda k: CASE WHEN (k + o_orderkey) % 4 = 0 THEN '/x.png' WHEN (k + o_orderkey) % 9 = 0 THEN concat('http://i.de/', repeat('y', 520)) ELSE concat('https://i.de/', k) END) AS l FROM orders)")
def image_clean(spark, d):
    o = table(spark, d, "orders")
    n = F.when(F.col("o_orderkey") % 16 > 0, F.sequence(F.lit(0), (F.col("o_orderkey") % 16 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    urls = F.transform(n, lambda k: F.when((k + F.col("o_orderkey")) % 4 == 0, "/x.png").when((k + F.col("o_orderkey")) % 9 == 0, F.concat(F.lit("http://i.de/"), F.repeat(F.lit("y"), 520))).otherwise(F.concat(F.lit("https://i.de/"), k)))
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(X.images(urls), "|").alias("images"))


NUMBERS = "numbers AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '12.9' WHEN 1 THEN concat('-', o_orderkey, '.5') WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN ' 7 ' END AS text FROM orders)"


@register("safe_numbers", f"WITH {NUMBERS} SELECT id, TRY_CAST(text AS DOUBLE) AS number, CAST(trunc(TRY_CAST(text AS DOUBLE)) AS BIGINT) AS whole FROM numbers")
def safe_numbers(spark, d):
    t = F.col("text")
    return made(spark, d, NUMBERS, "numbers").select("id", t.try_cast("double").alias("number"), X.safe_int(t).alias("whole"))


@register("slug_test", ctes("category_tree") + "SELECT id, s AS slug, regexp_matches(s, '^[a-z0-9]+(-[a-z0-9]+)*$') AS ok FROM (SELECT id, CASE sort_order % 4 WHEN 0 THEN lower(replace(name, ' ', '-')) WHEN 1 THEN name WHEN 2 THEN concat(lower(replace(name, ' ', '-')), '-') ELSE lower(name) END AS s FROM category_tree)")
def slug_test(spark, d):
    name, k = F.col("name"), F.col("sort_order") % 4
    dashed = F.lower(F.replace(name, F.lit(" "), F.lit("-")))
    c = view(spark, d, "category_tree").select("id", F.when(k == 0, dashed).when(k == 1, name).when(k == 2, F.concat(dashed, F.lit("-"))).otherwise(F.lower(name)).alias("slug"))
    return c.withColumn("ok", X.is_slug(F.col("slug")))


_two = lambda c: f"concat(CAST(floor(floor({c} * 100) / 100) AS BIGINT), '.', lpad(CAST(CAST(floor({c} * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'))"


@register("labels_text", ctes("catalog") + f"SELECT id, CASE WHEN price_type = 'free' THEN 'Kostenlos' WHEN price_min <> 0 THEN concat('ab ', {_two('price_min')}, '€') ELSE 'Unbekannt' END AS price, CASE WHEN price_type = 'free' THEN 'Kostenlos' WHEN price_min <> 0 AND price_max <> 0 THEN concat({_two('price_min')}, '€ - ', {_two('price_max')}, '€') WHEN price_min <> 0 THEN concat('ab ', {_two('price_min')}, '€') ELSE 'Unbekannt' END AS price_range, CASE WHEN is_indoor AND is_outdoor THEN 'Indoor & Outdoor' WHEN is_indoor THEN 'Indoor' WHEN is_outdoor THEN 'Outdoor' ELSE 'Unbekannt' END AS place, CASE WHEN age_min <> 0 AND age_max <> 0 THEN concat(age_min, '-', age_max, ' Jahre') WHEN age_min <> 0 THEN concat('ab ', age_min, ' Jahren') ELSE 'Nicht angegeben' END AS ages FROM catalog")
def labels_text(spark, d):
    kind, low, high = F.col("price_type"), F.col("price_min"), F.col("price_max")
    return view(spark, d, "catalog").select("id", X.price_label(kind, low).alias("price"), X.price_label(kind, low, high).alias("price_range"), X.place_label(F.col("is_indoor"), F.col("is_outdoor")).alias("place"), X.age_label(F.col("age_min"), F.col("age_max")).alias("ages"))


@register("age_bucket_defaults", "SELECT o_orderkey AS id, concat_ws(',', " + ", ".join(f"concat('{b}=', CASE WHEN o_orderkey % {k + 2} = 0 THEN o_orderkey % 101 ELSE 50 END)" for k, b in sorted(enumerate(X.BUCKETS), key=lambda x: x[1])) + ") AS buckets FROM orders")
def age_bucket_defaults(spark, d):
    k = F.col("o_orderkey")
    given = F.map_from_entries(F.array_compact(F.array(*[F.when(k % (i + 2) == 0, F.struct(F.lit(b).alias("k"), (k % 101).cast("int").alias("v"))) for i, b in enumerate(X.BUCKETS)])))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return table(spark, d, "orders").select(k.alias("id"), X.age_buckets(given).alias("m")).select("id", text.alias("buckets"))


PAYLOAD = ["description_short", "district", "contact_email", "contact_phone", "booking_url", "address"]


@register("payload_keys", ctes("catalog") + "SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {f} <> '' THEN '{f}' END" for f in PAYLOAD) + "], lambda x: x IS NOT NULL)[1:3], ',') AS filled, " + " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in PAYLOAD) + " AS n_kept FROM catalog")
def payload_keys(spark, d):
    m = F.create_map(*[x for f in PAYLOAD for x in (F.lit(f), F.col(f))])
    return view(spark, d, "catalog").select("id", m.alias("m")).select("id", F.array_join(X.filled_keys(F.col("m"), 3), ",").alias("filled"), F.size(X.drop_nulls(F.col("m"))).alias("n_kept"))


@register("stable_hash", ctes("catalog") + "SELECT count(*) AS n, count(DISTINCT concat_ws('|', coalesce(district, '~'), coalesce(venue_name, '~'), status)) AS n_hashes, true AS order_free FROM catalog")
def stable_hash(spark, d):
    """Digests of payloads: as many as there are payloads, whatever the order of their keys."""
    pairs = [F.struct(F.lit(f).alias("k"), F.col(f).alias("v")) for f in ("district", "venue_name", "status")]
    h = view(spark, d, "catalog").select(X.stable_hash(F.map_from_entries(F.array(*pairs))).alias("a"), X.stable_hash(F.map_from_entries(F.array(*pairs[::-1]))).alias("b"))
    return h.agg(F.count("*").alias("n"), F.countDistinct("a").alias("n_hashes"), F.every(F.col("a") == F.col("b")).alias("order_free"))


@register("why_recommended", ctes("scores") + "SELECT event_id AS id, coalesce(CASE WHEN family_fit > 60 THEN concat('fits ', family_fit) END, CASE WHEN relevance > 50 THEN 'near' END, nullif(trim(CASE WHEN quality % 2 = 0 THEN '  ' ELSE ' good ' END), '')) AS why FROM scores")
def why_recommended(spark, d):
    reasons = F.create_map(F.lit("quality"), F.when(F.col("quality") % 2 == 0, "  ").otherwise(" good "), F.lit("relevance"), F.when(F.col("relevance") > 50, "near"), F.lit("family_fit"), F.when(F.col("family_fit") > 60, F.concat(F.lit("fits "), "family_fit")))
    return view(spark, d, "scores").select(F.col("event_id").alias("id"), X.why_recommended(reasons).alias("why"))


@register("relative_age", ctes("job") + f"SELECT id, CASE WHEN s < 3600 THEN concat(s // 60, 'm') WHEN s < 86400 THEN concat(s // 3600, 'h') ELSE concat(s // 86400, 'd') END AS age FROM (SELECT id, CAST(epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', scheduled_at)) AS BIGINT) AS s FROM job)")
def relative_age(spark, d):
    return view(spark, d, "job").select("id", X.age_bucket(F.lit(NOW).cast("timestamp"), F.col("scheduled_at").cast("timestamp")).alias("age"))


@register("job_progress", ctes("job") + f"SELECT id, e AS elapsed_s, CAST(CASE WHEN processed > 0 THEN floor(CAST(e AS DOUBLE) / processed * greatest(100 - processed, 0)) ELSE greatest(100 - processed, 0) * 3 END AS BIGINT) AS eta_s, CASE WHEN heartbeat_s < 120 THEN 'alive' WHEN heartbeat_s < 300 THEN 'slow' ELSE 'stale' END AS alive FROM (SELECT *, greatest(CAST(epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', scheduled_at)) AS BIGINT), 0) AS e FROM job)")
def job_progress(spark, d):
    p = X.progress_times(F.col("scheduled_at").cast("timestamp"), F.lit(NOW).cast("timestamp"), F.col("processed"), F.lit(100), F.col("heartbeat_s"))
    return view(spark, d, "job").select("id", *[c.alias(n) for n, c in p.items()])


HITS = "hits AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 8 WHEN 0 THEN 'house' WHEN 1 THEN 'building' WHEN 2 THEN 'street' WHEN 3 THEN 'highway' WHEN 4 THEN 'suburb' WHEN 5 THEN 'city' WHEN 6 THEN 'park' END AS kind, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_discount AS DOUBLE) * 15 END AS importance FROM lineitem)"


@register("geocode_confidence", f"WITH {HITS} SELECT id, CAST(CASE WHEN kind IS NULL THEN 0.5 WHEN kind IN ('house', 'building', 'residential') THEN 0.95 WHEN kind IN ('street', 'road', 'highway') THEN 0.75 WHEN kind IN ('suburb', 'neighbourhood', 'city') THEN 0.5 ELSE 0.6 END AS DOUBLE) AS by_kind, least(1.0, CASE WHEN coalesce(importance, 0) = 0 THEN 0.5 ELSE importance END) AS by_importance FROM hits")
def geocode_confidence(spark, d):
    return made(spark, d, HITS, "hits", "lineitem").select("id", X.geocode_confidence(F.col("kind")).alias("by_kind"), X.importance_confidence(F.col("importance")).alias("by_importance"))


ANSWERS = "answers AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN '{\"categories\": [\"a\"], \"age_min\": 3, \"confidence\": 0.5, \"age_rating\": \"6+\"}' WHEN 1 THEN '{\"categories\": [\"a\",\"b\",\"c\",\"d\",\"e\",\"f\"], \"confidence\": 1.5}' WHEN 2 THEN '{\"age_min\": 120, \"age_rating\": \"7+\"}' WHEN 3 THEN concat('{\"categories\": [], \"ai_summary_short\": \"', repeat('s', 301), '\"}') WHEN 4 THEN '[1]' WHEN 5 THEN 'no json' WHEN 6 THEN '{\"categories\": [], \"age_max\": -1, \"summary_confidence\": 2}' WHEN 7 THEN concat('{\"categories\": [\"x\"], \"ai_fit_blurb\": \"', repeat('b', 151), '\"}') END AS answer FROM orders)"
PROBLEMS = {0: "", 1: "categories_too_many,confidence_range", 2: "categories_missing,age_min_range,age_rating_enum", 3: "summary_long", 4: "no_object,categories_missing", 5: "no_object,categories_missing", 6: "age_max_range,summary_confidence_range", 7: "blurb_long", 8: "no_object,categories_missing"}


@register("answer_schema", f"WITH {ANSWERS} SELECT id, CASE id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PROBLEMS.items()) + " END AS problems FROM answers")
def answer_schema(spark, d):
    return made(spark, d, ANSWERS, "answers").select("id", F.array_join(A.problems(F.col("answer")), ",").alias("problems"))


REPLIES = "replies AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN concat('{\"a\": ', o_orderkey, '}') WHEN 1 THEN concat('Here:', chr(10), '```json', chr(10), '{\"a\": ', o_orderkey, '}', chr(10), '```', chr(10), 'done') WHEN 2 THEN concat('Sure: {\"a\": ', o_orderkey, '} ok') WHEN 3 THEN concat('list [', o_orderkey, ', 2] end') WHEN 4 THEN 'nothing' WHEN 5 THEN '{\"a\": ' END AS reply FROM orders)"


@register("lenient_json", f"WITH {REPLIES} SELECT id, CASE id % 7 WHEN 0 THEN reply WHEN 1 THEN concat('{{\"a\": ', id, '}}') WHEN 2 THEN concat('{{\"a\": ', id, '}}') WHEN 3 THEN concat('[', id, ', 2]') END AS parsed FROM replies")
def lenient_json(spark, d):
    return made(spark, d, REPLIES, "replies").select("id", A.lenient_json(F.col("reply")).alias("parsed"))


KINDS = "kinds AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'ics' WHEN 2 THEN 'HTML' WHEN 3 THEN 'unknown' END AS detected, CASE o_orderkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'ICS' WHEN 2 THEN 'html' ELSE 'scraper' END AS configured FROM orders)"
_label = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.KIND_LABELS.items()) + f" ELSE {c} END"


@register("type_mismatch", f"WITH {KINDS} SELECT id, CASE WHEN g = 'html' AND w IN ('rss', 'ics') THEN concat('{X.IS_PAGE[0]}', {_label('w')}, '{X.IS_PAGE[1]}') WHEN g = 'ics' AND w = 'rss' THEN '{X.IS_CALENDAR}' WHEN g = 'rss' AND w = 'ics' THEN '{X.IS_FEED}' WHEN g = 'html' AND w = 'scraper' THEN '' WHEN g = 'unknown' THEN concat('{X.IS_UNKNOWN[0]}', {_label('w')}, '{X.IS_UNKNOWN[1]}') WHEN g <> w THEN concat('{X.IS_OTHER[0]}', {_label('g')}, '{X.IS_OTHER[1]}', {_label('w')}, '{X.IS_OTHER[2]}') ELSE '' END AS message FROM (SELECT id, lower(coalesce(detected, '')) AS g, lower(coalesce(configured, '')) AS w FROM kinds)")
def type_mismatch(spark, d):
    return made(spark, d, KINDS, "kinds").select("id", X.type_mismatch(F.col("detected"), F.col("configured")).alias("message"))


HEADS = "heads AS (SELECT page_id AS id, concat(CASE page_id % 5 WHEN 0 THEN concat('<link rel=\"alternate\" type=\"application/rss+xml\" href=\"/feed/', page_id, '\">') WHEN 1 THEN '<LINK type=\"text/calendar\" href=\"cal.ics\" rel=\"alternate\">' WHEN 2 THEN '<script type=\"application/ld+json\">{\"@type\": \"MusicEvent\"}</script>' WHEN 3 THEN '<link rel=\"stylesheet\" type=\"application/rss+xml\" href=\"no\">' ELSE '<link rel=\"alternate\" type=\"text/calendar\" href=\"b.ics\"><link rel=\"alternate\" type=\"application/atom+xml\" href=\"atom.xml\">' END, html) AS html FROM pages)"


@register("source_detect", f"WITH {HEADS} SELECT id, CASE id % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'ics' WHEN 2 THEN 'json-ld' WHEN 3 THEN 'html' ELSE 'rss' END AS kind, CASE id % 5 WHEN 0 THEN concat('/feed/', id) WHEN 1 THEN 'cal.ics' WHEN 4 THEN 'atom.xml' END AS url FROM heads")
def source_detect(spark, d):
    return made(spark, d, HEADS, "heads", "pages").select("id", X.source_kind(F.col("html")).alias("s")).select("id", "s.kind", "s.url")


PAGES = [("/", "daily", "1.0"), ("/suche", "daily", "0.9"), ("/kalender", "daily", "0.8"), ("/impressum", "yearly", "0.2")]


@register("sitemap_sink", "SELECT n_regionkey AS site, concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?><urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">', " + ", ".join(f"'<url><loc>https://r', n_regionkey, '.de{p}</loc><lastmod>{NOW[:10]}</lastmod><changefreq>{o}</changefreq><priority>{r}</priority></url>'" for p, o, r in PAGES) + ", '</urlset>') AS xml FROM (SELECT DISTINCT n_regionkey FROM nation)")
def sitemap_sink(spark, d):
    """A sitemap of the static pages for each region's site."""
    text = X.sitemap_xml(PAGES, "https://r{site}.de", NOW[:10])
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("site")).distinct().select("site", F.replace(F.lit(text), F.lit("{site}"), F.col("site").cast("string")).alias("xml"))


@register("point_lookup", ctes("catalog") + "SELECT id, title, status FROM catalog WHERE id = 4 LIMIT 1")
def point_lookup(spark, d):
    return view(spark, d, "catalog").where("id = 4").select("id", "title", "status").limit(1)


@register("cron_due_count", ctes("source") + "SELECT count(*) AS n_due FROM source WHERE is_active AND url IS NOT NULL AND (next_fetch_in_min IS NULL OR next_fetch_in_min <= 0)")
def cron_due_count(spark, d):
    due = F.col("next_fetch_in_min").isNull() | (F.col("next_fetch_in_min") <= 0)
    return view(spark, d, "source").where(F.col("is_active") & F.col("url").isNotNull() & due).agg(F.count("*").alias("n_due"))


@register("date_valid", ctes("candidate") + "SELECT id, coalesce(year(ai_start) BETWEEN 2020 AND 2030 OR (year(ai_start) BETWEEN 1995 AND 2001 AND abs(date_diff('day', CAST(start_at AS DATE), CAST(ai_start AS DATE))) <= 365), false) AS valid FROM candidate")
def date_valid(spark, d):
    """Whether an extracted date is in a sane year, or close to the known one."""
    y = F.year("ai_start")
    return view(spark, d, "candidate").select("id", F.coalesce(y.between(2020, 2030) | (y.between(1995, 2001) & (F.abs(F.datediff("ai_start", "start_at")) <= 365)), F.lit(False)).alias("valid"))


@register("source_filter", ctes("source") + "SELECT id, coalesce(health, 'unknown') AS health FROM source WHERE (name ILIKE '%5%' OR url ILIKE '%host1%') AND coalesce(health, 'unknown') IN ('unknown', 'failing')")
def source_filter(spark, d):
    s = view(spark, d, "source").withColumn("health", F.coalesce("health", F.lit("unknown")))
    return s.where((F.col("name").ilike("%5%") | F.col("url").ilike("%host1%")) & F.col("health").isin("unknown", "failing")).select("id", "health")


@register("repair_window", ctes("job") + "SELECT id, CASE WHEN status = 'failed' AND scheduled_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' THEN 'queued' ELSE status END AS status FROM job")
def repair_window(spark, d):
    t = F.col("scheduled_at")
    inside = t.between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))
    return view(spark, d, "job").select("id", F.when((F.col("status") == "failed") & inside, "queued").otherwise(F.col("status")).alias("status"))


@register("event_source_path", ctes("catalog", "raw_item", "source") + "SELECT c.id, r.id AS item_id, s.name AS source_name FROM catalog c LEFT JOIN raw_item r ON r.event_id = c.id AND r.position = 1 LEFT JOIN source s ON s.id = r.source_id")
def event_source_path(spark, d):
    """Event to its first raw item to that item's source."""
    r = view(spark, d, "raw_item").where("position = 1").select("event_id", F.col("id").alias("item_id"), "source_id")
    s = view(spark, d, "source").select(F.col("id").alias("sid"), F.col("name").alias("source_name"))
    c = view(spark, d, "catalog").select("id")
    return c.join(r, c.id == r.event_id, "left").join(s, F.col("sid") == F.col("source_id"), "left").select("id", "item_id", "source_name")


CACHE = "cache AS (SELECT DISTINCT sha256(lower(trim(address))) AS h, 49.0 + length(address) / 100 AS lat FROM catalog WHERE id % 3 = 0 AND address IS NOT NULL)"


@register("geocode_cache", ctes("catalog", more=CACHE) + "SELECT c.id, (k.h IS NOT NULL) AS hit, round(k.lat, 4) AS lat FROM catalog c LEFT JOIN cache k ON k.h = sha256(lower(trim(c.address))) WHERE c.address IS NOT NULL AND c.lat IS NULL")
def geocode_cache(spark, d):
    """Addresses without coordinates, looked up in the cache of earlier answers by the digest of their normal form."""
    digest = F.sha2(F.lower(F.trim("address")), 256)
    c = view(spark, d, "catalog").where("address is not null")
    cache = c.where("id % 3 = 0").select(digest.alias("h"), (F.lit(49.0) + F.length("address") / 100).alias("found")).distinct()
    return c.where("lat is null").select("id", digest.alias("key")).join(cache, F.col("h") == F.col("key"), "left").select("id", F.col("h").isNotNull().alias("hit"), F.round("found", 4).alias("lat"))


@register("health_summary", ctes("source") + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE coalesce(health, 'unknown') = '{h}') AS {h}" for h in ("healthy", "degraded", "failing", "dead", "unknown")) + ", round(CASE WHEN count(*) = 0 THEN 100 ELSE count(*) FILTER (WHERE health = 'healthy') * 100.0 / count(*) END, 4) AS percent_healthy FROM source")
def health_summary(spark, d):
    h = F.coalesce("health", F.lit("unknown"))
    n = {k: F.count_if(h == k).alias(k) for k in ("healthy", "degraded", "failing", "dead", "unknown")}
    share = F.when(F.count("*") == 0, 100.0).otherwise(F.count_if(h == "healthy") * 100.0 / F.count("*"))
    return view(spark, d, "source").agg(F.count("*").alias("total"), *n.values(), F.round(share, 4).alias("percent_healthy"))


@register("map_points", ctes("catalog") + "SELECT id, lat, lng FROM catalog WHERE lat IS NOT NULL AND lng IS NOT NULL")
def map_points(spark, d):
    return view(spark, d, "catalog").where("lat is not null and lng is not null").select("id", "lat", "lng")


@register("review_sort", ctes("catalog", "scores") + "SELECT id, row_number() OVER (ORDER BY coalesce(family_fit, 0) DESC, coalesce(start_datetime, TIMESTAMP '1970-01-01'), id) AS by_score, row_number() OVER (ORDER BY coalesce(end_datetime, TIMESTAMP '1970-01-01'), id) AS by_date FROM catalog LEFT JOIN scores ON event_id = id ORDER BY by_score LIMIT 100")
def review_sort(spark, d):
    """The first hundred of the review list by score, with their places by date; missing values count as zero and 1970."""
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    x = view(spark, d, "catalog").join(view(spark, d, "scores"), F.col("event_id") == F.col("id"), "left").select("id", F.coalesce("family_fit", F.lit(0)).alias("fit"), F.coalesce("start_datetime", zero).alias("starts"), F.coalesce("end_datetime", zero).alias("ends"))
    from pyspark.sql import Window

    top = x.orderBy(F.desc("fit"), "starts", "id").limit(100)
    at = lambda *keys: F.row_number().over(Window.orderBy(*keys))  # noqa: E731  a hundred rows
    first = top.withColumn("by_score", at(F.desc("fit"), "starts", "id"))
    before = x.select("ends", "id").join(F.broadcast(top.select(F.col("ends").alias("e"), F.col("id").alias("i"))), (F.col("ends") < F.col("e")) | ((F.col("ends") == F.col("e")) & (F.col("id") <= F.col("i")))).groupBy("i").agg(F.count("*").alias("by_date"))
    return first.join(before, F.col("i") == F.col("id")).select("id", "by_score", "by_date")


RULED = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN true ELSE false END"


@register("rule_override", ctes("candidate") + f"SELECT id, CASE WHEN r IS NULL THEN true ELSE r END AS relevant, CASE WHEN r IS NOT NULL THEN 'rule' END AS rule_matched, CAST(CASE WHEN r THEN 0.9 WHEN NOT r THEN 0.95 ELSE confidence END AS DOUBLE) AS confidence FROM (SELECT id, confidence, {RULED} AS r FROM candidate)")
def rule_override(spark, d):
    """A rule's decision takes the place of the AI's; without one the AI's stays."""
    r = F.when(F.col("id") % 3 == 0, F.lit(None).cast("boolean")).when(F.col("id") % 3 == 1, True).otherwise(False)
    return view(spark, d, "candidate").select("id", "confidence", r.alias("r")).select("id", F.coalesce("r", F.lit(True)).alias("relevant"), F.when(F.col("r").isNotNull(), "rule").alias("rule_matched"), F.when(F.col("r"), 0.9).when(~F.col("r"), 0.95).otherwise(F.col("confidence")).alias("confidence"))


REASONS = {"new_field": "Neues Feld", "higher_priority": "Höhere Priorität", "locked": "Feld gesperrt"}


@register("reason_lines", ctes("raw_item") + "SELECT id, CASE WHEN quantity < 10 THEN concat('Neues Feld (', f, ')') WHEN quantity < 20 THEN CASE WHEN id % 2 = 0 THEN concat('Fehler: s', source_id) ELSE concat('Feld gesperrt (', f, ')') END WHEN quantity < 25 THEN 'other' WHEN quantity < 30 THEN concat('Felder nicht übernommen: ', f, ', url') WHEN ingest_status = 'ignored' THEN 'Import übersprungen (z. B. Fehler oder Filter).' ELSE 'Event existiert bereits, keine Änderungen an den Feldern.' END AS line FROM (SELECT *, concat('f', position) AS f FROM raw_item)")
def reason_lines(spark, d):
    """What an import did with an item, in lines for editors; one reason an item here."""
    q, field = F.col("quantity"), F.concat(F.lit("f"), "position")
    reason = F.when(q < 10, "new_field").when(q < 20, "locked").when(q < 25, "other")
    source = F.when(q.between(10, 19) & (F.col("id") % 2 == 0), F.concat(F.lit("s"), "source_id")).when(q.between(10, 19), "error")
    shown = F.coalesce(*[F.when(F.col("reason") == k, v) for k, v in REASONS.items()], F.col("reason"))
    line = F.when((F.col("reason") == "locked") & (F.col("by") != "error"), F.concat(F.lit("Fehler: "), "by")).otherwise(F.concat(shown, F.when(F.col("field") != "*", F.concat(F.lit(" ("), "field", F.lit(")"))).otherwise("")))
    x = view(spark, d, "raw_item").select("id", "ingest_status", reason.alias("reason"), F.when(q.between(20, 24), "*").otherwise(field).alias("field"), source.alias("by"), F.when(q.between(25, 29), F.array(field, F.lit("url"))).alias("ignored"))
    fallback = F.when(F.col("ignored").isNotNull(), F.concat(F.lit("Felder nicht übernommen: "), F.array_join("ignored", ", "))).when(F.col("ingest_status") == "ignored", "Import übersprungen (z. B. Fehler oder Filter).").otherwise("Event existiert bereits, keine Änderungen an den Feldern.")
    return x.select("id", F.coalesce(F.when(F.col("reason").isNotNull(), line), fallback).alias("line"))


CRONS = {0: "0 6 * * *", 1: "*/15 * * * *", 2: "30 8 * * 1-5", 3: "0 0 1 1 *", 4: "broken", 5: "5,35 12 * * *"}
AFTER = {0: "2024-01-31 06:00:00", 1: "2024-01-31 00:15:00", 2: "2024-01-31 08:30:00", 3: "2025-01-01 00:00:00", 4: "2024-01-31 06:00:00", 5: "2024-01-31 12:05:00", 6: "2024-01-31 06:00:00"}


@register("cron_next", ctes("source") + f"SELECT id, CAST(CASE id % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in AFTER.items()) + " END AS TIMESTAMP) AS next_fetch FROM source")
def cron_next(spark, d):
    """When each source is due next. There are few distinct cron lines, so their times are found once and joined."""
    from datetime import datetime

    k = F.col("id") % 7
    s = view(spark, d, "source").select("id", F.coalesce(*[F.when(k == n, line) for n, line in CRONS.items()]).alias("cron"))

    def run(batches):
        import pyarrow as pa

        from eventloom.functions.fields import cron_next as after

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cron"), pa.array([after(c, now) for c in b.column("cron").to_pylist()], pa.timestamp("us"))], ["line", "next_fetch"])

    from eventloom.session import ship_package

    ship_package(spark)
    now = datetime.fromisoformat(NOW)
    found = s.select("cron").distinct().mapInArrow(run, "line string, next_fetch timestamp_ntz")
    return s.join(found, F.col("cron").eqNullSafe(F.col("line"))).select("id", "next_fetch")


_ = CATALOG_NOW
