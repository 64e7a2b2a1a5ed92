"""Feeds, sinks and source checks, on feeds made from the tables by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.operators import trends
from eventloom.plans.views import ctes, view
from eventloom.session import table
from eventloom.sources import feeds


BODIES = "bodies AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'text/calendar; charset=utf-8' WHEN 1 THEN 'application/rss+xml' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN 'TEXT/HTML' WHEN 4 THEN NULL WHEN 5 THEN 'text/plain' END AS type, CASE page_id % 6 WHEN 0 THEN concat(chr(10), ' BEGIN:VCALENDAR', html) WHEN 1 THEN concat('<?xml version=1?>', html) WHEN 2 THEN '<feed xmlns=x>' WHEN 3 THEN 'plain words' ELSE html END AS body FROM pages)"


@register("content_sniff", f"WITH {BODIES} SELECT page_id, CASE WHEN contains(h, 'calendar') THEN 'ics' WHEN regexp_matches(h, 'rss|atom|xml') THEN 'rss' WHEN starts_with(b, 'begin:vcalendar') THEN 'ics' WHEN regexp_matches(b, '^(<\\?xml|<rss|<feed)') THEN 'rss' WHEN regexp_matches(b, '^(<!doctype html|<html)') OR contains(h, 'html') THEN 'html' ELSE 'unknown' END AS kind FROM (SELECT page_id, lower(coalesce(type, '')) AS h, lower(ltrim(body[1:500], concat(' ', chr(10), chr(9), chr(13)))) AS b FROM bodies)")
def content_sniff(spark, d):
    """The kind of what a source sent: by its header, then by how the text begins."""
    x = spark.sql(f"WITH {BODIES} SELECT * FROM bodies".replace("FROM pages", "FROM {pages}"), pages=table(spark, d, "pages"))
    return x.select("page_id", feeds.sniff(F.col("type"), F.col("body")).alias("kind"))


@register("rss_scan", ctes("catalog") + "SELECT source_id, concat('Event ', id) AS title, concat('https://x/', id) AS link FROM catalog")
def rss_scan(spark, d):
    """A feed for each source and hundred events, written and read back."""
    item = F.concat(F.lit("<item><title><![CDATA[Event "), F.col("id").cast("string"), F.lit("]]></title><link>https://x/"), F.col("id").cast("string"), F.lit("</link><pubDate>"), F.date_format("start_datetime", "yyyy-MM-dd"), F.lit("</pubDate></item>"))
    made = view(spark, d, "catalog").groupBy("source_id", F.floor(F.col("id") / 1000).alias("part")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>")).alias("body"))
    return feeds.rss_items(made).select("source_id", "title", "link")


@register("ics_scan", ctes("catalog") + "SELECT id, strftime(start_datetime, '%Y%m%d') AS day, coalesce(strftime(end_datetime, '%Y%m%d%H'), strftime(start_datetime + INTERVAL '2' HOUR, '%Y%m%d%H')) AS until FROM catalog")
def ics_scan(spark, d):
    """Events exported as a calendar and scanned again."""
    c = view(spark, d, "catalog")
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\n"), feeds.ical(F.col("title"), F.col("start_datetime"), F.col("end_datetime"), F.col("id").cast("string"), F.coalesce("venue_name", F.lit("")), F.lit("CONFIRMED")), F.lit("\r\nEND:VCALENDAR"))
    x = feeds.ics_events(c.select(body.alias("body")))
    return x.select(F.col("uid").cast("bigint").alias("id"), F.date_format("starts", "yyyyMMdd").alias("day"), F.date_format("ends", "yyyyMMddHH").alias("until"))


@register("ical_export", ctes("catalog") + r"SELECT id, concat('BEGIN:VEVENT', chr(13), chr(10), 'UID:', id, chr(13), chr(10), 'DTSTART:', strftime(start_datetime, '%Y%m%dT%H%M%SZ'), chr(13), chr(10), 'DTEND:', strftime(coalesce(end_datetime, start_datetime + INTERVAL '2' HOUR), '%Y%m%dT%H%M%SZ'), chr(13), chr(10), 'SUMMARY:', title, chr(13), chr(10), 'LOCATION:', replace(coalesce(address, ''), ',', '\,'), chr(13), chr(10), 'STATUS:CONFIRMED', chr(13), chr(10), 'END:VEVENT') AS ics FROM catalog")
def ical_export(spark, d):
    return view(spark, d, "catalog").select("id", feeds.ical(F.col("title"), F.col("start_datetime"), F.col("end_datetime"), F.col("id").cast("string"), F.coalesce("address", F.lit("")), F.lit("CONFIRMED")).alias("ics"))


PATHS = ["event/", "events/", "about/", "veranstaltungen/", "termin/", "Kalender/", "programm/", "aktivitaeten/", "angebot/", "event-", "x/events?"]
_path = "CASE id % 11 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PATHS)) + " END"


@register("sitemap_filter", ctes("catalog") + f"SELECT url FROM (SELECT DISTINCT concat('https://x/', {_path}, id) AS url FROM catalog) WHERE regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '/event[s]?/|/veranstaltung(en)?/|/termine?/|/kalender/|/programm/|/aktivitaet(en)?/|/angebot(e)?/') ORDER BY url LIMIT 200")
def sitemap_filter(spark, d):
    """Event pages from sitemaps of a hundred entries each, which an index lists."""
    path = F.coalesce(*[F.when(F.col("id") % 11 == k, p) for k, p in enumerate(PATHS)])
    loc = F.concat(F.lit("<url><loc>https://x/"), path, F.col("id").cast("string"), F.lit("</loc></url>"))
    maps = view(spark, d, "catalog").groupBy("source_id", F.floor(F.col("id") / 400).alias("part")).agg(F.array_join(F.collect_list(loc), "").alias("body"))
    named = maps.select(F.concat_ws("/", F.lit("https://x/maps"), "source_id", "part").alias("address"), "body")
    index = named.groupBy().agg(F.lit(None).cast("string").alias("address"), F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "address", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("body"))
    return feeds.sitemap_urls(feeds.listed_maps(index, named))


@register("sitemap_walk", ctes("catalog") + f"SELECT * FROM (SELECT source_id AS site, row_number() OVER (PARTITION BY source_id ORDER BY id // 500, id) AS place, concat('https://x/', {_path}, id) AS url FROM catalog WHERE id % 11 NOT IN (2, 9, 10)) WHERE place <= 200")
def sitemap_walk(spark, d):
    """Event pages in the order of their discovery: map m of a source lists the map that lists it, the maps 4m + 1 to 4m + 4 and its pages."""
    path = F.coalesce(*[F.when(F.col("id") % 11 == k, p) for k, p in enumerate(PATHS)])
    loc = lambda c: F.concat(F.lit("<loc>"), c, F.lit("</loc>"))
    address = lambda m: F.concat(F.lit("https://x/"), F.col("site").cast("string"), F.lit("/sitemap-"), m.cast("string"), F.lit(".xml"))
    c = view(spark, d, "catalog").select(F.col("source_id").alias("site"), F.floor(F.col("id") / 500).alias("m"), "id", loc(F.concat(F.lit("https://x/"), path, F.col("id").cast("string"))).alias("page"))
    c = c.groupBy("site", "m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "page"))), lambda p: p["page"]), "").alias("pages"))
    maps = F.concat(*[loc(address(n)) for n in (F.floor((F.col("m") - 1) / 4), *[4 * F.col("m") + k for k in range(1, 5)])])
    documents = c.select(address(F.col("m")).alias("address"), F.concat(F.lit("<urlset>"), maps, "pages", F.lit("</urlset>")).alias("body"))
    return feeds.walk_sitemaps(c.select("site").distinct().select("site", address(F.lit(0)).alias("address")), documents)


@register("robots_sitemap", ctes("source") + "SELECT id, concat(coalesce(url, 'none'), '/sitemap.xml') AS sitemap FROM source")
def robots_sitemap(spark, d):
    body = F.concat(F.lit("User-agent: *\nDisallow: /x\nSitemap: "), F.coalesce("url", F.lit("none")), F.lit("/sitemap.xml\nsitemap: second"))
    return view(spark, d, "source").select("id", feeds.robots_sitemap(body).alias("sitemap"))


UNSAFE = ["ftp://h/", "http://10.1.2.3/", "http://192.168.0.1:80/", "https://8.8.8.8/", "https://example.com/", "http://[::1]/", "http://[fe80::1]/", "http://[fd00::7]:8080/", "http://[2001:db8::1]/", "http://2130706433/", "http://0x7f.1/", "http://localhost/", "http://172.20.0.1/", "http://172.32.0.1/", "nonsense ", "https:///x", "http://169.254.1.1/", "http://[::ffff:10.0.0.1]/", "http://017700000001/"]
REASON = {0: "scheme", 1: "address", 2: "address", 5: "address", 6: "address", 7: "address", 9: "address", 10: "address", 11: "address", 12: "address", 14: "scheme", 15: "host", 16: "address", 17: "address", 18: "address"}


@register("url_safety", f"SELECT o_orderkey AS id, CASE o_orderkey % {len(UNSAFE)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in REASON.items()) + " END AS reason FROM orders")
def url_safety(spark, d):
    """Why a URL must not be fetched: literal addresses of all forms in private blocks, other schemes, no host."""
    k = F.col("o_orderkey")
    url = F.concat(F.coalesce(*[F.when(k % len(UNSAFE) == i, u) for i, u in enumerate(UNSAFE)]), k.cast("string"))
    return table(spark, d, "orders").select(k.alias("id"), feeds.unsafe_url(url).alias("reason"))


@register("dead_letters", ctes("job") + "SELECT id, type FROM job WHERE status = 'dead' AND scheduled_at >= TIMESTAMP '2024-01-24' ORDER BY scheduled_at, id LIMIT 25")
def dead_letters(spark, d):
    from eventloom.operators.search import ts

    return view(spark, d, "job").where((F.col("status") == "dead") & (F.col("scheduled_at") >= ts("2024-01-24 00:00:00"))).orderBy("scheduled_at", "id").select("id", "type").limit(25)


@register("conditional_fetch", ctes("source") + "SELECT id, CASE WHEN etag IS NOT NULL AND etag = seen THEN 'unchanged' WHEN etag IS NULL AND modified IS NOT NULL AND modified <= seen_at THEN 'unchanged' ELSE 'fetch' END AS action FROM (SELECT id, CASE WHEN id % 4 <> 0 THEN concat('e', id % 3) END AS etag, CASE WHEN id % 6 <> 0 THEN concat('e', id % 2) END AS seen, CASE WHEN id % 5 <> 0 THEN id % 7 END AS modified, id % 9 AS seen_at FROM source WHERE url IS NOT NULL)")
def conditional_fetch(spark, d):
    """Sources whose tag, or without one whose time of change, is what was seen before need not be read again."""
    k = F.col("id")
    s = view(spark, d, "source").where("url is not null").select(k, F.when(k % 4 != 0, F.concat(F.lit("e"), k % 3)).alias("etag"), F.when(k % 6 != 0, F.concat(F.lit("e"), k % 2)).alias("seen"), F.when(k % 5 != 0, k % 7).alias("modified"), (k % 9).alias("seen_at"))
    same = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("seen")).otherwise(F.col("modified") <= F.col("seen_at"))
    return s.select("id", F.when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("fetch").alias("action"))


@register("settings_defaults", "SELECT id, k, v FROM (SELECT c_custkey AS id, unnest(['lang', 'limit', 'radius', 'theme']) AS k, unnest([CASE WHEN c_custkey % 3 = 0 THEN 'en' ELSE 'de' END, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 50 AS VARCHAR) ELSE '20' END, '20', CASE WHEN c_custkey % 5 = 0 THEN 'dark' END]) AS v FROM customer) WHERE v IS NOT NULL")
def settings_defaults(spark, d):
    """Each user's settings laid over the defaults."""
    k = F.col("c_custkey")
    own = F.map_filter(F.create_map(F.lit("lang"), F.when(k % 3 == 0, "en"), F.lit("limit"), F.when(k % 4 == 0, (k % 50).cast("string")), F.lit("theme"), F.when(k % 5 == 0, "dark")), lambda _, v: v.isNotNull())
    base = F.create_map(*[F.lit(x) for x in ("lang", "de", "limit", "20", "radius", "20")])
    return table(spark, d, "customer").select(k.alias("id"), F.explode(F.map_zip_with(base, own, lambda _, x, y: F.coalesce(y, x))).alias("k", "v"))


FIELDS = [("action", "string"), ("term", "string"), ("boost", "int"), ("replacement", "string"), ("label", "string"), ("priority", "int")]


@register("suggestion_merge")
def suggestion_merge(spark, d):
    """Each city's most frequent terms, with an editor's overrides folded in."""
    log = view(spark, d, "search_log").withColumn("city", F.coalesce("city", F.lit("other")))
    from eventloom.operators.search import first_per

    top = first_per(log.groupBy("city", F.col("term").alias("text")).agg(F.count("*").cast("double").alias("score")), "city", [F.desc("score"), F.asc("text")], 10)
    items = top.select("city", F.lit("trending").alias("list"), F.col("rank").alias("position"), "text", F.lit(None).cast("string").alias("badge"), "score")
    items = items.union(items.withColumn("list", F.lit("suggestion")))
    rows = [("HIDE", "view:0", None, None, None, 5), ("PIN", "Museum", None, None, None, 4), ("BOOST", "click:1", 500, None, None, 3), ("REPLACE", "error:2", None, "fixed", None, 2), ("PUSH", "zoo", None, None, "new", 1)]
    listed = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, FIELDS)]) for r in rows])
    overrides = items.select(F.col("city").alias("city")).distinct().select("city", F.inline(listed))
    return trends.apply_overrides(items, overrides, "city")
