"""Reference-shaped tables as views over the base tables.

Each view is one SELECT that Spark and DuckDB both read, so that queries and oracles start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import table

NOW, CATALOG_NOW = "2024-01-31 00:00:00", "1998-01-01 00:00:00"

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

VIEWS = {
    "search_log": f"SELECT event_id, lower(trim(event_type)) AS query_norm, concat(lower(trim(event_type)), ':', CAST(floor({K} / 25) AS INT)) AS term, CASE WHEN user_id % 3 < 2 THEN 'karlsruhe' END AS city, user_id, ts AS created_at FROM events",
    "usage_log": f"SELECT event_id AS id, ts AS created_at, concat('model-', event_type) AS model, concat('op', {K} % 4) AS operation, CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 3) AS BIGINT) AS output_tokens, value / 1000 AS cost, {K} * 10 AS response_ms, ({K} % 3 = 0) AS was_cached, CASE WHEN event_type = 'error' THEN 'E' END AS error_code FROM events",
    "catalog": """SELECT o_orderkey AS id, concat('Event ', o_orderkey % 500, ' <b>', o_orderpriority, '</b>') AS title,
        CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'pending_review' ELSE 'pending_ai' END AS status,
        o_orderdate AS start_datetime, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL '2' HOUR END AS end_datetime,
        o_orderdate - INTERVAL '10' DAY AS created_at,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice / 10000 END AS price_min,
        CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice / 8000 END AS price_max,
        CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' WHEN o_orderkey % 7 = 0 THEN 'free' WHEN o_orderkey % 5 = 0 THEN 'range' ELSE 'paid' END AS price_type,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 10 END AS age_min,
        CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 10 + 4 END AS age_max,
        (o_orderkey % 2 = 0) AS is_indoor, (o_orderkey % 3 = 0) AS is_outdoor,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(49.0069 AS DOUBLE) + CAST((o_orderkey * 7919) % 2000 - 1000 AS DOUBLE) / 5000 END AS lat,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(8.4037 AS DOUBLE) + CAST((o_orderkey * 104729) % 2000 - 1000 AS DOUBLE) / 5000 END AS lng,
        CASE WHEN o_orderkey % 13 <> 0 THEN concat('D', o_orderkey % 12) END AS district, concat('V', o_orderkey % 40) AS venue_name,
        CASE WHEN o_orderkey % 8 <> 0 THEN concat('Street ', o_orderkey % 90, ', 76131 Karlsruhe') END AS address,
        o_custkey AS provider_id, (o_orderkey % 17 = 0) AS is_cancelled,
        CASE o_orderkey % 10 WHEN 0 THEN '16+' WHEN 1 THEN '18+' WHEN 2 THEN NULL ELSE '6+' END AS age_rating,
        CASE WHEN o_orderkey % 3 <> 1 THEN concat('https://host', o_orderkey % 20, '.example.com/e/', o_orderkey) END AS booking_url,
        CASE WHEN o_orderkey % 9 = 4 THEN concat('mail', o_orderkey % 50, '@example.com') END AS contact_email,
        CASE WHEN o_orderkey % 4 <> 1 THEN repeat('d', CAST(o_orderkey % 120 AS INT)) END AS description_short,
        CASE WHEN o_orderkey % 5 = 2 THEN repeat('l', CAST(o_orderkey % 90 AS INT)) END AS description_long,
        o_orderkey % 97 AS view_count, o_orderkey % 13 AS save_count,
        CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS confidence,
        CASE WHEN o_orderkey % 7 <> 3 THEN (o_orderkey * 37) % 101 END AS completeness,
        CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey - 1 END AS rescheduled_to, CASE WHEN o_orderkey % 6 < 2 THEN concat('0721/', o_orderkey) WHEN o_orderkey % 6 = 2 THEN '' END AS contact_phone, o_orderkey % 4 AS n_images, o_orderkey % 10 AS source_id FROM orders""",
    "scores": "SELECT o_orderkey AS event_id, (o_orderkey * 3) % 101 AS relevance, (o_orderkey * 5) % 101 AS quality, (o_orderkey * 7) % 101 AS family_fit, (o_orderkey * 11) % 101 AS stressfree, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 101 END AS fun FROM orders WHERE o_orderkey % 5 <> 0",
    "event_category": "SELECT DISTINCT l_orderkey AS event_id, lower(p_type) AS slug FROM lineitem JOIN part ON l_partkey = p_partkey",
    "provider": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type FROM customer",
    "source": """SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 5 WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' WHEN 2 THEN 'failing' WHEN 3 THEN 'dead' END AS health,
        (s_suppkey % 4 <> 0) AS is_active, CASE WHEN s_suppkey % 9 <> 0 THEN concat('https://host', s_suppkey % 20, '.example.com/feed') END AS url, s_suppkey % 3 AS priority,
        CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (s_suppkey * 53) % 900 END AS last_fetch_min_ago, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE (s_suppkey * 31) % 600 - 300 END AS next_fetch_in_min,
        s_suppkey % 7 AS failures, (s_suppkey * 17) % 40 AS last_count, s_suppkey % 30 AS expected_count, CASE WHEN s_suppkey % 6 <> 0 THEN (s_suppkey * 13) % 20 END AS last_success_days, (s_suppkey % 8 = 0) AS partial FROM supplier""",
    "ingest_run": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 <> 0 THEN o_orderkey % 10 END AS source_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS started_at, o_orderkey % 50 AS events_found, o_orderkey % 7 AS events_created, o_orderkey % 5 AS events_updated, o_orderkey % 3 AS events_skipped, (o_orderkey * 7) % 45 AS age_min, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'cron-' ELSE 'api-' END, o_orderkey) AS correlation_id FROM orders",
    "raw_item": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS run_id, l_orderkey AS event_id, l_suppkey AS source_id, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'created' WHEN l_returnflag = 'N' THEN 'updated' ELSE 'ignored' END AS ingest_status, concat('h', l_partkey % 50) AS raw_hash, concat('https://x/', l_partkey) AS source_url, l_linenumber AS position, l_quantity AS quantity, l_shipdate AS seen_at FROM lineitem",
    "job": f"SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'crawl' WHEN 'click' THEN 'classify' ELSE 'score' END AS type, CASE {K} % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'dead' END AS status, {K} % 4 AS priority, ts AS scheduled_at, {K} % 6 AS attempts, {K} AS processed, ({K} * 7) % 400 AS heartbeat_s FROM events",
    "category_tree": "SELECT concat('r', r_regionkey) AS id, CAST(NULL AS VARCHAR(20)) AS parent_id, r_name AS name, r_regionkey AS sort_order FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name, n_nationkey FROM nation UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), s_name, CAST(s_suppkey AS INT) FROM supplier",
    "event_text": """SELECT doc_id AS id, text, concat(text, ' ', CASE doc_id % 16
        WHEN 0 THEN 'Eintritt frei für Kinder ab 6 Jahren, 14. Februar 2026, 19 Uhr' WHEN 1 THEN 'Tickets 12,50 € Erwachsene: 15€ Kinder: 8€' WHEN 2 THEN 'auf spendenbasis im museum, jeden montag' WHEN 3 THEN 'Alter 3-8 jahre, 5. März 2026, 19:30 Uhr'
        WHEN 4 THEN 'bis 12 Jahre im park, begrenzte plätze' WHEN 5 THEN 'von 14:00 bis 16:30 Uhr' WHEN 6 THEN 'ab 17 Uhr, parkhaus vorhanden' WHEN 7 THEN 'Hermannstraße 12, 76137 Karlsruhe, Tel. 0721/1334401'
        WHEN 8 THEN 'Die Veranstaltung ist leider abgesagt' WHEN 9 THEN 'ausverkauft, warteliste offen' WHEN 10 THEN 'wöchentlich, in englisch' WHEN 11 THEN 'keine parkplätze, anmeldung erforderlich info@haus.de'
        WHEN 12 THEN 'poker und casino nur erwachsene' WHEN 13 THEN 'bier stammtisch senioren' WHEN 14 THEN 'familie und kinder im zoo, DE89 3704 0044 0532 0130 00' ELSE 'nachmittags basteln, Kurs 4111 1111 1111 1111 4+' END) AS description FROM documents""",
}

VIEWS |= {
    "candidate": """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'scraper' ELSE 'api' END AS source_type, concat('Candidate ', o_orderkey) AS title, CASE WHEN o_orderkey % 4 <> 0 THEN repeat('ab. ', CAST(o_orderkey % 200 AS INT)) END AS description,
        CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS start_at, CASE WHEN o_orderkey % 5 = 1 THEN o_orderdate + INTERVAL '3' HOUR END AS end_at,
        CASE WHEN o_orderkey % 4 = 1 THEN concat('Weg ', o_orderkey) WHEN o_orderkey % 4 = 2 THEN '' END AS address, CASE WHEN o_orderkey % 7 < 3 THEN concat('Haus ', o_orderkey % 40) END AS venue_name, CASE WHEN o_orderkey % 8 < 4 THEN 'Karlsruhe' END AS city, CASE WHEN o_orderkey % 9 < 4 THEN '76131' END AS postal_code,
        CASE o_orderkey % 6 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' WHEN 2 THEN 'bogus' WHEN 3 THEN NULL WHEN 4 THEN 'unknown' ELSE 'range' END AS price_type, CASE WHEN o_orderkey % 5 = 0 THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 5 < 3 THEN CAST(o_orderkey % 40 AS DOUBLE) END AS price_min, CASE WHEN o_orderkey % 7 = 0 THEN CAST(50 AS DOUBLE) END AS price_max,
        CASE WHEN o_orderkey % 4 = 0 THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 4 = 1 THEN CAST(49.5 AS DOUBLE) END AS lat, CASE WHEN o_orderkey % 4 = 1 THEN CAST(8.5 AS DOUBLE) END AS lng, CASE WHEN o_orderkey % 3 = 0 THEN 49.1E0 END AS geo_lat, CASE WHEN o_orderkey % 3 = 0 THEN 8.1E0 END AS geo_lng,
        CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 3 * 3 END AS age_min, CASE WHEN o_orderkey % 6 < 2 THEN 12 END AS age_max, (o_orderkey % 7 = 0) AS is_indoor, CASE WHEN o_orderkey % 4 > 1 THEN o_orderkey % 5 = 0 END AS is_outdoor, CASE WHEN o_orderkey % 8 = 0 THEN 'limited' END AS availability_status, CASE WHEN o_orderkey % 3 = 1 THEN concat('https://b/', o_orderkey) END AS booking_url,
        (o_orderkey % 5 <> 4) AS has_ai, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS dt_conf, CASE WHEN o_orderkey % 5 <> 4 AND o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '1' DAY END AS ai_start, CASE WHEN o_orderkey % 5 <> 4 AND o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '2' DAY END AS ai_end,
        CAST(o_orderkey % 13 AS DOUBLE) / 12 AS loc_conf, CASE WHEN o_orderkey % 5 <> 4 AND o_orderkey % 7 > 2 THEN CASE o_orderkey % 4 WHEN 0 THEN concat('Allee ', o_orderkey) WHEN 1 THEN 'siehe  Beschreibung' WHEN 2 THEN 'Durlach' ELSE ' ' END END AS ai_address, CASE WHEN o_orderkey % 5 <> 4 AND o_orderkey % 3 = 1 THEN 'Durlach' END AS ai_district,
        CASE WHEN o_orderkey % 6 <> 5 THEN CAST(o_orderkey % 9 AS DOUBLE) / 8 END AS venue_conf, CASE WHEN o_orderkey % 5 <> 4 AND o_orderkey % 4 < 3 THEN concat('Saal ', o_orderkey % 9) END AS ai_venue, CASE WHEN o_orderkey % 3 = 2 THEN concat('Ring ', o_orderkey) END AS ai_line, CASE WHEN o_orderkey % 2 = 1 THEN 'Ettlingen' END AS ai_city, CASE WHEN o_orderkey % 2 = 1 THEN '76275' END AS ai_postal,
        CAST(o_orderkey % 7 AS DOUBLE) / 6 AS price_conf, CASE WHEN o_orderkey % 5 <> 4 THEN CASE o_orderkey % 8 WHEN 0 THEN 'free' WHEN 1 THEN 'donation' WHEN 2 THEN 'Paid' WHEN 3 THEN 'range' END END AS ai_price_type, CASE WHEN o_orderkey % 3 = 0 THEN CAST(7 AS DOUBLE) END AS ai_price_min, CASE WHEN o_orderkey % 6 = 0 THEN CAST(9 AS DOUBLE) END AS ai_price_max,
        (o_orderkey % 5 <> 4 AND o_orderkey % 10 = 3) AS ai_cancelled, CASE WHEN o_orderkey % 5 <> 4 AND o_orderkey % 4 = 3 THEN 5 END AS ai_age_min, CASE WHEN o_orderkey % 5 <> 4 AND o_orderkey % 4 = 1 THEN 11 END AS ai_age_max, CASE WHEN o_orderkey % 5 <> 4 THEN o_orderkey % 3 = 1 END AS ai_indoor,
        CASE WHEN o_orderkey % 5 <> 4 AND o_orderkey % 6 <> 0 THEN o_orderkey * 7 % 101 END AS fit, CAST(o_orderkey % 21 AS DOUBLE) / 20 AS confidence, CASE WHEN o_orderkey % 5 <> 4 THEN CASE WHEN o_orderkey % 12 = 0 THEN 'fallback' ELSE 'm1' END END AS model, CAST(o_orderkey % 4 AS DOUBLE) / 3 AS contact_conf, CASE o_orderkey % 3 WHEN 0 THEN concat(' x', o_orderkey, '@y.de ') WHEN 1 THEN ' ' END AS ai_email, o_orderkey % 9 AS source_id FROM orders""",
    "when_text": """SELECT doc_id AS id, concat(substr(text, 1, 60), ' ', CASE doc_id % 20 WHEN 0 THEN '14. Februar 2026, 19 Uhr' WHEN 1 THEN '5. März 2026, 19:30 Uhr' WHEN 2 THEN '20. März 2026, 10 bis 14 Uhr' WHEN 3 THEN '15. April 2026, 19:00–21:30 Uhr' WHEN 4 THEN '30. Mai 2026, 22 bis 2 Uhr'
        WHEN 5 THEN '25. Dezember 2026' WHEN 6 THEN 'Beginn: 10. Januar 2026, 19.30 Uhr' WHEN 7 THEN 'am 07.11.2027 um 18 Uhr' WHEN 8 THEN '31. Juni 2026, 9 Uhr' WHEN 9 THEN '1. Mai 2019, 9 Uhr' WHEN 10 THEN concat('3. Juni 2026 ', repeat('x', 130), ' 19 Uhr') WHEN 11 THEN '4. Juli 2026, 25 bis 27 Uhr'
        WHEN 12 THEN 'Sa, 14. Feb. 2026, 10 Uhr' WHEN 13 THEN 'Sonntag, 2026-02-15 von 9 und 11 Uhr' WHEN 14 THEN 'Mo. 16.02.26 20:15' WHEN 15 THEN '17. Dez 27, 8 Uhr' WHEN 16 THEN '12.13.2026' WHEN 17 THEN '1.2.2026, 99:99 Uhr' WHEN 18 THEN 'ohne Datum, 19 Uhr' ELSE '24. August 2028, 7:05' END, ' ', substr(text, 61, 200)) AS text FROM documents""",
    "date_value": """SELECT o_orderkey AS id, CASE o_orderkey % 14 WHEN 0 THEN ' 14.02.2026 19:30 ' WHEN 1 THEN '7.3.2027' WHEN 2 THEN '2026-02-14T19:30:15Z' WHEN 3 THEN '2026-02-14' WHEN 4 THEN '14.02.26 7:05' WHEN 5 THEN '14.02.26' WHEN 6 THEN 'am 2026-05-06T08:09 Uhr' WHEN 7 THEN '31.02.2026' WHEN 8 THEN '1.1.2031'
        WHEN 9 THEN '2026-02-14T19:30:00+01:00' WHEN 10 THEN '14.02.2026 25:00' WHEN 11 THEN NULL WHEN 12 THEN 'morgen' ELSE concat(o_orderkey % 31 + 1, '.', o_orderkey % 12 + 1, '.', 2019 + o_orderkey % 13) END AS value FROM orders""",
}

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the base tables that it names are read."""
    sql = VIEWS[name]
    used = [b for b in BASE if re.search(rf"\bFROM {b}\b|\bJOIN {b}\b", sql)]
    for b in used:
        sql = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", sql)
    return spark.sql(sql, **{b: table(spark, sf_dir, b) for b in used})


def view_over(rows: DataFrame, name: str, base: DataFrame) -> DataFrame:
    """A view of one table over rows that have columns of it, beside their other columns, which stay. base: the table; those of its
    columns that rows lack are null, so only what is made of the others may be read."""
    kept = [c for c in rows.columns if c not in base.columns]
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in base.schema if f.name not in rows.columns}
    sql = re.sub(r"\bFROM \w+$", "FROM {rows}", VIEWS[name])
    return rows.sparkSession.sql("SELECT " + "".join(f"{c}, " for c in kept) + sql.removeprefix("SELECT "), rows=rows.withColumns(lacking))


def ctes(*names: str, more: str = "") -> str:
    """The WITH clause that gives an oracle its views."""
    return "WITH " + ", ".join([f"{n} AS ({VIEWS[n]})" for n in names] + ([more] if more else [])) + " "
