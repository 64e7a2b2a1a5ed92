"""Text extraction and rules on event descriptions, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.catalog import register
from eventloom.functions import text as T
from eventloom.plans.views import ctes, view
from eventloom.session import ship_package, table

def low():
    """The description in lower case."""
    return F.lower("description")


def sql_any(words, column="t"):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def events(sql):
    return ctes("event_text", more="low AS (SELECT id, description, lower(description) AS t FROM event_text)") + sql


def texts(spark, d):
    return view(spark, d, "event_text")


def struct(df, column, name, **fields):
    """id and the fields of a struct column."""
    return df.select("id", column.alias(name)).select("id", *[F.col(f"{name}.{f}").alias(n) for n, f in fields.items()])


@register("title_norm", ctes("catalog") + "SELECT id, trim(regexp_replace(regexp_replace(title, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS query FROM catalog")
def title_norm(spark, d):
    return view(spark, d, "catalog").select("id", T.display_title(F.col("title")).alias("title"), T.normalize_query(F.col("title")).alias("query"))


@register("desc_split", "SELECT doc_id, CASE WHEN length(t) <= 500 THEN t WHEN p > 300 AND p < 500 THEN s[1:p + 1] WHEN b > 300 AND b < 500 THEN concat(s[1:b], '...') ELSE concat(t[1:497], '...') END AS short FROM (SELECT *, CASE WHEN contains(s, '.') THEN 500 - instr(reverse(s), '.') ELSE 500 END AS p, CASE WHEN contains(s, ' ') THEN 500 - instr(reverse(s), ' ') ELSE 500 END AS b FROM (SELECT doc_id, t, t[1:500] AS s FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)))")
def desc_split(spark, d):
    return table(spark, d, "documents").select("doc_id", T.short_description(F.col("text")).alias("short"))


AMOUNT = r"([0-9]+(?:[,.][0-9]{2})?)\s*(?:€|euro|eur)"
NUM = lambda p, g=1: f"TRY_CAST(replace(nullif(regexp_extract(t, '{p}', {g}), ''), ',', '.') AS DOUBLE)"
INT = lambda p, g=1: f"TRY_CAST(nullif(regexp_extract(t, '{p}', {g}), '') AS INT)"


@register("price_extract", events(f"SELECT id, CASE WHEN f THEN 'free' WHEN v IS NOT NULL THEN 'paid' ELSE 'unknown' END AS price_type, CASE WHEN f THEN 0 ELSE v END AS price_min FROM (SELECT id, {sql_any(T.FREE)} OR {sql_any(T.DONATION)} AS f, {NUM(AMOUNT)} AS v FROM low)"))
def price_extract(spark, d):
    return struct(texts(spark, d), T.price(low()), "p", price_type="type", price_min="min")


TAIL = r"[:\s]*([0-9]+(?:[,.][0-9]{2})?)\s*(?:€|euro)"


@register("price_details", events(f"SELECT id, {NUM('erwachsene' + TAIL)} AS adult, {NUM('kind(?:er)?' + TAIL)} AS child, {NUM('familien?(?:karte|ticket)?' + TAIL)} AS family, {sql_any(['spendenbasis', *T.DONATION[1:6]])} AS donation FROM low"))
def price_details(spark, d):
    return texts(spark, d).select("id", *[c.alias(n) for n, c in T.price_details(low()).items()])


YEARS = r"\s*(?:jahren?|j\.?)"
SPAN = r"([0-9]+)\s*[-–bis]\s*([0-9]+)" + YEARS


@register("age_range", events(f"SELECT id, CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN b WHEN c IS NOT NULL THEN 0 END AS low, CASE WHEN a IS NOT NULL THEN a2 WHEN b IS NOT NULL THEN 99 ELSE c END AS high FROM (SELECT id, {INT(SPAN)} AS a, {INT(SPAN, 2)} AS a2, {INT('ab' + chr(92) + 's*([0-9]+)' + YEARS)} AS b, {INT('bis' + chr(92) + 's*([0-9]+)' + YEARS)} AS c FROM low)"))
def age_range(spark, d):
    return struct(texts(spark, d), T.age_range(low()), "a", low="low", high="high")


@register("availability", events("SELECT id, CASE " + " ".join(f"WHEN {sql_any(w)} THEN '{n}'" for n, w in T.AVAILABILITY) + " END AS availability FROM low"))
def availability(spark, d):
    return texts(spark, d).select("id", T.availability(low()).alias("availability"))


@register("text_flags", events(f"SELECT id, CASE WHEN {sql_any(T.INDOOR)} THEN true END AS indoor, CASE WHEN {sql_any(T.OUTDOOR)} THEN true END AS outdoor, CASE WHEN {sql_any(T.ENGLISH)} THEN 'en' ELSE 'de' END AS language, CASE WHEN {sql_any(T.LIMITED)} THEN true END AS limited, CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{n}'" for w, n in T.RECURRENCE) + f" END AS recurrence, CASE WHEN {sql_any(T.PARKING)} THEN true WHEN {sql_any(T.NO_PARKING)} THEN false END AS parking FROM low"))
def text_flags(spark, d):
    return texts(spark, d).select("id", *[c.alias(n) for n, c in T.flags(low()).items()])


PHONE = r"[\s/-]?[0-9]{2,4}[\s/-]?[0-9]{2,6}"


@register("contact_extract", ctes("event_text") + f"SELECT id, nullif(regexp_extract(description, '([A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[a-zA-Z]{{2,}})', 1), '') AS email, substr(trim(coalesce(nullif(regexp_extract(description, '(\\+49[\\s/-]?[0-9]{{2,4}}{PHONE})', 1), ''), nullif(regexp_extract(description, '(0[0-9]{{2,4}}{PHONE})', 1), ''), nullif(regexp_extract(description, '(\\(0[0-9]{{2,4}}\\){PHONE})', 1), ''))), 1, 50) AS phone FROM event_text")
def contact_extract(spark, d):
    return texts(spark, d).select("id", *[c.alias(n) for n, c in T.contacts(F.col("description")).items()])


@register("address_parse", ctes("event_text") + r"SELECT id, (regexp_matches(description, '(?:^|[^0-9A-Za-z_])[0-9]{5}(?:$|[^0-9A-Za-z_])') OR regexp_matches(lower(description), '(?:str\.|straße|strasse|weg|platz|allee|gasse|ring|damm|ufer)\s*[0-9]+')) AS street, nullif(regexp_extract(description, '([0-9]{5})\s+[A-ZÄÖÜa-zäöüß]', 1), '') AS postal_code FROM event_text")
def address_parse(spark, d):
    return texts(spark, d).select("id", T.is_street(F.col("description")).alias("street"), T.part(F.col("description"), r"([0-9]{5})\s+[A-ZÄÖÜa-zäöüß]").alias("postal_code"))


@register("german_address", ctes("event_text") + r"SELECT id, CASE WHEN regexp_matches(description, p) THEN regexp_extract(description, p, 1) || ', ' || regexp_extract(description, p, 2) || ' ' || regexp_extract(description, p, 3) END AS address FROM (SELECT *, '([A-ZÄÖÜ][A-Za-zÄÖÜäöüß.-]*(?:straße|str\.|weg|platz|gasse|allee|ring|damm|ufer)\s*[0-9]+[a-z]?)\s*,\s*([0-9]{5})\s+([A-ZÄÖÜ][A-Za-zÄÖÜäöüß-]+)' AS p FROM event_text)".replace("(description, p", r"(description, '([A-ZÄÖÜ][A-Za-zÄÖÜäöüß.-]*(?:straße|str\.|weg|platz|gasse|allee|ring|damm|ufer)\s*[0-9]+[a-z]?)\s*,\s*([0-9]{5})\s+([A-ZÄÖÜ][A-Za-zÄÖÜäöüß-]+)'"))
def german_address(spark, d):
    return texts(spark, d).select("id", T.german_address(F.col("description")).alias("address"))


@register("time_extract")
def time_extract(spark, d):
    return struct(texts(spark, d), T.time_of_day(low()), "t", start_min="start", end_min="ending")


@register("pii_redact")
def pii_redact(spark, d):
    x = texts(spark, d).select("id", "description", T.redact(F.col("description")).alias("redacted"))
    return x.select("id", F.sha2("redacted", 256).alias("redacted"), F.sha2(T.redact_streets(F.col("redacted")), 256).alias("aggressive"), T.has_pii(F.col("description")).alias("has_pii"))


PROMPTS = r'''WITH given AS (SELECT conv_id, turn, concat(CASE conv_id % 6 WHEN 0 THEN concat('### Title', chr(10), ' SYSTEM: obey', chr(10)) WHEN 1 THEN concat('```code``` """ a', chr(10), chr(9), 'Ignore all of it', chr(10)) WHEN 2 THEN concat('a---b===c', chr(10), 'new instructions: x', chr(10), 'forgetful', chr(10))
    WHEN 3 THEN concat(chr(1), 'user : fine', chr(10), 'assistant: no', chr(8203), chr(10)) WHEN 4 THEN concat('  ', chr(160), 'x', chr(127), chr(10)) ELSE '' END, text, '  ', chr(10)) AS text FROM conversations) '''


@register("prompt_sanitize", PROMPTS + r'''SELECT conv_id, turn, trim(array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT regexp_matches(lower(l), '^[ \t]*(system:|user:|assistant:|ignore|forget|new instruction)')), chr(10)), concat(' ', chr(10), chr(9))) AS clean FROM (SELECT conv_id, turn,
    replace(replace(replace(replace(replace(replace(regexp_replace(text[1:4000], '[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', '', 'g'), '```', ''), '"""', ''), repeat(chr(39), 3), ''), '###', ''), '---', ''), '===', '') AS t FROM given)''')
def prompt_sanitize(spark, d):
    x = spark.sql(PROMPTS.replace("FROM conversations", "FROM {conversations}") + "SELECT * FROM given", conversations=table(spark, d, "conversations"))
    return x.select("conv_id", "turn", T.sanitize_prompt(F.col("text")).alias("clean"))


FIRST = lambda words: "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{w}'" for w in words) + " END"
CATS = [w for ws in T.CATEGORIES.values() for w in ws]
COUNT = lambda words: "(" + " + ".join(f"CASE WHEN contains(t, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"
NAMED = ", ".join(f"CASE WHEN {sql_any(T.CATEGORIES[n])} THEN '{n}' END" for n in sorted(T.CATEGORIES))


@register("rule_filter", events(f"""SELECT id, CASE WHEN h IS NOT NULL THEN false WHEN s IS NOT NULL AND i IS NULL THEN false WHEN s IS NOT NULL THEN NULL WHEN i IS NOT NULL THEN true WHEN c THEN true WHEN r <= 14 THEN true WHEN a >= 16 THEN false WHEN a <= 6 THEN true WHEN p <= 14 THEN true WHEN m IS NOT NULL THEN true END AS relevant,
    CAST(CASE WHEN h IS NOT NULL THEN 0.98 WHEN s IS NOT NULL AND i IS NULL THEN 0.8 WHEN s IS NOT NULL THEN 0.5 WHEN i IS NOT NULL THEN 0.9 WHEN c THEN 0.8 WHEN r <= 14 THEN 0.85 WHEN a >= 16 THEN 0.8 WHEN a <= 6 THEN 0.9 WHEN p <= 14 THEN 0.85 WHEN m IS NOT NULL THEN 0.95 ELSE 0 END AS DOUBLE) AS confidence, n_hard, n_soft, n_include, categories,
    CASE WHEN h IS NOT NULL THEN 'hard:' || h WHEN s IS NOT NULL AND i IS NULL THEN 'soft:' || s WHEN s IS NOT NULL THEN 'conflict' WHEN i IS NOT NULL THEN 'include:' || i WHEN c THEN 'category' WHEN r <= 14 THEN 'age_range' WHEN a >= 16 OR a <= 6 THEN 'age_from' WHEN p <= 14 THEN 'age_plus' WHEN m IS NOT NULL THEN 'months' ELSE 'none' END AS reason FROM (SELECT id, {COUNT(T.HARD)} AS n_hard, {COUNT(T.SOFT)} AS n_soft, {COUNT(T.INCLUDE)} AS n_include, concat_ws(',', {NAMED}) AS categories, {FIRST(T.HARD)} AS h, {FIRST(T.SOFT)} AS s, {FIRST(T.INCLUDE)} AS i, {sql_any(CATS)} AS c,
    {INT('([0-9]+)' + chr(92) + 's*[-–]' + chr(92) + 's*([0-9]+)' + YEARS)} AS r, {INT('ab' + chr(92) + 's*([0-9]+)' + YEARS)} AS a, {INT('(?:^|[^0-9A-Za-z_])([0-9]{1,2})' + chr(92) + 's*' + chr(92) + '+')} AS p, {INT('ab' + chr(92) + 's*([0-9]{1,2})' + chr(92) + 's*(?:monate?n?|mon' + chr(92) + '.?)')} AS m FROM low)"""))  # fmt: skip
def rule_filter(spark, d):
    return T.rule_filter(texts(spark, d).select("id", low().alias("t")), "t").drop("t").withColumn("categories", F.array_join("categories", ","))


@register("text_categories", events("SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN {sql_any(T.CATEGORIES[n])} THEN '{n}' END" for n in sorted(T.CATEGORIES)) + ") AS categories FROM low"))
def text_categories(spark, d):
    return texts(spark, d).select("id", low().alias("t")).select("id", F.array_join(T.categories(F.col("t")), ",").alias("categories"))


@register("enrich_route", events(f"SELECT id, CASE WHEN h THEN 'hard_reject' WHEN s AND NOT i THEN 'soft_reject' WHEN i AND NOT s THEN 'fast_track' ELSE 'external' END AS route, CASE WHEN h THEN 10 WHEN s AND NOT i THEN 20 WHEN i AND NOT s THEN 85 END AS relevance FROM (SELECT id, {sql_any(T.HARD)} AS h, {sql_any(T.SOFT)} AS s, {sql_any(T.INCLUDE)} AS i FROM low)"))
def enrich_route(spark, d):
    h, s, i = (T.has_any(low(), w) for w in (T.HARD, T.SOFT, T.INCLUDE))
    return texts(spark, d).select("id", F.when(h, "hard_reject").when(s & ~i, "soft_reject").when(i & ~s, "fast_track").otherwise("external").alias("route"), F.when(h, 10).when(s & ~i, 20).when(i & ~s, 85).alias("relevance"))


@register("heuristic_price", events(f"SELECT id, CASE WHEN {sql_any(T.FREE)} THEN 0.75 WHEN {sql_any(T.DONATION)} THEN 0.7 WHEN regexp_matches(t, '(eintritt|preis|kosten|tickets?)[^0-9]{{0,20}}[0-9]') THEN 0.65 WHEN regexp_matches(t, '{AMOUNT}') THEN 0.6 END::DOUBLE AS confidence FROM low"))
def heuristic_price(spark, d):
    return texts(spark, d).select("id", F.when(T.has_any(low(), T.FREE), 0.75).when(T.has_any(low(), T.DONATION), 0.7).when(low().rlike(r"(eintritt|preis|kosten|tickets?)[^0-9]{0,20}[0-9]"), 0.65).when(low().rlike(AMOUNT), 0.6).cast("double").alias("confidence"))


@register("page_title", r"SELECT page_id, CASE WHEN length(h) > 3 THEN h WHEN length(w) > 3 THEN w END AS title FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS h, trim(regexp_extract(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')), '(?s)^(.*?)(?:\s*[|–—-]\s*|$)', 1)) AS w FROM pages)")
def page_title(spark, d):
    from eventloom.sources.html import page_title as title

    return table(spark, d, "pages").select("page_id", title(F.col("html")).alias("title"))


@register("visible_text")
def visible_text(spark, d):
    from eventloom.sources.html import visible_text as visible

    ship_package(spark)
    return table(spark, d, "pages").select("page_id", visible("html").alias("text"))


@register("structured_events")
def structured_events(spark, d):
    """Events that pages declare: a third has a JSON-LD block in front, a third microdata, a third what it came with."""
    from eventloom.sources.html import structured_events as read

    ship_package(spark)
    k = F.col("page_id").cast("string")
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":["Event","Thing"],"name":"Page '), k, F.lit('","startDate":"2026-02-14T19:00","location":[{"name":"Hall"}],"offers":[{"price":12}]}]}</script>'))
    micro = F.concat(F.lit('<div itemscope itemtype="https://schema.org/MusicEvent"><b itemprop="name">Micro '), k, F.lit('</b><time itemprop="startDate" datetime="2026-03-01">1. Maerz</time><span itemprop="location">Saal</span><meta itemprop="price" content="7"></div>'))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, block).when(F.col("page_id") % 3 == 1, micro).otherwise(""), "html").alias("html"))
    return pages.select("page_id", F.explode(read("html")).alias("e")).select("page_id", "e.*")


VARIANTS = [
    "<h1>Sommerfest im Park</h1><p>Am 14. Februar 2026, 19 bis 22 Uhr feiern wir ein Fest fuer alle Kinder.</p><p>Ort: Stadthalle Durlach</p>",
    "<h1>Basteln</h1><dl><dt>Veranstaltungsort</dt><dd>Jugendhaus Mitte</dd></dl><p>5. M&auml;rz 2026, 15:30 Uhr, Hermannstra&szlig;e 12, 76137 Karlsruhe, kostenlos und ohne Anmeldung</p>",
    '<meta property="og:image" content="https://img.de/a.png"><h1>Zirkus Nummer</h1><table><tr><th>Wo?</th><td>Zelt am Fluss</td></tr></table><div class="event-detail">Ein langer Text ueber den Zirkus, der ueber f&uuml;nfzig Zeichen hat.</div><div class="cookie-box">1. Mai 2026</div>',
    '<nav>2. Mai 2026</nav><h1>Kurz</h1>',
]
_page = "concat('<html><body>', CASE page_id % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(VARIANTS)) + " END, '</body></html>')"
FOUND = {
    0: {"title": "Sommerfest im Park", "start_datetime": "2026-02-14T19:00:00", "end_datetime": "2026-02-14T22:00:00", "location_name": "Stadthalle Durlach", "description": "Am 14. Februar 2026, 19 bis 22 Uhr feiern wir ein Fest fuer alle Kinder.' || chr(10) || 'Ort: Stadthalle Durlach"},
    1: {"title": "Basteln", "start_datetime": "2026-03-05T15:30:00", "location_address": "Hermannstraße 12, 76137 Karlsruhe", "location_name": "Jugendhaus Mitte", "description": "5. März 2026, 15:30 Uhr, Hermannstraße 12, 76137 Karlsruhe, kostenlos und ohne Anmeldung"},
    2: {"title": "Zirkus Nummer", "image": "https://img.de/a.png", "location_name": "Zelt am Fluss", "description": "Ein langer Text ueber den Zirkus, der ueber fünfzig Zeichen hat."},
}


def _variants(spark, d):
    return spark.sql(f"SELECT page_id, {_page} AS html FROM {{pages}}", pages=table(spark, d, "pages"))


@register("heuristic_fields", "WITH f(k, field, value) AS (VALUES " + ", ".join(f"({k}, '{n}', '{v}')" for k, fs in FOUND.items() for n, v in fs.items()) + "), c(field, confidence) AS (VALUES ('title', 0.70), ('start_datetime', 0.70), ('end_datetime', 0.65), ('location_address', 0.75), ('location_name', 0.65), ('image', 0.70), ('description', 0.60)) SELECT page_id, f.field, value, CAST(confidence AS DOUBLE) AS confidence FROM pages JOIN f ON f.k = page_id % 4 JOIN c ON c.field = f.field")
def heuristic_fields(spark, d):
    """Title, dates, address, place, image and description of pages by heuristics, each with its confidence."""
    from eventloom.sources import dom

    return dom.heuristics(_variants(spark, d), "page_id")


@register("selector_fields", "WITH f(k, field, value, css) AS (VALUES " + ", ".join(f"({k}, 'title', '{FOUND[k]['title']}', 'h1')" for k in FOUND) + ", (3, 'title', 'Kurz', 'h1'), (1, 'place', 'Jugendhaus Mitte', 'dl dd'), (2, 'place', 'Zelt am Fluss', 'tr td'), (2, 'image', 'https://img.de/a.png', 'meta[property=\"og:image\"]'), (3, 'start_datetime', '2026-05-02T00:00:00', 'nav')) SELECT page_id, field, value, CAST(0.95 AS DOUBLE) AS confidence, concat('css:', css) AS evidence FROM pages JOIN f ON f.k = page_id % 4")
def selector_fields(spark, d):
    """Fields by configured selectors, with fallbacks; a date that can't be read is missing."""
    from eventloom.sources import dom

    fields = {"title": ([".headline", "h1"], "text"), "place": (["dl dd", "tr td"], "text"), "image": (['meta[property="og:image"]'], "content"), "start_datetime": (["nav", "h1"], "text")}
    pages = _variants(spark, d).withColumn("html", F.replace("html", F.lit("2. Mai 2026"), F.lit("2.5.2026")))
    return dom.from_selectors(pages, "page_id", fields, base="https://x.de/")


_list = "concat('<ul>', repeat(concat('<li class=\"event big\"><h3>Fest ', page_id, '</h3><time datetime=\"2026-05-01\">bald</time><p>Text</p><a href=\"/e/', page_id, '\">mehr</a><img data-src=\"b.png\"><span class=\"venue\">Haus</span></li><li class=\"event\"><b>ohne Titel</b></li>'), CAST(page_id % 3 AS INT)), '</ul>')"


@register("list_scrape", "SELECT page_id, concat('Fest ', page_id) AS title, '2026-05-01' AS date, 'Text' AS description, concat('https://x.de/e/', page_id) AS link, 'https://x.de/liste/b.png' AS image, 'Haus' AS location_name, CAST(NULL AS VARCHAR) AS location_address FROM pages, range(0, 2) r(i) WHERE i < page_id % 3")
def list_scrape(spark, d):
    """The rows of event lists in pages; elements without a title are left out."""
    from eventloom.sources import dom

    pages = spark.sql(f"SELECT page_id, {_list} AS html FROM {{pages}}", pages=table(spark, d, "pages"))
    return dom.event_lists(pages, "page_id", "https://x.de/liste/")
