"""Feeds and calendars as tables: RSS and Atom, iCalendar, sitemaps, robots files, content sniffing, and the text sinks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import once, squeeze
from eventloom.session import staged

#: Paths of event pages in sitemaps.
EVENT_PATHS = "/event[s]?/|/veranstaltung(en)?/|/termine?/|/kalender/|/programm/|/aktivitaet(en)?/|/angebot(e)?/"


#: Blocks that are not public.
PRIVATE = [("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16)]


def rss_items(feeds: DataFrame, body: str = "body") -> DataFrame:
    """feeds' columns and (title, link, guid, published, description) for every item or entry with a title. Works on whole
    feed texts with regular expressions in the engine."""
    blocks = feeds.withColumn("__item", F.explode(F.regexp_extract_all(body, F.lit(r"(?is)(<(?:item|entry)[\s>].*?</(?:item|entry)>)"), 1)))
    tag = lambda name: F.nullif(squeeze(F.regexp_replace(F.regexp_replace(F.regexp_extract("__item", rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]+>", "")), F.lit(""))
    link = F.coalesce(tag("link"), F.nullif(F.regexp_extract("__item", r"(?is)<link[^>]*href=[\"']([^\"']+)", 1), F.lit("")))
    title = F.substring(tag("title"), 1, 255)
    rows = blocks.select(*feeds.columns, title.alias("title"), F.substring(link, 1, 500).alias("link"), F.coalesce(tag("guid"), tag("id"), link, F.md5(title)).alias("guid"), F.coalesce(tag("pubDate"), tag("published"), tag("updated")).alias("published"), F.substring(F.coalesce(tag("description"), tag("summary")), 1, 5000).alias("description"))
    return rows.where("title is not null").drop(body)


def ics_events(feeds: DataFrame, body: str = "body") -> DataFrame:
    """feeds' columns and (uid, summary, starts, ends, location) for every VEVENT; folded lines are joined, HTML gives none."""
    plain = F.regexp_replace(F.regexp_replace(F.col(body), "\r\n?", "\n"), "\n[ \t]", "")
    blocks = feeds.where(~F.lower(F.regexp_replace(F.substring(body, 1, 200), r"^\s+", "")).rlike("^<(!doctype|html)")).withColumn("__e", F.explode(F.regexp_extract_all(plain, F.lit("(?s)BEGIN:VEVENT\n(.*?)\nEND:VEVENT"), 1)))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("__e", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1)), F.lit(""))
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";")), F.lit("\\n"), F.lit("\n"))

    def when(c: Column) -> Column:
        digits = F.regexp_replace(c, "[^0-9]", "")
        return F.coalesce(F.try_to_timestamp(F.when(F.length(digits) >= 14, F.substring(digits, 1, 14)), F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")))

    summary = text(field("SUMMARY"))
    return blocks.select(*[c for c in feeds.columns if c != body], F.coalesce(field("UID"), F.md5(F.concat(summary, field("DTSTART")))).alias("uid"), summary.alias("summary"), when(field("DTSTART")).alias("starts"), when(field("DTEND")).alias("ends"), text(field("LOCATION")).alias("location")).where("summary is not null")


def sitemap_urls(maps: DataFrame, body: str = "body", most: int = 200) -> DataFrame:
    """(url): the event pages that sitemaps list, without repeats, `most` at the most (a report's limit)."""
    urls = maps.select(F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)).alias("url"))
    return urls.where(F.lower(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))).rlike(EVENT_PATHS)).distinct().orderBy("url").limit(most)


def walk_sitemaps(starts: DataFrame, documents: DataFrame, most: int = 200) -> DataFrame:
    """(site, place, url): the first `most` event pages (a report's limit) of each site of starts (site, address), in the order in which a
    reader finds them who opens the sitemaps first seen first.

    documents is (address, body); of several bodies of an address the least counts, missing ones list nothing. Entries that end in
    `.xml` and name a sitemap are opened, once each, however deep they are nested and whether or not they list each other. Each level is
    one join of the frontier with the documents; an entry's order is the path of its positions, so no level needs a global order. Sites
    that have their pages leave the frontier. A page may be listed under many maps; the first counts. Null addresses list nothing.
    """
    frontier = staged(starts.where("address is not null").select("site", "address", F.lit("").alias("path")).distinct(), "frontier")
    seen, found, level = frontier.select("site", "address"), None, 0
    entry = r"(?is)<(?:[\w.-]+:)?loc(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</"
    while not frontier.isEmpty():
        opened = frontier.join(documents.select("address", "body"), "address").groupBy("site", "address", "path").agg(F.min("body").alias("body"))
        listed = opened.select("site", "path", F.posexplode(F.regexp_extract_all("body", F.lit(entry), 1)).alias("at", "loc")).where("loc <> ''")
        loc = F.col("loc")
        for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
            loc = F.replace(loc, F.lit(f"&{name};"), F.lit(sign))
        listed = listed.select("site", loc.alias("address"), F.concat("path", F.lpad(F.col("at").cast("string"), 9, "0")).alias("path"))
        is_map = F.col("address").endswith(".xml") & F.lower("address").contains("sitemap")
        is_page = ~is_map & F.lower(F.coalesce(F.try_parse_url("address", F.lit("PATH")), F.lit(""))).rlike(EVENT_PATHS)
        new = listed.where(is_map | is_page).groupBy("site", "address").agg(F.min("path").alias("path")).join(seen, ["site", "address"], "left_anti")
        new = staged(new.select("*", is_map.alias("is_map"), F.lit(level).alias("level")), "frontier")
        seen = seen.union(new.select("site", "address"))
        pages = new.where("not is_map").select("site", "level", "path", "address")
        found = pages if found is None else found.union(pages)
        ready = found.groupBy("site").count().where(F.col("count") >= most)
        frontier = staged(new.where("is_map").join(ready, "site", "left_anti").select("site", "address", "path"), "frontier")
        level += 1
    if found is None:
        return starts.where("false").select("site", F.lit(0).alias("place"), F.lit("").alias("url"))
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("level", "path")))
    return placed.where(F.col("place") <= most).select("site", "place", F.col("address").alias("url"))


def listed_maps(index: DataFrame, maps: DataFrame, body: str = "body", address: str = "address") -> DataFrame:
    """The maps that sitemap indexes list, and texts that are no index themselves. One level, as indexes must not list indexes."""
    is_index = F.lower(body).contains("<sitemapindex")
    named = index.where(is_index).select(F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)).alias(address)).distinct()
    return maps.join(named, address, "left_semi").select(body).union(index.where(~is_index).select(body))


def robots_sitemap(body: Column) -> Column:
    """The first sitemap that a robots file names."""
    return F.nullif(F.trim(F.regexp_extract(body, r"(?im)^\s*sitemap:(.*)$", 1)), F.lit(""))


def sniff(content_type: Column, body: Column) -> Column:
    """rss, ics, html or unknown, by header and then by the first characters."""
    head, start = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.regexp_replace(F.substring(body, 1, 500), r"^\s+", ""))
    return (
        F.when(head.contains("calendar"), "ics").when(head.rlike("rss|atom|xml"), "rss").when(start.startswith("begin:vcalendar"), "ics")
        .when(start.rlike(r"^(<\?xml|<rss|<feed)"), "rss").when(start.rlike(r"^(<!doctype html|<html)") | head.contains("html"), "html").otherwise("unknown")
    )


def ical(title: Column, start: Column, end: Column, uid: Column, place: Column, status: Column) -> Column:
    """One VEVENT; without an end an event lasts two hours."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,")), F.lit("\n"), F.lit("\\n"))
    at = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    line = lambda name, c: F.concat(F.lit(name + ":"), c)
    return F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), line("UID", uid), line("DTSTART", at(start)), line("DTEND", at(F.coalesce(end, start + F.expr("INTERVAL '2' HOUR")))), line("SUMMARY", safe(title)), line("LOCATION", safe(place)), line("STATUS", status), F.lit("END:VEVENT"))


def ipv6_digits(address: Column) -> Column:
    """An IPv6 address of any spelling as its 32 hexadecimal digits; null if it is none."""
    last = r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})$"
    byte = lambda b, k: F.lpad(F.lower(F.hex(F.get(b, F.lit(k)))), 2, "0")
    groups = lambda sides, k: F.filter(F.split(F.coalesce(F.get(sides, F.lit(k)), F.lit("")), ":"), lambda g: (g != "") | F.get(sides, F.lit(k)).contains(":"))

    def hexadecimal(dotted):
        """The address with its last four bytes as two groups."""
        plain = lambda b: F.when(~F.exists(b, lambda x: x > 255), F.concat(F.regexp_replace(address, last, ""), byte(b, 0), byte(b, 1), F.lit(":"), byte(b, 2), byte(b, 3)))
        return F.when(dotted == "", address).otherwise(once(F.transform(F.split(dotted, r"\."), lambda x: x.try_cast("int")), plain))

    def whole(sides):
        """The groups, those that `::` leaves out included."""
        both = lambda p: F.concat(p["a"], F.array_repeat(F.lit("0"), F.greatest(8 - F.size(p["a"]) - F.size(p["b"]), F.lit(0))), p["b"])
        gap = lambda p: F.when(F.size(p["a"]) + F.size(p["b"]) < 8, both(p))
        return F.when(F.size(sides) == 1, groups(sides, 0)).when(F.size(sides) == 2, once(F.struct(groups(sides, 0).alias("a"), groups(sides, 1).alias("b")), gap))

    def digits(full):
        """The groups as digits, if they are eight of one to four."""
        right = (F.size(full) == 8) & F.forall(full, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(right, F.lower(F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")))

    plain = once(F.regexp_extract(address, last, 1), hexadecimal)
    return once(once(F.split(plain, "::"), whole), digits)


def ipv4_inside(digits: Column) -> Column:
    """The IPv4 address that an IPv6 address (32 digits) maps or holds in its last four bytes, else null."""
    byte = lambda k: F.conv(F.substring(digits, 25 + 2 * k, 2), 16, 10)
    held = digits.rlike("^0{20}(?:ffff|0000)") & ~digits.rlike("^0{28}")
    return F.when(held, F.concat_ws(".", *[byte(k) for k in range(4)]))


def unsafe_url(url: Column) -> Column:
    """Why a URL must not be fetched: not http, no host, or a literal address in a private block; null if it may. Numbers are
    read as resolvers read them: one to four parts, decimal, octal or hexadecimal. Names are for the caller to resolve."""
    scheme, rest = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":[0-9]*$", ""))
    digits = ipv6_digits(F.regexp_extract(host, r"^\[([0-9a-f:.]+)(?:%.*)?\]$", 1))
    private = once(digits, lambda six: once(F.coalesce(ipv4_inside(six), host), _private_ipv4) | F.coalesce(six.rlike("^(?:0{31}1$|f[cd]|fe[89ab])"), F.lit(False)))
    return F.when(~scheme.isin("http", "https"), "scheme").when(host == "", "host").when((host == "localhost") | private, "address")


def _private_ipv4(literal: Column) -> Column:
    """Whether a text is an IPv4 address, in any spelling, in a private block."""
    value = lambda p: F.when(p.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(p, 3, 16), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).when(p.rlike("^[0-9]+$"), p).try_cast("bigint")
    none = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(24).alias("shift"))

    def add(acc, v):
        """One more of the parts before the last."""
        return F.struct((acc["sum"] + v * F.pow(F.lit(2), acc["shift"]).cast("bigint")).alias("sum"), (acc["shift"] - 8).alias("shift"))

    def number(parts):
        """The address as a number; the last part fills all the bytes that are left."""
        whole = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), none, add, lambda acc: acc["sum"]) + F.element_at(parts, -1)
        return F.when((F.size(parts) <= 4) & ~F.exists(parts, lambda v: v.isNull()), whole)

    def inside(four):
        """Whether a number lies in a private block."""
        block = lambda text, bits: F.floor(four / 2 ** (32 - bits)) == int.from_bytes(bytes(map(int, text.split("."))), "big") >> (32 - bits)
        return F.coalesce(functools.reduce(lambda a, b: a | b, [block(t, b) for t, b in PRIVATE]), F.lit(False))

    return once(once(F.transform(F.split(literal, r"\."), value), number), inside)
