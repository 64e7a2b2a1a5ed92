"""The event identities: five fingerprints and the keys beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.operators.geo import geohash

#: Words that the deduplication title leaves out.
STOP_WORDS = ["der", "die", "das", "und", "oder", "in", "im", "am", "an", "auf", "für", "mit", "von", "zu", "zum", "zur", "bei", "the", "a", "an", "and", "or"]


def short_sha(key: Column) -> Column:
    """The first 32 digits of SHA-256."""
    return F.substring(F.sha2(key, 256), 1, 32)


def dedup_title(title: Column) -> Column:
    """Lower case without dates, years, times, punctuation and stop words."""
    t = F.regexp_replace(F.lower(title), r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}|[0-9]{4}|[0-9]{1,2}:[0-9]{2}", "")
    t = F.regexp_replace(t, r"[^a-z0-9_äöüß\s]", "")
    return F.array_join(F.filter(F.split(F.trim(t), r"\s+"), lambda w: ~w.isin(*STOP_WORDS) & (w != "")), " ")


def fp_dedup(title: Column, start: Column, lat: Column, lng: Column) -> Column:
    """Title, local hour and geohash; a time without zone is local already."""
    return short_sha(F.concat(dedup_title(title), F.lit("|"), F.coalesce(F.date_format(start, "yyyy-MM-dd'T'HH"), F.lit("")), F.lit("|"), F.coalesce(geohash(lat, lng), F.lit(""))))


def fp_feed(title: Column, start: Column, place: Column) -> Column:
    """Title, day and the first 50 characters of the place."""
    return short_sha(F.concat(F.trim(F.lower(title)), F.lit("|"), F.coalesce(F.date_format(start, "yyyy-MM-dd"), F.lit("")), F.lit("|"), F.substring(F.coalesce(F.lower(place), F.lit("")), 1, 50)))


def fp_candidate(external: Column, url: Column, title: Column, start: Column, address: Column) -> Column:
    """The external id and day, else the URL and day, else title, day and address."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9_äöüß\s]", "")), r"\s+", " ")
    day = F.coalesce(F.date_format(start, "yyyy-MM-dd"), F.lit(""))
    rest = F.concat(clean, F.lit("|"), day, F.lit("|"), F.substring(F.coalesce(F.lower(address), F.lit("")), 1, 50))
    return short_sha(F.coalesce(F.concat(external, F.lit("|"), day), F.concat(url, F.lit("|"), day), rest))


def fp_backend(title: Column, start: Column, lat: Column, lng: Column) -> Column:
    """ASCII title, UTC day and coordinates to three places."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.lower(title), r"[^A-Za-z0-9_\s]", "")), r"\s+", " ")
    return short_sha(F.concat(clean, F.lit("|"), F.date_format(start, "yyyy-MM-dd"), F.lit("|"), F.coalesce(three_places(lat), F.lit("")), F.lit("|"), F.coalesce(three_places(lng), F.lit(""))))


def three_places(x: Column) -> Column:
    """A double to three decimal places by its exact binary value (format_string rounds the shortest decimal form instead)."""
    a = F.abs(x)
    n = F.floor(a * 1000)
    wide = a * 134217729.0
    high = wide - (wide - a)  # the upper half of the digits, so that both products below are exact
    up = (high * 2000 - (2 * n + 1)) + (a - high) * 2000 >= 0
    n = n + up.cast("int")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


def fp_import(title: Column, published: Column) -> Column:
    """Title and the feed's date text."""
    return short_sha(F.concat(title, published))
