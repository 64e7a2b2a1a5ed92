"""Dates and times in German event texts, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import part

#: Month names, abbreviations and weekday prefixes, the patterns of dates and times.
MONTHS = {
    "januar": 1, "februar": 2, "märz": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12,
    "jan": 1, "feb": 2, "mär": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dez": 12,
}
FULL = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
SHORT = "Jan|Feb|Mär|Apr|Jun|Jul|Aug|Sep|Okt|Nov|Dez"
WEEKDAY = r"(?:Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Mo|Di|Mi|Do|Fr|Sa|So)[.,]?\s*"
TIME = r"([0-9]{1,2})[:.]([0-9]{2})\s*(?:Uhr)?|([0-9]{1,2})\s*Uhr"
RANGE = r"([0-9]{1,2})[:.]?([0-9]{2})?\s*(?:bis|–|—|-)\s*([0-9]{1,2})[:.]?([0-9]{2})?\s*(?:Uhr)?"
#: How far after a date its time may stand, in characters.
REACH = 120
#: kind -> (pattern, groups of year, month, day)
PLAIN = {"long": (rf"([0-9]{{1,2}})\.\s*({FULL})\s+([0-9]{{4}})", (3, 2, 1)), "short": (r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})", (3, 2, 1))}
EXTENDED = {
    "long": (rf"([0-9]{{1,2}})\.\s*({FULL}|{SHORT})\.?\s+([0-9]{{4}}|[0-9]{{2}})", (3, 2, 1)), "iso": (r"([0-9]{4})-([0-9]{2})-([0-9]{2})", (1, 2, 3)),
    "short": (r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}|[0-9]{2})", (3, 2, 1)),
}
#: Configured formats in the order in which they are tried: pattern, groups of year, month, day, and whether a time follows.
FORMATS = {
    "DD.MM.YYYY HH:mm": (r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})\s+([0-9]{1,2}):([0-9]{2})", (3, 2, 1), True), "DD.MM.YYYY": (r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})", (3, 2, 1), False),
    "YYYY-MM-DDTHH:mm": (r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2})", (1, 2, 3), True), "YYYY-MM-DD": (r"([0-9]{4})-([0-9]{2})-([0-9]{2})", (1, 2, 3), False),
    "DD.MM.YY HH:mm": (r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{2})\s+([0-9]{1,2}):([0-9]{2})", (3, 2, 1), True), "DD.MM.YY": (r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{2})", (3, 2, 1), False),
}


def _day(y: Column, m: Column, d: Column) -> Column:
    """A day between 2020 and 2030, null where there is none such."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(y.between(2020, 2030), F.concat_ws("-", y.cast("string"), two(m), two(d)).try_cast("date"))


def _at(day: Column, hour: Column, minute: Column) -> Column:
    """A time on a day, null where there is none such."""
    return F.when(hour.between(0, 23) & minute.between(0, 59), day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute))


def with_datetime(texts: DataFrame, column: str, extended: bool = False) -> DataFrame:
    """texts with (starts, ends): the first date, the long form before others, and a time or a range of times close after it.
    A range that ends before it starts ends on the next day; without a time a day starts at midnight. extended also knows
    abbreviated months, ISO days, two-digit years and weekdays before a date."""
    kinds = EXTENDED if extended else PLAIN
    clean = F.regexp_replace(column, f"(?iu){WEEKDAY}", "") if extended else F.col(column)
    x = texts.withColumn("__t", clean)
    found = {}
    for name, (pattern, (y, m, d)) in kinds.items():
        whole = rf"(?isu){pattern}(.{{0,{REACH}}})"
        found[name] = F.struct(*[part("__t", whole, g).alias(n) for n, g in (("y", y), ("m", m), ("d", d))], F.regexp_extract("__t", whole, 4).alias("near"))
    x = x.withColumns({f"__{n}": c for n, c in found.items()})
    first = F.coalesce(*[F.when(F.col(f"__{n}.y").isNotNull(), F.col(f"__{n}")) for n in kinds])
    x = x.withColumn("__f", first)
    months = F.create_map(*[F.lit(v) for k in MONTHS.items() for v in k])
    year = F.col("__f.y").try_cast("int")
    month = F.coalesce(F.try_element_at(months, F.lower("__f.m")), F.col("__f.m").try_cast("int"))
    x = x.withColumn("__day", _day(F.when(year < 100, year + 2000).otherwise(year), month, F.col("__f.d").try_cast("int")))
    span = RANGE.replace("bis|", "bis|und|") if extended else RANGE
    number = lambda p, g: part(F.col("__f.near"), f"(?iu){p}", g).try_cast("int")
    zero = lambda c: F.coalesce(c, F.lit(0))
    x = x.withColumns({"__h1": number(span, 1), "__m1": zero(number(span, 2)), "__h2": number(span, 3), "__m2": zero(number(span, 4)), "__h": F.coalesce(number(TIME, 3), number(TIME, 1)), "__m": zero(number(TIME, 2))})
    x = x.withColumns({"__a": _at(F.col("__day"), F.col("__h1"), F.col("__m1")), "__b": _at(F.col("__day"), F.col("__h2"), F.col("__m2")), "__s": _at(F.col("__day"), F.col("__h"), F.col("__m"))})
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    midnight = F.col("__day").cast("timestamp_ntz")
    starts = F.when(both, F.col("__a")).when(F.col("__h1").isNotNull(), midnight).otherwise(F.coalesce("__s", midnight))
    ends = F.when(both, F.when(F.col("__b") <= F.col("__a"), F.col("__b") + F.expr("INTERVAL '1' DAY")).otherwise(F.col("__b")))
    return x.select(*texts.columns, starts.alias("starts"), ends.alias("ends"))


def with_formats(texts: DataFrame, column: str, formats: list[str] | None = None) -> DataFrame:
    """texts with `parsed`: ISO 8601 first (a zone is cut off), then the configured formats in order."""
    chosen = {f"__{k}": FORMATS[name] for k, name in enumerate(formats or list(FORMATS))}
    x = texts.withColumn("__v", F.trim(column))
    bare = F.when(F.col("__v").contains("T"), F.regexp_replace("__v", r"(?:Z|\+.*)$", "")).otherwise(F.col("__v"))
    number = lambda p, g: part(F.col("__v"), p, g).try_cast("int")
    got = {k: F.struct(*[number(p, g).alias(n) for n, g in [*zip("ymd", days), *([("h", 4), ("n", 5)] if timed else [])]]) for k, (p, days, timed) in chosen.items()}
    x = x.withColumns(got | {"__b": bare})
    iso = F.when(F.col("__b").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)?$"), F.col("__b").try_cast("timestamp_ntz"))
    tried = [iso]
    for k, (_, _, timed) in chosen.items():
        year = F.col(f"{k}.y") + F.when(F.col(f"{k}.y") < 100, 2000).otherwise(0)
        tried.append(_at(_day(year, F.col(f"{k}.m"), F.col(f"{k}.d")), F.col(f"{k}.h") if timed else F.lit(0), F.col(f"{k}.n") if timed else F.lit(0)))
    return x.select(*texts.columns, F.coalesce(*tried).alias("parsed"))
