"""Dates written in any usual order, as staged column expressions: a time and its zone are cut out, the rest becomes tokens, and
the places of month names and long numbers among them tell year, month and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English names with their usual abbreviations, and words that may stand between the parts of a date.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
BETWEEN = ["at", "on", "and", "ad", "m", "t", "of", "st", "nd", "rd", "th"]
ZONE = r"(?:\s*(z|utc|gmt)(?![a-z]))?(?:\s*([+-])([0-9]{1,2}):([0-9]{2})(?![0-9])|\s*([+-])([0-9]{2})([0-9]{2})(?![0-9])|\s*([+-])([0-9]{1,2})(?![0-9]))?"
#: kind -> (pattern, groups of hour, minute, second, fraction, half of the day, group before the zone's)
TIMES = {
    "colon": (r"(?<![0-9:])([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2})(?:[.,]([0-9]+))?)?(?![0-9:])(?:\s*([ap])(?:\.?m)?\.?(?![a-z]))?" + ZONE, (1, 2, 3, 4, 5), 5),
    "word": (r"(?<![0-9:.])([0-9]{1,2})\s*(?:hours|hour|h)(?![a-z])(?:([0-9]{1,2})(?![0-9])|\s*([0-9]{1,2})\s*(?:minutes|minute|m)(?![a-z]))?" + ZONE, (1, 2, None, None, None), 3),
    "half": (r"(?<![0-9:.])([0-9]{1,2})\s*([ap])(?:\.?m)?\.?(?![a-z])" + ZONE, (1, None, None, None, 2), 2),
}


def _names(words: list[str], extra: dict[str, int]) -> Column:
    """A map from names and three letters to their number, from 1."""
    known = {w[:n]: k for k, w in enumerate(words, 1) for n in (3, len(w))} | extra
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])


def _zone(text: Column, pattern: str, before: int) -> Column:
    """Seconds that a time is ahead of UTC; null if no zone is told. After a zone's name the sign means the opposite."""
    got = lambda g: F.nullif(F.regexp_extract(text, pattern, before + g), F.lit(""))
    sign, hours, minutes = F.coalesce(got(2), got(5), got(8)), F.coalesce(got(3), got(6), got(9)), F.coalesce(got(4), got(7), F.lit("0"))
    ahead = (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60) * F.when((sign == "+") == got(1).isNull(), 1).otherwise(-1)
    return F.when(sign.isNotNull(), ahead).when(got(1).isNotNull(), 0)


def with_any_date(texts: DataFrame, column: str, now: Column | str, zone: str = "Europe/Berlin") -> DataFrame:
    """texts with `read` (the date and time as written) and `instant` (in UTC), both null where the text can't be read.

    Numbers are month, day, year, unless the first is above 12 (day, month, year) or above 31 or of three or more digits (year,
    month, day); a month's name and a long year fix their own places. 6, 8, 12 and 14 digits are dates without separators. Years
    of two digits are those within fifty years of `now`, whose day also gives parts that are missing (its month's last day at
    most); a weekday alone is the next such day. Times are `19:30`, `19h30` or `7 pm`, 2 or 4 digits after
    a whole date, or 6 digits after any part of one; `13 pm` is 13 unless a whole date is there.
    A text without a zone, or with the abbreviation of one, is local in `zone`: the second of an hour that
    comes twice, winter time in one that is skipped. Of weekdays the last counts. Null, empty texts, other words, parts
    that are out of range and a second time give null."""
    now = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    x = texts.withColumn("__o", F.trim(F.regexp_replace(F.col(column).cast("string"), r"\s+", " ")))
    months, days = _names(MONTHS, {"sept": 9}), _names(DAYS, {})
    own = "|".join(sorted({w[:n].upper() for w in [*MONTHS, *DAYS] for n in (3, len(w))} | {"SEPT", "UTC", "GMT"}))
    x = x.withColumn("__v", F.lower(F.regexp_replace("__o", rf"([0-9AaPpMmHh.:] ?)(?<![A-Za-z])(?!(?:{own})(?![A-Za-z]))[A-Z]{{3,5}}(?![A-Za-z+-])", "$1~")))
    v = F.col("__v")
    hits = {k: F.regexp_count(v, F.lit(p)) for k, (p, _, _) in TIMES.items()}
    x = x.withColumn("__kind", F.coalesce(*[F.when(n == 1, F.lit(k)) for k, n in hits.items()]))
    # a zone's abbreviation counts only after a time
    x = x.withColumn("__v", F.when(F.col("__kind").isNotNull(), F.regexp_replace("__v", "~", " ")).otherwise(v))

    def timed(name: str, place: int) -> Column:
        got = lambda p, g: F.regexp_extract(F.col("__v"), p, g) if g else F.lit("")
        return F.nullif(F.coalesce(*[F.when(F.col("__kind") == k, got(p, groups[place])) for k, (p, groups, _) in TIMES.items()]), F.lit("")).alias(name)  # a cast of an empty text is dear

    third = F.when(F.col("__kind") == "word", F.regexp_extract("__v", TIMES["word"][0], 3))
    x = x.withColumns({
        "__h": timed("h", 0).try_cast("int"), "__n": F.coalesce(timed("n", 1), F.nullif(third, F.lit(""))).try_cast("int"), "__s": timed("s", 2).try_cast("int"),
        "__f": F.rpad(F.substring(timed("f", 3), 1, 6), 6, "0").try_cast("int"), "__half": timed("half", 4),
        "__ahead": F.coalesce(*[F.when(F.col("__kind") == k, _zone(F.col("__v"), p, before)) for k, (p, _, before) in TIMES.items()]),
        "__rest": F.coalesce(*[F.when(F.col("__kind") == k, F.regexp_replace("__v", p, " ")) for k, (p, _, _) in TIMES.items()], F.col("__v")),
    })
    # a fraction's whole part counts; a separator that is repeated before nothing, or a comma inside a number, tells of no date
    x = x.withColumn("__rest", F.regexp_replace("__rest", r"(?<![0-9.])([0-9]+)\.[0-9]+(?![0-9.])", "$1"))
    x = x.withColumn("__clean", (F.regexp_replace("__rest", r"[a-z0-9\s.,;/'-]", "") == "") & ~F.col("__rest").rlike(r"[0-9]([-/.])(?:[0-9]+|[a-z]+)\1(?![0-9a-z])|[0-9]{2},[0-9]"))
    words = F.regexp_extract_all(F.col("__rest"), F.lit("([0-9]+|[a-z]+)"), F.lit(1))
    x = x.withColumn("__words", words)
    token = lambda w: F.struct(w.alias("w"), F.try_element_at(months, w).alias("m"), F.try_element_at(days, w).alias("d"), F.when(w.rlike("^[0-9]{1,9}$"), w.cast("int")).alias("n"), F.length(w).alias("len"))
    x = x.withColumn("__tokens", F.transform("__words", token))
    tokens = F.col("__tokens")
    odd = F.exists(tokens, lambda t: t["m"].isNull() & t["d"].isNull() & t["w"].rlike("[a-z]") & ~t["w"].isin(BETWEEN))
    named = F.filter(tokens, lambda t: t["d"].isNotNull())
    x = x.withColumns({"__odd": odd, "__weekday": F.get(F.transform(named, lambda t: t["d"]), F.size(named) - 1), "__tokens": F.filter(tokens, lambda t: t["m"].isNotNull() | t["w"].rlike("^[0-9]"))})

    # digits without separators: the first number is a date of 6, 8, 12 or 14 digits, the last a time after a whole date
    part = lambda w, at, n: F.substring(w, at, n)
    first = F.get(tokens, F.lit(0))
    solid = F.coalesce(first["len"].isin(6, 8, 12, 14) & first["m"].isNull(), F.lit(False))
    number = lambda text, n=None: F.struct(text.try_cast("int").alias("n"), F.lit(False).alias("m"), (F.length(text) > 2).alias("y"))
    cut = F.when(first["len"] == 6, F.array(*[number(part(first["w"], k, 2)) for k in (1, 3, 5)])).otherwise(F.array(number(part(first["w"], 1, 4)), number(part(first["w"], 5, 2)), number(part(first["w"], 7, 2))))
    plain = lambda t: F.struct(F.coalesce(t["m"], t["n"]).alias("n"), t["m"].isNotNull().alias("m"), (t["m"].isNull() & (t["len"] > 2)).alias("y"))
    x = x.withColumns({
        "__parts": F.when(solid, F.concat(cut, F.transform(F.slice(tokens, 2, 9), plain))).otherwise(F.transform(tokens, plain)),
        "__tail": F.when(solid & (first["len"] >= 12), part(first["w"], 9, 6)), "__last": F.get(tokens, F.size(tokens) - 1),
    })
    last = F.col("__last")
    late = (((F.size("__parts") == 4) & last["len"].isin(2, 4)) | ((F.size("__parts") > 1) & ~(solid & (F.size("__parts") == 3)) & (last["len"] == 6))) & last["m"].isNull() & F.col("__kind").isNull() & F.col("__tail").isNull()
    x = x.withColumns({"__digits": F.when(late, last["w"]).otherwise(F.col("__tail")), "__parts": F.when(late, F.slice("__parts", 1, F.size("__parts") - 1)).otherwise(F.col("__parts"))})
    d = F.col("__digits")
    two = lambda at: F.when(F.length(d) >= at + 1, part(d, at, 2).try_cast("int"))
    half, hour = F.col("__half"), F.col("__h")
    loose = (F.col("__kind") == "half") & (F.size("__parts") < 3)
    turned = F.when(half.isNull() | (loose & (hour > 12)), hour).when(hour <= 12, F.when(half == "a", hour % 12).otherwise(hour % 12 + 12))
    x = x.withColumns({
        "__hour": F.coalesce(two(1), turned), "__minute": F.coalesce(two(3), F.col("__n"), F.lit(0)), "__second": F.coalesce(two(5), F.col("__s"), F.lit(0)), "__timed": F.col("__kind").isNotNull() | d.isNotNull(),
    })

    p = F.col("__parts")
    at = lambda k: F.get(p, F.lit(k))["n"]
    place = lambda flag: F.get(F.filter(F.transform(p, lambda t, i: F.when(t[flag], i)), lambda i: i.isNotNull()), F.lit(0))
    x = x.withColumns({"__count": F.size(p), "__mp": place("m"), "__yp": place("y"), "__twice": (F.size(F.filter(p, lambda t: t["m"])) > 1) | (F.size(F.filter(p, lambda t: t["y"])) > 1)})
    n, mp, yp = F.col("__count"), F.col("__mp"), F.col("__yp")
    order = lambda y, m, dd: F.struct(*[(at(k) if k is not None else F.lit(None).cast("int")).alias(c) for c, k in (("y", y), ("m", m), ("d", dd))])
    fixed = lambda k: F.get(p, k)["n"]
    strong = mp.isNotNull().cast("int") + yp.isNotNull().cast("int")
    other = F.get(p, F.lit(3) - mp - yp)["n"]
    nothing = F.lit(None).cast("int")
    lone = F.when(mp == 0, at(1)).when(mp == 1, at(0)).otherwise(at(0))
    chosen = (
        F.when(((strong > 0) & (n == strong)) | ((n == 3) & (strong == 2)), F.struct(fixed(yp).alias("y"), fixed(mp).alias("m"), F.when(n == 3, other).alias("d")))
        .when((n == 1) | ((n == 2) & mp.isNotNull()), F.struct(F.when(lone > 31, lone).alias("y"), fixed(mp).alias("m"), F.when(lone <= 31, lone).alias("d")))
        .when((n == 2) & (at(0) > 31), order(0, 1, None)).when((n == 2) & (at(1) > 31), order(1, 0, None)).when(n == 2, order(None, 0, 1))
        .when((mp == 0) & (at(1) > 31), order(1, 0, 2)).when(mp == 0, order(2, 0, 1)).when((mp == 1) & (at(0) > 31), order(0, 1, 2)).when(mp == 1, order(2, 1, 0))
        .when((mp == 2) & (at(1) > 31), order(1, 2, 0)).when(mp == 2, order(0, 2, 1))
        .when((n == 3) & ((at(0) > 31) | F.coalesce(yp == 0, F.lit(False))), order(0, 1, 2)).when((n == 3) & (at(0) > 12), order(2, 1, 0)).when(n == 3, order(2, 0, 1))
        .otherwise(F.struct(nothing.alias("y"), nothing.alias("m"), nothing.alias("d")))
    )
    x = x.withColumn("__ymd", chosen)
    y, m, day = (F.col(f"__ymd.{c}") for c in "ymd")
    year_now = F.year(now)
    near = y + F.floor(year_now / 100).cast("int") * 100
    full = F.when((y >= 100) | yp.isNotNull(), y).when(near >= year_now + 50, near - 100).when(near < year_now - 50, near + 100).otherwise(near)
    x = x.withColumns({"__year": F.coalesce(full, year_now), "__month": F.coalesce(m, F.month(now)), "__has": (n > 0) | F.col("__weekday").isNotNull() | F.col("__timed")})
    text = lambda dd: F.concat_ws("-", F.lpad(F.col("__year").cast("string"), 4, "0"), F.lpad(F.col("__month").cast("string"), 2, "0"), F.lpad(dd.cast("string"), 2, "0")).try_cast("date")
    fits = F.col("__year").between(1, 9999) & F.col("__month").between(1, 12)
    x = x.withColumn("__first", F.when(fits, text(F.lit(1))))
    assumed = F.least(F.dayofmonth(now), F.dayofmonth(F.last_day("__first")))
    told = F.when(day.isNotNull(), F.when(fits & day.between(1, 31), text(day))).otherwise(F.date_add("__first", assumed - 1))
    x = x.withColumn("__date", told)
    onward = F.when(F.col("__weekday").isNotNull() & day.isNull(), F.pmod(F.col("__weekday") - 1 - F.weekday("__date"), F.lit(7))).otherwise(0)
    x = x.withColumn("__date", F.date_add("__date", onward.cast("int")))
    good = F.col("__clean") & ~F.col("__odd") & F.col("__has") & (n <= 3) & ~F.col("__twice")
    clock = F.coalesce(F.col("__hour"), F.when(~F.col("__timed"), F.lit(0)))
    sound = clock.between(0, 23) & F.col("__minute").between(0, 59) & F.col("__second").between(0, 59)
    micros = F.coalesce(F.col("__f"), F.lit(0))
    stamp = F.col("__date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), clock, F.col("__minute"), (F.col("__second") + micros / 1000000).cast("decimal(18,6)"))
    x = x.withColumn("read", F.when(F.coalesce(good & sound, F.lit(False)) & (F.abs(F.coalesce("__ahead", F.lit(0))) < 86400), stamp))
    return _instant(x, zone).select(*texts.columns, "read", "instant")


def _instant(x: DataFrame, zone: str) -> DataFrame:
    """x with `instant`: `read` less `__ahead` seconds, or as local time in the zone."""
    local = F.to_utc_timestamp(F.col("read").cast("timestamp"), zone)
    later = local + F.expr("INTERVAL '1' HOUR")
    settled = F.when(F.from_utc_timestamp(later, zone) == F.col("read").cast("timestamp"), later).otherwise(local)
    shifted = F.col("read") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("__ahead").cast("decimal(18,6)"))
    return x.withColumn("instant", F.when(F.col("__ahead").isNotNull(), shifted).otherwise(settled.cast("timestamp_ntz")))
