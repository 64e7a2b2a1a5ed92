"""Predicates, orders and pages of the catalogue search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ratings that families do not see, tab names.
RESTRICTED = ("16+", "18+")


def ts(value: str) -> Column:
    """A time without zone, as the tables hold them."""
    return F.lit(value).cast("timestamp_ntz")


def displayable(now: str) -> Column:
    """Published, not over, not cancelled."""
    return (F.col("status") == "published") & (F.col("start_datetime") >= ts(now)) & ~F.col("is_cancelled")


def allowed_rating() -> Column:
    """Not on the restricted list; no rating is fine."""
    return F.coalesce(~F.col("age_rating").isin(*RESTRICTED), F.lit(True))


def tab_range(tab: str, now: str) -> dict[str, Column]:
    """What a tab adds to the filter, by filter key; later keys win over earlier ones."""
    start = dt.datetime.fromisoformat(now)
    day = start.replace(hour=0, minute=0, second=0)
    between = lambda a, b: {"start": (F.col("start_datetime") >= ts(str(a))) & (F.col("start_datetime") < ts(str(b)))}
    if tab == "heute":
        return between(day, day + dt.timedelta(days=1))
    if tab == "wochenende":  # from a Sunday on, the next Saturday
        ahead = (5 - day.weekday()) % 7 if day.weekday() != 6 else 6
        return between(day + dt.timedelta(days=ahead), day + dt.timedelta(days=ahead + 2))
    if tab == "ferien":
        return {"start": (F.col("start_datetime") >= ts(now)) & (F.col("start_datetime") <= ts(str(start + dt.timedelta(days=30))))}
    if tab == "nachmittags":
        return {"hour": F.hour("start_datetime") >= 14}
    if tab == "regen":
        return {"indoor": F.col("is_indoor")}
    if tab == "kostenlos":
        return {"price": F.col("price_type") == "free"}
    return {}


def price_at_most(free: bool = False, maximum: float | None = None) -> Column | None:
    """Free events, or those whose lowest price fits."""
    if free or maximum == 0:
        return F.col("price_type") == "free"
    return None if maximum is None else (F.col("price_type") == "free") | (F.col("price_min") <= maximum)


def contains_ci(text: str, *columns: str) -> Column:
    """A text in any of the columns, whatever the case; % and _ are plain characters."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return out


def facets(now: str, tab=None, age_min=None, age_max=None, free=False, price_max=None, indoor=None, outdoor=None, text=None) -> Column:
    """The whole predicate of the standard search. A text replaces the price condition, as both are one OR group; a tab
    replaces the date condition."""
    parts = {"base": (F.col("status") == "published") & ~F.col("is_cancelled"), "start": F.col("start_datetime") >= ts(now)}
    parts |= tab_range(tab, now) if tab else {}
    if age_min is not None:
        parts["age_min"] = F.col("age_max") >= age_min
    if age_max is not None:
        parts["age_max"] = F.col("age_min") <= age_max
    price = price_at_most(free, price_max)
    if price is not None:
        parts["or"] = price
    if indoor:
        parts["indoor"] = F.col("is_indoor")
    if outdoor:
        parts["outdoor"] = F.col("is_outdoor")
    if text:
        parts["or"] = contains_ci(text, "title", "description_short")
    out = F.lit(True)
    for p in parts.values():
        out = out & p
    return out


def ages_overlap(low: int, high: int) -> Column:
    """Events without ages fit all; an open end does not bound."""
    a, b = F.col("age_min"), F.col("age_max")
    return (a.isNull() & b.isNull()) | ((a.isNull() | (a <= high)) & (b.isNull() | (b >= low)))


def ages_overlap_defaults(low: int, high: int) -> Column:
    """The planner's variant: a missing or zero end is 0 or 99."""
    a = F.when(F.col("age_min").isNull() | (F.col("age_min") == 0), 0).otherwise(F.col("age_min"))
    b = F.when(F.col("age_max").isNull() | (F.col("age_max") == 0), 99).otherwise(F.col("age_max"))
    return (a <= high) & (b >= low)


def order(mode: str) -> list[Column]:
    """Sort keys; descending scores put unscored events first, and the id settles ties."""
    if mode == "relevance":
        return [F.col("relevance").desc_nulls_first(), F.col("start_datetime").asc_nulls_last(), F.col("id").asc()]
    if mode == "newest":
        return [F.col("created_at").desc_nulls_first(), F.col("id").asc()]
    if mode == "nearest":
        return [F.col("distance_m").asc_nulls_last(), F.col("start_datetime").asc_nulls_last(), F.col("id").asc()]
    return [F.col("start_datetime").asc_nulls_last(), F.col("id").asc()]


def page(df: DataFrame, keys: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page: numbers from 1, sizes from 1 to 50."""
    number, size = max(1, number), min(50, max(1, size))
    return df.orderBy(*keys).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """(total, total_pages, has_next, has_prev)."""
    pages = F.ceil(F.col("total") / size).cast("bigint")
    return df.agg(F.count("*").alias("total")).select("total", pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def after(df: DataFrame, time: str, key: str, time_value: str, key_value: int, size: int) -> DataFrame:
    """The page after a row, newest first: one row more than asked for tells whether there is another page."""
    t, k = F.col(time), F.col(key)
    return df.where((t < ts(time_value)) | ((t == ts(time_value)) & (k < key_value))).orderBy(t.desc(), k.desc()).limit(size + 1)


def first_per(df: DataFrame, parent: str, keys: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each parent."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(*keys))).where(F.col("rank") <= n)


#: Over how many tasks the events of one category are dealt.
SALTS = 64


def similar(events: DataFrame, categories: DataFrame, now: str, n: int = 4) -> DataFrame:
    """(id, other, rank): coming events that share a category, the soonest n of each."""
    shown = events.where(displayable(now)).select("id", "start_datetime")
    own = events.select("id").join(categories, F.col("id") == F.col("event_id")).select("id", "slug")
    # the soonest n + 1 of each category hold the n soonest others of every event
    listed = shown.join(categories, F.col("id") == F.col("event_id")).select(F.col("id").alias("other"), "slug", "start_datetime")
    soonest = first_per(listed, "slug", [F.col("start_datetime").asc(), F.col("other").asc()], n + 1).drop("rank")
    best = soonest.groupBy("slug").agg(F.collect_list(F.struct("start_datetime", "other")).alias("best"))
    # few categories hold most events: a category's events meet its soonest in as many tasks as there are salts
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    met = own.withColumn("__salt", salt).join(best.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["slug", "__salt"])
    others = met.select("id", F.filter("best", lambda b: b["other"] != F.col("id")).alias("best")).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))).alias("best"))
    return others.select("id", F.posexplode(F.slice("best", 1, n)).alias("at", "b")).select("id", F.col("b.other").alias("other"), (F.col("at") + 1).cast("bigint").alias("rank"))
