"""Operational state: source health, due sources, queues, budgets, backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def due() -> Column:
    """Sources to fetch now: active, with a URL, and the next time reached or, without one, no fetch in six hours."""
    nxt, last = F.col("next_fetch_in_min"), F.col("last_fetch_min_ago")
    return F.col("is_active") & F.col("url").isNotNull() & F.coalesce((nxt <= 0) | (nxt.isNull() & last.isNull()) | (nxt.isNull() & (last >= 360)), F.lit(False))


def health() -> Column:
    """struct(status, reason): the monitor's rules in order."""
    made = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    return (
        F.when(F.col("failures") >= 3, made("failing", "failures")).when(F.col("last_success_days") >= 7, made("failing", "stale"))
        .when(F.col("last_success_days").isNull() & (F.col("failures") > 0), made("failing", "never")).when(F.col("last_success_days").isNull(), made("unknown", "never"))
        .when((F.col("expected_count") > 0) & (F.col("last_count") < 0.5 * F.col("expected_count")), made("degraded", "drop")).when(F.col("partial"), made("degraded", "partial")).otherwise(made("healthy", "ok"))
    )


def failure_health() -> Column:
    """The run handler's variant: by the number of failures alone."""
    return F.when(F.col("failures") >= 5, "dead").when(F.col("failures") >= 3, "failing").when(F.col("failures") > 0, "degraded").otherwise("healthy")


def backoff_seconds(failures: Column) -> Column:
    """300 * 2 ^ min(n, 8), a day at most."""
    return F.least(F.lit(300) * F.pow(F.lit(2), F.least(failures, F.lit(8))), F.lit(86400)).cast("bigint")


def stale_job() -> Column:
    """Running without a heartbeat: two minutes before the first item, five after."""
    return (F.col("status") == "running") & (F.col("heartbeat_s") > F.when(F.col("processed") == 0, 120).otherwise(300))


def budget_level(day: Column, day_limit: float, month: Column, month_limit: float) -> Column:
    """The worse of the two shares as a level."""
    share = F.greatest(day / day_limit, month / month_limit)
    return F.when(share >= 1, "exceeded").when(share >= 0.9, "critical").when(share >= 0.7, "warning").otherwise("ok")
