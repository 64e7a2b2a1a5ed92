"""Dates and times in event texts."""

from __future__ import annotations

from eventloom.catalog import register
from eventloom.functions import dates as D
from eventloom.plans.views import ctes, view

FULL, SHORT = D.FULL, D.SHORT
#: Month by name, as SQL.
MONTH = lambda c: f"coalesce(CASE lower({c}) " + " ".join(f"WHEN '{n}' THEN {k}" for n, k in D.MONTHS.items()) + f" END, TRY_CAST({c} AS INT))"


def sql(extended: bool) -> str:
    """The same steps in SQL: candidates by form, the first that is there, its day, then times in the 120 characters after it."""
    clean = f"regexp_replace(text, '(?i){D.WEEKDAY}', '', 'g')" if extended else "text"
    kinds = D.EXTENDED if extended else D.PLAIN
    got = ", ".join(f"regexp_extract(t, '(?is){p}(.{{0,120}})', {g}) AS {k}_{n}" for k, (p, groups) in kinds.items() for n, g in [*zip("ymd", groups), ("w", 4)])
    pick = ", ".join("CASE " + " ".join(f"WHEN {k}_y <> '' THEN {k}_{n}" for k in kinds) + f" END AS {n}" for n in "ymdw")
    span = D.RANGE.replace("bis|", "bis|und|") if extended else D.RANGE
    num = lambda p, g: f"TRY_CAST(nullif(regexp_extract(w, '(?i){p}', {g}), '') AS INT)"
    at = lambda h, m: f"CASE WHEN {h} BETWEEN 0 AND 23 AND {m} BETWEEN 0 AND 59 THEN day + to_minutes(CAST({h} * 60 + {m} AS BIGINT)) END"
    return f"""t0 AS (SELECT id, {clean} AS t FROM when_text), t1 AS (SELECT id, {got} FROM t0), t2 AS (SELECT id, {pick} FROM t1),
        t3 AS (SELECT id, w, TRY_CAST(y AS INT) + CASE WHEN TRY_CAST(y AS INT) < 100 THEN 2000 ELSE 0 END AS y, {MONTH("m")} AS m, TRY_CAST(d AS INT) AS d FROM t2),
        t4 AS (SELECT id, w, CASE WHEN y BETWEEN 2020 AND 2030 THEN CAST(TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) AS TIMESTAMP) END AS day FROM t3),
        t5 AS (SELECT id, day, {num(span, 1)} AS h1, coalesce({num(span, 2)}, 0) AS m1, {num(span, 3)} AS h2, coalesce({num(span, 4)}, 0) AS m2, coalesce({num(D.TIME, 3)}, {num(D.TIME, 1)}) AS h, coalesce({num(D.TIME, 2)}, 0) AS m FROM t4),
        t6 AS (SELECT id, day, h1, {at("h1", "m1")} AS a, {at("h2", "m2")} AS b, {at("h", "m")} AS s FROM t5)
        SELECT id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a WHEN h1 IS NOT NULL THEN day ELSE coalesce(s, day) END AS starts, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN b <= a THEN b + INTERVAL 1 DAY ELSE b END END AS ends FROM t6"""


@register("german_datetime", ctes("when_text") + ", " + sql(False))
def german_datetime(spark, d):
    return D.with_datetime(view(spark, d, "when_text"), "text").select("id", "starts", "ends")


@register("extended_datetime", ctes("when_text") + ", " + sql(True))
def extended_datetime(spark, d):
    return D.with_datetime(view(spark, d, "when_text"), "text", extended=True).select("id", "starts", "ends")


def formats_sql() -> str:
    tried = ["CASE WHEN regexp_matches(b, '^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\\.[0-9]{1,6})?)?)?$') THEN TRY_CAST(b AS TIMESTAMP) END"]
    for p, (y, m, d), timed in D.FORMATS.values():
        n = lambda g, p=p: f"TRY_CAST(nullif(regexp_extract(v, '{p}', {g}), '') AS INT)"
        year = f"({n(y)} + CASE WHEN {n(y)} < 100 THEN 2000 ELSE 0 END)"
        minutes = f"({n(4)} * 60 + {n(5)})" if timed else "0"
        fits = f" AND {n(4)} <= 23 AND {n(5)} <= 59" if timed else ""
        tried.append(f"CASE WHEN {year} BETWEEN 2020 AND 2030{fits} THEN CAST(TRY_CAST(printf('%04d-%02d-%02d', {year}, {n(m)}, {n(d)}) AS DATE) AS TIMESTAMP) + to_minutes(CAST({minutes} AS BIGINT)) END")
    return "v0 AS (SELECT id, trim(value) AS v FROM date_value), v1 AS (SELECT id, v, CASE WHEN contains(v, 'T') THEN regexp_replace(v, '(?:Z|\\+.*)$', '') ELSE v END AS b FROM v0) SELECT id, coalesce(" + ", ".join(tried) + ") AS parsed FROM v1"


@register("date_formats", ctes("date_value") + ", " + formats_sql())
def date_formats(spark, d):
    return D.with_formats(view(spark, d, "date_value"), "value").select("id", "parsed")
