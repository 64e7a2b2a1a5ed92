"""Extractors search a text once for each pattern, and read what they read before."""

from pyspark.sql import functions as F

from eventloom.functions import text as T
from tests.test_brute import times

ODD = [
    "um 99 uhr", "von 5 bis 7 uhr, um 8 h", "10-12", "ab 8 hx ab 9 h", "ab 19:75 uhr, 20 uhr", "bis 22 uhr", "xbis 22 uhr, gegen 7.30 h", "x9 uhr 10 uhr", "9 uhr\n", "abends", "xabends vormittags", "123 bis 14:00", "zwischen 22:30 und 1 uhr", "😀 um 9 uhr",
    "von 14:00 bis 16:99 uhr ab 7 h", "ab " + "9" * 30 + " uhr", "", "montag 12:00 - 13", "19.30 uhr_ 18 uhr",
]


def test_times_of_odd_texts(spark):
    d = spark.createDataFrame([(t,) for t in ODD] + [(None,)], "text string").select("text", T.time_of_day(F.col("text")).alias("t"))
    found = {r["text"]: (r["t"]["start"], r["t"]["ending"]) if r["t"] else None for r in d.collect()}
    assert found[None] in (None, (None, None))
    assert {t: found[t] for t in ODD} == {t: times(t) for t in ODD}


def test_patterns_stand_once(spark):
    d = spark.createDataFrame([("x",)], "text string")
    plan = lambda c: d.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    time, ages = plan(T.time_of_day(F.col("text"))), plan(T.age_range(F.col("text")))
    # once to find the match, once to read its groups
    assert time.count("zwischen") == time.count("gegen") == time.count("(vormittag") == 2
    assert ages.count("bis]") == 2 and plan(T.short_description(F.col("text"))).count("<[^>]+>") == 1
