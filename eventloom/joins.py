"""Joins that stay even when a few keys hold very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """big joined with small, which has a row for each key. Keys that hold more than one in `share` of big's rows, of which there
    can't be more than `share`, are joined by broadcast and so stay where they are; all others meet in a sort-merge join.
    big is read three times: a table that is cheap to read."""
    total = big.count()
    hot = F.broadcast(big.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") * share > total).select(key))
    few = F.broadcast(small.join(hot, key, "left_semi"))
    common = big.join(hot, key, "left_semi").join(few, key, how)
    return common.unionByName(big.join(hot, key, "left_anti").join(small.hint("merge"), key, how))


def salted_pairs(left: DataFrame, right: DataFrame, keys: list[str], n: str, by: Column, most: int = 4096) -> DataFrame:
    """All pairs of rows with equal keys, a key's right rows dealt over one task for every `most` of them; both sides know how many there
    are, in column n. by: what deals the right rows."""
    salts = (F.floor(F.col(n) / most) + 1).cast("int")
    dealt = right.withColumn("__salt", F.pmod(F.xxhash64(by), salts).cast("int"))
    spread = left.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(n)
    return spread.join(dealt.drop(n).hint("merge"), [*keys, "__salt"]).drop("__salt")
