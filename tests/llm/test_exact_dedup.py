"""Exact deduplication against plain Python: splits, collisions, hard rows."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.llm import exactdedup
from eventloom.session import table

UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def hard(spark):
    texts = [f"text {i % 70} Of many" for i in range(400)] + ["Same For All"] * 300 + ["same for all"] * 30
    texts += [None, "", "", "É", "é", "İ", "i̇", "ſ", "s", "S", "K", "k", "K", "x" * 200_000, "X" * 200_000]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, "same for all"), (None, "alone without an id"), (None, None)]
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows], "doc_id long, text string, h string, n int, low int").repartition(5)
    return df, rows


@pytest.mark.parametrize("how", [{}, {"capacity": 1}, {"capacity": 7}, {"hashed": lambda t: F.length(t)}, {"capacity": 2, "hashed": lambda t: F.length(t) % 3}])
def test_equals_plain(spark, hard, how):
    df, rows = hard
    found = exactdedup.resolve(df, **how)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain(rows)


def test_directory_splits_only_overfull_buckets(spark, sf_dir):
    index, rows = exactdedup.build(table(spark, sf_dir, "documents"), capacity=9)
    directory = [tuple(r) for r in index.directory.select("depth", "prefix", "n").collect()]
    keys = {r[0] % 2**64 for r in rows.select("h").distinct().collect()}
    assert sum(n for *_, n in directory) == len(keys)
    for depth, prefix, n in directory:
        assert n == sum(k >> (64 - depth) == prefix for k in keys) <= 9
        above = sum(k >> (65 - depth) == prefix >> 1 for k in keys)
        assert above > 9, "a bucket is split only when it is too full"
    lows = [r[0] for r in index.buckets.select("low").distinct().collect()]
    assert len(lows) == len(directory)


def test_keys_alike_in_many_bits(spark):
    """Keys that share their first 50 bits need more than one pass."""
    keys = spark.createDataFrame([(k,) for k in [*range(40), 1 << 62, -5]], "h long")
    found = {(r["depth"], r["prefix"]): r["n"] for r in exactdedup.split(keys, 3).collect()}
    assert sum(found.values()) == 42 and max(d for d, _ in found) >= 60 and all(n <= 3 for n in found.values())


def test_a_range_has_one_owner(spark, sf_dir):
    index, _ = exactdedup.build(table(spark, sf_dir, "documents"), capacity=5)
    files = index.buckets.select("low", F.input_file_name().alias("file")).groupBy("low").agg(F.countDistinct("file").alias("files"))
    assert files.where("files > 1").count() == 0


def test_lookup(spark, hard):
    df, rows = hard
    index, _ = exactdedup.build(df)
    asked = spark.createDataFrame([(1000, "SAME for all"), (1001, "not there"), (1002, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["keep_id"], r["n"]) for r in index.lookup(asked).collect()}
    assert found[1000] == (729, 331) and found.keys() == {1000, 1002}


def test_deduplicate_keeps_columns(spark, hard):
    df, rows = hard
    left = exactdedup.deduplicate(df)
    assert left.columns == df.columns
    assert {r["text"].lower() if r["text"] else "" for r in left.where("doc_id < 700").collect()} == {t.lower() if t else "" for i, t in rows if i is not None and i < 700 and (i, t) in {(a, t) for a, t in rows} and plain_keeps(rows, i)}


def plain_keeps(rows, i):
    return any(r[0] == i and r[3] for r in plain(rows))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exactdedup.resolve(empty).collect() == [] and exactdedup.deduplicate(empty).collect() == []
