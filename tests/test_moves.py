"""Moves of a tree's nodes against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom import catalog
from eventloom.operators import hierarchy
from eventloom.plans import merging

SCHEMA, MOVES = "id string, parent_id string, sort_order int", "id string, parent_id string, sort_order int, ord string"


def plain_moved(tree, moves):
    """The tree after the moves: each cycle's latest move is taken back until there is none."""
    asked = {}
    for m in sorted(moves, key=lambda m: m[3]):
        asked[m[0]] = m
    outcome = {i: "kept" if i not in asked else "no_parent" if asked[i][1] is not None and asked[i][1] not in tree else "moved" for i in tree}
    while True:
        up = {i: asked[i][1] if outcome[i] == "moved" else tree[i][0] for i in tree}
        done, closing = set(), []
        for start in tree:
            path, seen, at = [], {}, start
            while at in up and at not in done and at not in seen:
                seen[at] = len(path)
                path.append(at)
                at = up[at]
            if at in seen:
                closing.append(max((i for i in path[seen[at] :] if outcome[i] == "moved"), key=lambda i: asked[i][3]))
            done |= set(path)
        if not closing:
            return {(i, *(asked[i][1:3] if outcome[i] == "moved" else tree[i]), outcome[i]) for i in tree}
        for i in closing:
            outcome[i] = "cycle"


def compare(spark, tree, moves):
    t = spark.createDataFrame([(i, *v) for i, v in tree.items()], SCHEMA)
    m = spark.createDataFrame(moves, MOVES)
    want = plain_moved(tree, moves)
    assert {tuple(r) for r in hierarchy.moved(t, m).collect()} == want
    return {o: sum(w[3] == o for w in want) for o in ("kept", "moved", "cycle", "no_parent")}


def test_random_batches(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        tree = {str(k): (str(r.randrange(k)) if k and r.random() < 0.9 else None, k) for k in range(60)}
        moves = [(str(r.randrange(65)), r.choice([None, "99", *map(str, range(60))]), r.randrange(9), f"{k:03d}") for k in range(40)]
        counts = compare(spark, tree, moves)
        assert counts["moved"] > 5 and counts["cycle"]


def test_edges(spark):
    tree = {"a": (None, 0), "b": ("a", 1), "c": ("b", 2), "d": ("gone", 3)}
    assert compare(spark, tree, [("a", "a", 1, "1")])["cycle"] == 1  # itself
    assert compare(spark, tree, [("a", "c", 1, "1"), ("c", None, 5, "2")])["moved"] == 2  # right only after the batch
    assert compare(spark, tree, [])["kept"] == 4
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy.moved(empty, spark.createDataFrame([("a", None, 1, "1")], MOVES)).count() == 0
    ring = spark.createDataFrame([("a", "b", 1), ("b", "a", 2)], SCHEMA)
    with pytest.raises(ValueError, match="without any move"):
        hierarchy.moved(ring, spark.createDataFrame([], MOVES))


def test_deep_chain(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"), F.col("id").cast("int").alias("sort_order"))
    moves = spark.createDataFrame([("0", str(n - 1), 7, "1"), ("500", None, 7, "2"), ("400", "99999", 3, "3")], MOVES)
    got = {r["id"]: r["outcome"] for r in hierarchy.moved(chain, moves).where("outcome <> 'kept'").collect()}
    # 500 becomes a root; 0 and 400 then hang below the end of its chain, and no cycle is left
    assert got == {"0": "moved", "400": "moved", "500": "moved"}
    closed = hierarchy.moved(chain, moves.where("id = '0'")).where("outcome <> 'kept'").collect()
    assert [tuple(r) for r in closed] == [("0", None, 0, "cycle")]


def test_query(spark, sf_dir):
    from eventloom.plans.views import view

    held = {}
    original = hierarchy.moved
    hierarchy.moved = lambda tree, moves: held.update(tree=tree.collect(), moves=moves.collect()) or original(tree, moves)
    try:
        got = {tuple(r) for r in catalog.queries()["category_moves"](spark, sf_dir).collect()}
    finally:
        hierarchy.moved = original
    want = plain_moved({r["id"]: (r["parent_id"], r["sort_order"]) for r in held["tree"]}, [tuple(r) for r in held["moves"]])
    assert got == want and len(got) == view(spark, sf_dir, "category_tree").count()
    assert {"kept", "moved", "cycle", "no_parent"} == {w[3] for w in want}
    assert merging.hierarchy is hierarchy
