"""The Jaccard join against all pairs, on the driver's tables and on planted families."""

import random
import re

import pyarrow.parquet as pq
import pytest

from eventloom.llm import jaccard

SPACES = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {}
    for i, text in docs:
        w = [x for x in SPACES.split((text or "").translate(LOWER)) if x]
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 85 * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= 85 * len(x | y):
                p, q = top(i), top(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def check(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    path = f"{jaccard.__name__}-{random.random()}"
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(d).collect()}
    assert path and found == brute(docs)


def family(rng, size, length, rate):
    base = [f"w{rng.randrange(4000)}" for _ in range(length)]
    for _ in range(size):
        p = rng.random() * rate
        yield " ".join(x if rng.random() > p else f"z{rng.randrange(10**6)}" for x in base)


def test_driver_tables(spark, sf_dir):
    for d in (sf_dir, "/root/testdata/sf0.01"):
        check(spark, [(r["doc_id"], r["text"]) for r in pq.read_table(f"{d}/documents.parquet").to_pylist()])


def test_large_families_and_common_passages(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [*family(rng, 150, 120, 0.05), *family(rng, 60, 40, 0.03), *family(rng, 40, 300, 0.1)]
    texts += [" ".join(f"u{rng.randrange(5000)}" for _ in range(rng.randrange(1, 150))) + " " + passage for _ in range(120)]
    texts += [passage + f" tail{k}" for k in range(40)]
    check(spark, list(enumerate(texts)))


def test_odd_rows(spark):
    texts = ["", None, "  ", "one", "ONE", "one two", "one two three", "a b c d", "a b c d e", "same words " * 3000, "same words " * 3000, "x" * 50000]
    check(spark, list(enumerate(texts)))
    d = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "A b c d e"), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard.join(d).collect()) == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
    assert jaccard.keep_first(d).count() == 2


@pytest.mark.parametrize("tile", [600_000, 3_000])
def test_tiles_agree(spark, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(9)
    check(spark, list(enumerate(family(rng, 120, 150, 0.06))))
