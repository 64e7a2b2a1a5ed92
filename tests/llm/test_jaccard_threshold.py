"""The join at other thresholds against all pairs, and the pipeline's five words and 0.8."""

import random

import pytest

import corpus_pipeline
from eventloom.llm import jaccard
from tests.llm.test_jaccard import family


def sets_of(texts, n):
    split = [t.split() for t in texts]
    return [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)} for w in split]


@pytest.mark.parametrize("n_words,percent", [(5, 80), (4, 85), (3, 60), (5, 100)])
def test_all_pairs(spark, n_words, percent):
    rng = random.Random(n_words * percent)
    texts = [*family(rng, 60, 120, 0.06), *family(rng, 60, 30, 0.05), *family(rng, 20, 300, 0.04)]
    sets = sets_of(texts, n_words)
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = top(i), top(j)
                parent[max(p, q)] = min(p, q)
    kept = jaccard.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n_words=n_words, percent=percent)
    assert {r["doc_id"] for r in kept.collect()} == {top(i) for i in range(len(texts))}


def test_stage_takes_five_words_and_four_fifths(spark):
    base = [f"w{k}" for k in range(490)]
    near = [f"z{k}" if k % 49 == 24 else w for k, w in enumerate(base)]  # 2.04 % of the words, spread out
    texts = [" ".join(base), " ".join(near)]
    for n, percent, close in ((5, 80, True), (4, 85, False)):
        a, b = sets_of(texts, n)
        assert (100 * len(a & b) >= percent * len(a | b)) == close
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert [r["doc_id"] for r in out.collect()] == [0]
