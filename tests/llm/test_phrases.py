"""Phrase mining against a plain version: whole counts, cuts, subsumption, ranks."""

import random
import re
from collections import Counter

import pytest

from eventloom.llm import phrases

UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, least=10, top=2000, most=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for lang in n:
        rows = []
        for (own, w), a in cand.items():
            if own != lang:
                continue
            holds = lambda big: any(big[i : i + len(w)] == w for i in range(len(big) - len(w) + 1))  # noqa: B023, E731
            if any(o == lang and len(big) > len(w) and 100 * b >= 50 * a and holds(big) for (o, big), b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts():
    rnd = random.Random(7)
    words = ["the", "The", "of", "naïve", "Ünder", "a", "b", "cat", "sat", "日本", "x-y", "\x00odd", "it's", "İ"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!", " \x85", " "]
    return [(rnd.choice(["en", "en", "en", "de", None, "und", ""]), "".join(rnd.choice(words[: rnd.choice([3, 14])]) + rnd.choice(ends) for _ in range(rnd.randrange(60)))) for _ in range(300)]


@pytest.mark.parametrize("how", [{}, {"least": 3}, {"top": 5}, {"most_words": 4, "least": 4}, {"least": 200}])
def test_equals_plain(spark, how):
    rows = [*texts(), ("en", None), (None, ""), ("en", "the of " * 30_000)]
    df = spark.createDataFrame([(lang, t, 1, "z") for lang, t in rows], "lang string, text string, f int, phrase string")
    found = sorted(tuple(r) for r in phrases.mine(df, **how).collect())
    want = plain(rows, how.get("least", 10), how.get("top", 2000), how.get("most_words", 3))
    assert found == want and want


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    monkeypatch.setattr(phrases, "LEAST_CELLS", 64)
    monkeypatch.setattr(phrases, "MOST_CELLS", 64)
    monkeypatch.setattr(phrases, "HELD", 50)
    assert sorted(tuple(r) for r in phrases.mine(df).collect()) == plain(rows)


def test_sketch_never_underestimates_and_prunes(spark):
    rows = [("en", f"rare{i} word{i} once{i}") for i in range(4000)] + [("en", "very frequent phrase")] * 12
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    a, b = phrases.sketch(df, 1 << 16, 3, 10)
    counted = {r["phrase"]: r["f"] for r in phrases.exact(df, (a, b), 1 << 16, 3, 1, 8).collect()}
    assert counted[""] == 3 * len(rows)
    assert all(counted[p] == 12 for p in ("very", "frequent", "phrase", "very frequent", "frequent phrase", "very frequent phrase"))
    assert len(counted) < 400, "almost all of 24,000 rare n-grams are ruled out"


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 1)], "lang string, phrase string, f long")
    from pyspark.sql import functions as F

    cand = counts.where("phrase = 'a b'").withColumnRenamed("f", "a")
    (row,) = phrases.cuts(cand, counts).collect()
    assert row["score"] == 1_000_000 * (big - 1) ** 2 // (big * (big + 1))


def test_empty_table(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).collect() == []
