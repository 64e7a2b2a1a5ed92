"""The trigram model against a recursive dictionary version; no word is folded into a class, however many there are."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from eventloom.llm import katz


def plain(texts, order):
    """p(history, word) of a Katz model with dictionaries."""
    grams = [Counter() for _ in range(order)]
    for t in texts:
        w = ["<s>"] * (order - 1) + [*t.split(), "</s>"]
        for i in range(order - 1, len(w)):
            for k in range(order):
                grams[k][tuple(w[i - k : i + 1])] += 1
    d = [katz.discounts([0] + [sum(c == r for c in g.values()) for r in range(1, katz.ORDER_K + 2)]) for g in grams]
    adj = lambda c, k: c * d[k][c] if c <= katz.ORDER_K else c - katz.TAIL
    total = sum(grams[0].values())
    unseen = 1 - sum(adj(c, 0) for c in grams[0].values()) / total
    follow = [defaultdict(list) for _ in range(order)]
    for k in range(1, order):
        for g in grams[k]:
            follow[k][g[:-1]].append(g[-1])

    def p(history, w):
        k = len(history)
        if not k:
            return adj(grams[0][w,], 0) / total if (w,) in grams[0] else unseen
        after = follow[k].get(history)
        if not after:
            return p(history[1:], w)
        n = sum(grams[k][*history, x] for x in after)
        if w in after:
            return adj(grams[k][*history, w], k) / n
        left = 1 - sum(adj(grams[k][*history, x], k) for x in after) / n
        return left / (1 - sum(p(history[1:], x) for x in after)) * p(history[1:], w)

    return p


@pytest.mark.parametrize("order,frequent", [(2, 1 << 19), (3, 1 << 19), (3, 4), (4, 4)])
def test_recursive_backoff(spark, monkeypatch, order, frequent):
    monkeypatch.setattr(katz, "CACHED", 3)  # fewer than the words: a cache, not a cap
    texts = [" ".join(f"w{(i * i + k * (i % 5) + k * k) % 23}" for k in range(i % 17)) for i in range(120)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    p = plain([t for i, t in enumerate(texts) if not held(i)], order)
    found = katz.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), frequent=frequent, order=order).collect()
    assert len(found) == len(texts)
    for r in found:
        w = ["<s>"] * (order - 1) + [*texts[r["doc_id"]].split(), "</s>"]
        want = sum(math.log10(p(tuple(w[i - order + 1 : i]), w[i])) for i in range(order - 1, len(w)))
        assert math.isclose(r["score"], want, rel_tol=1e-9)
