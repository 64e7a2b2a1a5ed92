"""The language model against a plain dictionary version, and its normalisation."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from eventloom.llm import katz

SPACES = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def toks(text):
    return [w for w in SPACES.split((text or "").translate(LOWER)) if w] + ["</s>"]


class Plain:
    """Katz backoff with dictionaries."""

    def __init__(self, texts, vocabulary):
        uni = Counter(w for t in texts for w in toks(t))
        self.N, self.V, self.uni = sum(uni.values()), len(uni), uni
        n = Counter(uni.values())
        d1 = katz.discounts([0] + [n[r] for r in range(1, katz.ORDER_K + 2)])
        adj = lambda c, d: c * d[c] if c <= katz.ORDER_K else c - katz.TAIL
        import numpy as np

        order = sorted(uni, key=lambda w: (-uni[w], int(np.uint64(self.hash(w)).view(np.int64))))
        self.top = set(order[:vocabulary])
        p1 = {w: adj(c, d1) / self.N for w, c in uni.items()}
        self.unseen = 1 - sum(p1.values())
        self.p1 = p1
        self.cls = {w: p1[w] for w in self.top}
        self.cls["<unk>"] = 1 - sum(self.cls.values())
        self.big = Counter(x for t in texts for x in self.pairs(t))
        n = Counter(self.big.values())
        d2 = katz.discounts([0] + [n[r] for r in range(1, katz.ORDER_K + 2)])
        self.context, a, p, k = Counter(), Counter(), Counter(), Counter()
        for (v, w), c in self.big.items():
            self.context[v] += c
            a[v] += adj(c, d2)
            p[v] += self.cls[w]
            k[v] += 1
        self.adj = {x: adj(c, d2) for x, c in self.big.items()}
        self.alpha, self.scale = {}, {}
        for v in self.context:
            full = k[v] >= len(self.cls)
            self.scale[v] = self.context[v] / a[v] if full else 1.0
            self.alpha[v] = 0.0 if full else (self.context[v] - a[v]) / self.context[v] / (1 - p[v])

    @staticmethod
    def hash(w):
        import numpy as np

        from eventloom.llm.common import words

        if w == "</s>":
            return int(katz.END)
        raw = np.frombuffer(w.encode(), np.uint8)
        return int(words(raw, np.array([0, len(raw)]))[0][0])

    def pairs(self, text):
        own = [w if w in self.top else "<unk>" for w in toks(text)]
        return list(zip(["<s>", *own], own))

    def p(self, v, w):
        if (v, w) in self.big:
            return self.adj[v, w] * self.scale[v] / self.context[v]
        return (self.alpha[v] if v in self.context else 1.0) * self.cls[w]

    def score(self, text):
        total = sum(math.log10(self.p(v, w)) for v, w in self.pairs(text))
        for t in toks(text):
            if t not in self.top:
                total += math.log10(self.p1.get(t, self.unseen) / self.cls["<unk>"])
        return total


@pytest.mark.parametrize("vocabulary,frequent", [(1 << 17, 1 << 19), (50, 16)])
def test_scores(spark, sf_dir, vocabulary, frequent):
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    held = lambda d: zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2
    m = Plain([d["text"] for d in docs if not held(d)], vocabulary)
    found = {r["doc_id"]: r for r in katz.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary=vocabulary, frequent=frequent).collect()}
    assert len(found) == len(docs)
    gain = 0
    for d in docs:
        r, ts = found[d["doc_id"]], toks(d["text"])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(d), len(ts), m.N)
        assert r["n_known"] == sum(t in m.uni for t in ts)
        assert math.isclose(r["base_score"], sum(math.log10((m.uni[t] + 1) / (m.N + m.V + 1)) for t in ts), rel_tol=1e-9)
        assert math.isclose(r["score"], m.score(d["text"]), rel_tol=1e-9)
        gain += (r["score"] - r["base_score"]) * held(d)
    assert gain > 0
    followers = defaultdict(int)
    for v, _ in m.big:
        followers[v] += 1
    for v in [*list(m.context)[:5], max(followers, key=followers.get), "<s>"]:
        assert math.isclose(sum(m.p(v, w) for w in m.cls), 1, rel_tol=1e-9)


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "a b a b", "x"), (None, "a  b\n", "x"), (3, "b " * 5000, "x")], "doc_id long, text string, side string")
    found = katz.score(d).collect()
    assert sorted(r["n_tokens"] for r in found) == [1, 1, 3, 5, 5001]
    assert all(math.isfinite(r["score"]) for r in found)
