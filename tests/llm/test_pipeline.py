"""The pipeline, stage by stage, against brute-force versions of each stage on its own input."""

import hashlib
import os
import re
import sys

import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tests.llm.test_contracts import brute_spans  # noqa: E402
from tests.llm.test_jaccard import brute  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert tables[-1].columns == columns
    rows = [{r["doc_id"]: r.asDict() for r in t.collect()} for t in tables]
    from eventloom.llm import quality

    scores = {r["doc_id"]: r["predicted"] for r in quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert set(rows[1]) == {i for i, p in scores.items() if p == 1}
    groups = brute([(i, r["text"]) for i, r in rows[1].items()])
    assert set(rows[2]) == {i for i, (n, c) in groups.items() if c == i}
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    items = [words(r["text"]) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()]
    for i, r in rows[2].items():
        w, leak = words(r["text"]), False
        for q in items:
            n = min(20, len(q))
            for at in range(-len(q) + 1, len(w)):
                e = [0 <= at + k < len(w) and w[at + k] == x for k, x in enumerate(q)]
                leak = leak or sum(e) >= 0.75 * len(q) or max(sum(e[k : k + n]) for k in range(len(q) - n + 1)) >= 0.75 * n
        assert leak == (i not in rows[3])
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        before = rows[3][i]["text"]
        spans = brute_spans(before)
        if not spans:
            assert r["text"] == before or "[SECRET]" in r["text"]
        for s, _, e, _ in spans:
            assert before[s:e] not in r["text"]
        assert r["n_chars"] == len(r["text"])
    assert set(rows[5]) == set(rows[4])
    for i, r in rows[5].items():
        assert r["decoded_sha256"] == hashlib.sha256(rows[4][i]["text"].encode()).hexdigest()
