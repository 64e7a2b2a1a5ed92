"""What the language model keeps on disk, and its packed blocks."""

import os
import zlib

import numpy as np
import pytest

from eventloom.llm import katz
from eventloom.session import shared_dir


def test_staged_bytes(spark, sf_dir):
    """All staged tables together take fewer bytes a token than the hashes of one n-gram would."""

    def folders():
        top = shared_dir(spark).removeprefix("file://") + "/eventloom"
        return {f"{top}/{f}" for f in os.listdir(top) if f.startswith("lm-")} if os.path.isdir(top) else set()

    before = folders()
    tokens = sum(r["n_tokens"] for r in katz.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=3).collect())
    kept = sum(os.path.getsize(f"{d}/{f}") for d in folders() - before for f in os.listdir(d))
    assert kept / tokens < 24


@pytest.mark.parametrize("values", [[], [0], [255, 256, 0], [2**32 - 1, 7] * 1000, [2**40, 3]])
def test_squeeze(values):
    for kind in (np.uint32, np.uint64):
        if max(values, default=0) <= np.iinfo(kind).max:
            x = np.array(values, kind)
            assert np.array_equal(katz.expand(katz.squeeze(x)), x)


def test_without_cache(spark, sf_dir):
    """Where a word's count is looked up doesn't change a score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = ({r["doc_id"]: r for r in katz.score(docs, order=3, frequent=f).collect()} for f in (10, None))
    assert a.keys() == b.keys()
    for i, r in a.items():
        assert (r["n_tokens"], r["n_known"]) == (b[i]["n_tokens"], b[i]["n_known"])
        assert np.isclose(r["score"], b[i]["score"], rtol=1e-9) and np.isclose(r["base_score"], b[i]["base_score"], rtol=1e-9)


def test_no_training_rows(spark):
    """Tokens are counted, and score 0, where all rows are held out."""
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2]
    found = katz.score(spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string"), order=3).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["train_tokens"], r["score"]) for r in found) == [(i, 4, 0, 0.0) for i in held]
