"""Pipeline stages on hard tables: shuffled rows, clashing names, nulls, empty and long texts, repeats, empty tables."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import bpe, jaccard, secrets, tokenstore

STAGES = dict(corpus_pipeline.STAGES)
CLASHING = ["r", "spans", "__row", "__slot", "digest", "doc", "id", "__salt", "found", "kind", "h", "row", "x", "first"]


def clashing(df):
    return df.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def hard(spark):
    """doc_id, text and columns of all reserved names, shuffled so that two computations may deal rows out differently."""
    texts = [f"password = hunter{i}hunter and more words to make it long {i}" if i % 3 == 0 else f"plain text number {i} of many " * 3 for i in range(300)]
    texts += [None, "", " ", "x" * 50_000, "word " * 20_000, "same text for all of these here"] + ["same text for all of these here"] * 20
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 0), (None, "no id here at all, only text", "en", "s", 0)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)), rows


def test_redact_on_shuffled_rows(spark, hard):
    df, rows = hard
    found = secrets.redact(df).collect()
    assert found[0].asDict().keys() == dict.fromkeys(df.columns).keys() and len(found) == len(rows)
    want = sorted((str(i), "null" if t is None else t) for i, t, *_ in rows)
    got = []
    for r in found:
        t = r["text"]
        assert t is None or "hunter" not in t
        if t is not None and "[SECRET]" in t:
            assert t.startswith("[SECRET] and more words")
            t = t.replace("[SECRET]", f"password = hunter{r['doc_id']}hunter")
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["r"] == (None if r["doc_id"] is None else f"r-{r['doc_id']}")
        got.append((str(r["doc_id"]), "null" if t is None else t))
    assert sorted(got) == want


def test_keep_first_on_shuffled_rows(spark, hard):
    df, rows = hard
    found = jaccard.keep_first(df, n_words=5, percent=80).collect()
    assert found[0].asDict().keys() == dict.fromkeys(df.columns).keys()
    same = [r["doc_id"] for r in found if r["text"] == "same text for all of these here"]
    assert same == [305] and sum(r["doc_id"] == 5 for r in found) == 1
    assert {None, "", " "} <= {r["text"] for r in found}


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_empty_tables(spark, tmp_path, name):
    for t in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"/root/testdata/sf0.001/{t}.parquet").slice(0, 0), tmp_path / f"{t}.parquet")
    docs = clashing(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"))
    out = STAGES[name](spark, docs, str(tmp_path))
    assert out.collect() == []
    if name != "BPE encoding and decoding":
        assert out.columns == docs.columns


@pytest.mark.parametrize("name", ["quality classifier", "benchmark decontamination", "BPE encoding and decoding"])
def test_stages_on_hard_rows(spark, hard, sf_dir, name):
    df, rows = hard
    out = STAGES[name](spark, df, sf_dir)
    found = out.collect()
    if name == "BPE encoding and decoding":
        assert len(found) == len(rows) and all(r["exact"] for r in found)
    else:
        assert out.columns == df.columns
        known = {(i, t) for i, t, *_ in rows}
        assert all((r["doc_id"], r["text"]) in known for r in found)
    if name == "benchmark decontamination":
        assert len(found) == len(rows)


def test_pipeline_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"/root/testdata/sf0.001/{t}.parquet").slice(0, 0), tmp_path / f"{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_bpe_window_stays_small():
    """Search for texts that keep the transducer's paths apart: repetitions of the vocabulary's own tokens, in one piece."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    m = bpe.codec(path)[0]
    rng = random.Random(5)
    letters = [b for b in m.token_of if b.isalpha() and b.isascii() and len(b) > 1]
    units = ["a", "ab", "aab", "th", "ing", *["".join(rng.choice(letters).decode() for _ in range(rng.randint(1, 4))) for _ in range(60)]]
    most = 0
    for u in units:
        text = (u * (6000 // len(u) + 1))[:6000]
        t = bpe.Transducer(m)
        ids = t.feed(text.encode()) + t.finish()
        most = max(most, t.most)
        assert bpe.decode(ids, path) == text
    assert most <= 6 * m.lookahead


def test_short_and_streamed_pieces_agree():
    import public_tokenizers

    m = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))[0]
    rng = random.Random(9)
    for _ in range(3000):
        raw = bytes(rng.choice(b"aabethinoru es.,'\xc3\xa4\xff0") for _ in range(rng.randint(1, 30)))
        t = bpe.Transducer(m)
        assert m.whole(raw) == t.feed(raw) + t.finish()


def test_merkle_tree_of_a_stream():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 5, 8, 13, 100]:
        leaves = [rng.randbytes(32) for _ in range(n)]
        tree = tokenstore.Tree()
        for leaf in leaves:
            tree.add(leaf)
        assert tree.root() == tokenstore.merkle(leaves)


def test_damage_is_found(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    chunks, manifest, parts = tokenstore.write(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50), path)
    tokenstore.verify_parts(manifest, parts)
    with pytest.raises(ValueError):
        tokenstore.verify_parts(manifest.withColumn("root", F.when(F.col("start") == 0, F.sha2("root", 256).cast("binary")).otherwise(F.col("root"))), parts)
    with pytest.raises(Exception, match="damaged"):
        tokenstore.read(chunks.withColumn("body", F.concat("body", F.lit(b"\x00\x00"))), manifest).collect()


_ = pa
