"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.session import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids through the content-addressed store and back."""
    from eventloom.llm import tokenstore

    return tokenstore.round_trip(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE by the streaming transducer, and back."""
    from eventloom.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and n-gram regression on every page's URL."""
    from eventloom.llm import urlfilter

    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    from eventloom.llm import decontaminate

    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff scores of every document by words, pairs and triples."""
    from eventloom.llm import katz

    return katz.score(table(spark, sf_dir, "documents"), order=3)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, normalised, and read back through the index."""
    from eventloom.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, linked parts included."""
    from eventloom.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by shingle overlap."""
    from eventloom.llm import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as media in deduplicated chunks, and read back."""
    from eventloom.llm import media

    return media.round_trip(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality scores of every document."""
    from eventloom.llm import quality

    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies through the extendible-hash index."""
    from eventloom.llm import exactdedup

    return exactdedup.resolve(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases, scored and subsumed."""
    from eventloom.llm import phrases

    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation."""
    from eventloom.llm import conversations

    return conversations.repair(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    """All numbered queries by name."""
    return {name: function for name, function in sorted(globals().items()) if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """SQL of the numbered queries that SQL can express."""
    from eventloom.llm import exactdedup, phrases

    return {"op11_exact_dedup": exactdedup.SQL, "op12_phrases": phrases.SQL}
