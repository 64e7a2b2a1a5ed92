"""Exact deduplication through an extendible-hash index on shared files, with DataFrame functions only.

The key of a text is the 64-bit hash of its normal form (A-Z lower-cased). The index is made of

* a directory: one row for each bucket, named by the leading bits that its keys share (`depth` of them). A bucket that holds more
  than `capacity` different keys is split by one bit more, which doubles the directory there; one that fits stays as it is.
* buckets: rows (low, h, link, n, keep_id, text_sha256), written in files that cover ranges of keys. The task that owns a range
  chains the different texts of a key behind each other (`link`), comparing their bytes.

Copies never meet as rows: keys and texts are counted before they are moved, and only texts whose key stands in the table more than
once are moved at all. A bit map of 8 MB, whatever the input, says of which keys that may hold; when it is full, more texts are moved
than need be, and nothing is lost. Keys that hold more than one row in a thousand (1,000 at most, so they are broadcast) are looked up
without a shuffle.

Rows: a null text is an empty one; of equal texts the one with the largest id stays, null ids last; rows that share id and text are one
document listed more than once: they count one by one, and each carries the same values; extra columns, whatever their names, are
dropped by `resolve` and kept by `deduplicate`; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.session import fresh_path, one_time, staged

#: Different keys of a bucket; bits that one pass over overfull buckets can split by.
CAPACITY, STEP = 1 << 14, 12
#: Bits of the map of repeated keys (8 MB in pages of 4 KB).
MAP_BITS = 1 << 26
#: A key with more than one in so many rows is looked up by broadcast; there can't be more such keys than this.
HOT = 1000


def normal(text: Column) -> Column:
    """A-Z lower-cased and nothing else; nulls are empty. Spark's lower() does just that where all characters are ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def prefix(h: Column, depth: Column) -> Column:
    """The leading bits of a key."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(_shift_right(h, 64 - depth))


def _shift_right(h: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, by.cast("int"))


def _low(p: Column, depth: Column) -> Column:
    """The key of a bucket whose other bits are zero: where its range begins."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", p, (64 - depth).cast("int")))


def split(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The directory (depth, prefix, n) for different keys h.

    A pass counts keys by STEP bits more than the buckets in work have, adds the counts up for every shorter prefix, and closes each
    bucket at the first depth at which it fits. What is still too full goes on to the next pass; all 64 bits tell keys apart.
    """
    closed, base, rest = [], 0, keys.select("h")
    while True:
        fine = min(base + STEP, 64)
        leaves = staged(rest.groupBy(prefix(F.col("h"), F.lit(fine)).alias("leaf")).agg(F.count("*").alias("n")), "leaves")
        nodes = (
            leaves.select(F.explode(F.sequence(F.lit(base), F.lit(fine))).alias("depth"), "leaf", "n")
            .select("depth", _shift_right(F.col("leaf"), F.lit(fine) - F.col("depth")).alias("prefix"), "n")
            .groupBy("depth", "prefix")
            .agg(F.sum("n").alias("n"))
        )
        nodes = staged(nodes, "nodes")
        full = nodes.where(F.col("n") > capacity)
        above = full.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = nodes.where(F.col("n") <= capacity).withColumn("parent", _shift_right(F.col("prefix"), F.lit(1)))
        closed.append(fits.where(F.col("depth") == base).drop("parent"))
        closed.append(fits.where(F.col("depth") > base).join(above, ["depth", "parent"], "left_semi").drop("parent"))
        over = full.where(F.col("depth") == fine).select(F.col("prefix").alias("leaf"))
        if fine == 64 or not over.head(1):
            return functools.reduce(DataFrame.unionByName, closed)
        # a bucket that is still too full begins the next pass by being split: its own depth is not looked at again
        rest = rest.withColumn("leaf", prefix(F.col("h"), F.lit(fine))).join(over, "leaf", "left_semi").select("h")
        base = fine


@dataclasses.dataclass
class Index:
    """An index on shared files."""

    directory: DataFrame
    buckets: DataFrame
    path: str

    def located(self, df: DataFrame) -> DataFrame:
        """df with `low`, the bucket of its key h. A key has one bucket among its prefixes of all depths that occur."""
        return _located(df, self.directory)

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, keep_id, n) of the texts of docs that the index holds."""
        keyed = self.located(_keyed(docs, id_col, text_col, F.xxhash64))
        return keyed.join(self.buckets.drop("link"), ["low", "h", "text_sha256"]).select(F.col("id").alias(id_col), "keep_id", "n")


def _located(df: DataFrame, directory: DataFrame) -> DataFrame:
    depths = [r[0] for r in directory.select("depth").distinct().sort("depth").collect()]  # 65 at most
    each = df.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))) if depths else df.withColumn("depth", F.lit(0))
    each = each.withColumn("prefix", prefix(F.col("h"), F.col("depth")))
    return each.join(directory.select("depth", "prefix"), ["depth", "prefix"]).withColumn("low", _low(F.col("prefix"), F.col("depth"))).drop("depth", "prefix")


def _keyed(docs: DataFrame, id_col: str, text_col: str, hashed: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), normal(F.col(f"`{text_col}`")).alias("text"))
    return rows.select("id", hashed(F.col("text")).cast("long").alias("h"), F.sha2("text", 256).alias("text_sha256"))


def _perhaps(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of texts whose key may be among keys: certainly all that are."""
    slot = F.pmod(F.xxhash64("h"), F.lit(MAP_BITS))
    pages = (
        keys.select(slot.alias("slot"))
        .groupBy(F.expr("bitmap_bucket_number(slot)").alias("page"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    )
    at = texts.withColumn("slot", slot).withColumn("page", F.expr("bitmap_bucket_number(slot)")).withColumn("bit", F.expr("bitmap_bit_position(slot)"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.call_function("shiftright", byte, F.expr("cast(bit % 8 as int)")).bitwiseAND(1) == 1
    return at.join(F.broadcast(pages), "page").where(hit).drop("slot", "page", "bit", "bits")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> tuple[Index, DataFrame]:
    """(the index of docs, their rows as (id, h, text_sha256)), both on shared files. hashed: the key of a normal text."""
    spark = docs.sparkSession
    rows = staged(_keyed(docs, id_col, text_col, hashed), "dedup-rows")
    keys = staged(rows.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("keep_id"), F.min("text_sha256").alias("text_sha256")), "dedup-keys")
    path = fresh_path(spark, "dedup-index")
    with one_time(spark):
        split(keys, capacity).write.parquet(f"{path}/directory")
    directory = spark.read.parquet(f"{path}/directory")

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), normal(F.col(f"`{text_col}`")).alias("text")).withColumn("h", hashed(F.col("text")).cast("long"))
    shared = _perhaps(texts, keys.where("n > 1")).groupBy("h", "text").agg(F.count("*").alias("n"), F.max("id").alias("keep_id"))
    owned = _located(shared, directory).repartitionByRange("low")
    key = Window.partitionBy("low", "h")
    chained = (
        owned.withColumn("of_key", F.sum("n").over(key))
        .where("of_key > 1")  # the bit map also lets keys through that stand alone
        .withColumn("link", F.row_number().over(key.orderBy("text")).cast("long"))
        .select("low", "h", "link", "n", "keep_id", F.sha2("text", 256).alias("text_sha256"))
    )
    alone = _located(keys.where("n = 1"), directory).select("low", "h", F.lit(1).cast("long").alias("link"), "n", "keep_id", "text_sha256")
    with one_time(spark):
        chained.unionByName(alone).repartitionByRange("low").sortWithinPartitions("low", "h", "link").write.option("compression", "zstd").parquet(f"{path}/buckets")
    return Index(directory, spark.read.parquet(f"{path}/buckets"), path), rows


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """A row for each document: id, keep_id, group_size, kept, text_sha256."""
    index, rows = build(docs, id_col, text_col, capacity, hashed)
    groups = index.buckets.where("n > 1").select("low", "h", "text_sha256", "n", "keep_id")
    total = rows.count()
    hot = F.broadcast(groups.where(F.col("n") * HOT > total).drop("low"))
    by = ["h", "text_sha256"]
    common = rows.join(hot, by).select("id", "text_sha256", "n", "keep_id")
    rest = index.located(rows.join(hot, by, "left_anti")).join(groups.where(F.col("n") * HOT <= total).hint("merge"), ["low", *by], "left")
    rest = rest.select("id", "text_sha256", F.coalesce("n", F.lit(1)).alias("n"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"))
    return common.unionByName(rest).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose document stays."""
    stays = resolve(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).distinct()
    packed = docs.select(F.struct("*").alias("doc"))
    keyed = packed.withColumn("id", F.col(f"doc.`{id_col}`")).withColumn("sha", F.sha2(normal(F.col(f"doc.`{text_col}`")), 256))
    same = (keyed["sha"] == stays["sha"]) & keyed["id"].eqNullSafe(stays["id"])
    return keyed.join(stays, same, "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


#: DuckDB SQL of the query over `documents`.
SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
