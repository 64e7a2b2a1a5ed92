"""Helpers shared by the corpus operators: row ids, Arrow text buffers, exact set bitmaps, components."""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import discard, ship_package, staged

ROW = "__row"


def with_rows(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns (null where missing) and a row id that keeps repeated rows apart.

    The id depends on how Spark splits the input, so it holds within one pass only: who reads rows twice and joins them by
    their ids takes whole_rows.
    """
    ship_package(df.sparkSession)
    kept = [F.col(f"`{c}`").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return df.select(*kept).withColumn(ROW, F.monotonically_increasing_id())


def whole_rows(df: DataFrame) -> DataFrame:
    """(doc, row id): every column of df inside one struct, so that no name can clash, staged so that all reads agree on ids."""
    ship_package(df.sparkSession)
    return staged(df.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias(ROW)), "rows")


#: What workers remember between rows; forgotten when a task ends.
_FORGET: list = []


def remembered(cache):
    """Decorator for lru_cache'd tables of a worker: they go when its task ends."""
    _FORGET.append(cache.cache_clear)
    return cache


def release() -> None:
    """Give a worker's memory back: workers are reused by other stages, and what one keeps adds up in an executor."""
    for forget in _FORGET:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run):
    """run, a function over the batches of a task, that leaves no memory behind in the worker."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def lean_group(run, least: int = 4 << 20):
    """run, a function over the table of a group, that leaves no memory of large groups behind."""

    @functools.wraps(run)
    def task(group):
        large = group.nbytes >= least
        out = run(group)
        del group
        if large:
            release()
        return out

    return task


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: A-Z to a-z on bytes, and the white space of the contracts (20 and 09-0D).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, known=[np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(known[0]) < n:
        out = np.empty(max(n, 4096), np.uint64)
        out[0] = 1
        out[1:] = _BASE
        known[0] = np.multiply.accumulate(out)
    return known[0]


def byte_values(data: np.ndarray, within: np.ndarray) -> np.ndarray:
    """What each byte adds to the hash of its word; within: its place there."""
    return _BYTE_VALUE[data] * _powers(int(within.max()) + 1)[within]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, number of words in each text), over a whole batch at once.

    Words are runs without white space; the ends of texts end words too.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_texts = offsets[:-1][offsets[:-1] < n]
    first[starts_of_texts] = inside[starts_of_texts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    letters = np.flatnonzero(inside)
    at = np.searchsorted(letters, starts)  # where each word begins among the letters
    lengths = np.diff(np.append(at, len(letters)))
    within = np.arange(len(letters)) - np.repeat(at, lengths)
    hashes = mix(np.add.reduceat(byte_values(LOWER[data[letters]], within), at) + lengths.astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def slices(offsets: np.ndarray, limit: int = 1 << 21):
    """Ranges of texts with about `limit` bytes together (one text at least), so that work arrays stay small."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def list_of(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


#: Bits of the membership maps that operators broadcast: a fixed 8 MB, however large the input is.
MAP_BITS = 1 << 26


def map_slot(column: Column) -> Column:
    """The bit that stands for a value in a membership map."""
    return F.pmod(F.xxhash64(column), F.lit(MAP_BITS))


def membership(df: DataFrame, column: Column | None, slot: Column | None = None) -> bytes:
    """A bit map of fixed size with the slots of all values of a column set; other values may share a slot.

    Who uses it must treat a set bit as 'perhaps' and settle those rows exactly, so that a full map costs time, never rows.
    """
    slot = map_slot(column) if slot is None else slot
    pages = (
        df.select(slot.alias("slot"))
        .groupBy(F.expr("bitmap_bucket_number(slot)").alias("page"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
        .collect()
    )
    size = 4096
    out = bytearray(MAP_BITS // 8 + size)
    for page in pages:
        at = (page["page"] - 1) * size if page["page"] > 0 else MAP_BITS // 8
        out[at : at + size] = page["bits"]
    return bytes(out)


def in_map(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each slot is set. Slot s > 0 is bit (s - 1) % 32768 of page (s - 1) // 32768 + 1, slot 0 is the extra page's first."""
    at = np.where(slots > 0, slots - 1, MAP_BITS)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split_rows(rows: DataFrame, listed: DataFrame, key: str = "r") -> tuple[DataFrame, DataFrame]:
    """(rows whose id is certainly not listed, all others): so that only rows that may be concerned need a join."""
    bits = rows.sparkSession.sparkContext.broadcast(membership(listed, F.col(key)))
    marked = rows.withColumn("__slot", map_slot(F.col(ROW)))

    def only(wanted: bool) -> DataFrame:
        def run(batches):
            table = np.frombuffer(bits.value, np.uint8)
            for batch in batches:
                keep = in_map(table, batch.column("__slot").to_numpy()) == wanted
                if keep.any():
                    yield batch.filter(pa.array(keep))

        return marked.mapInArrow(lean(run), marked.schema).drop("__slot")

    return only(False), only(True)


def spread_join(big: DataFrame, small: DataFrame, key: str, by: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """big joined with small, which has a row for each key, so that the rows of a frequent key go to `salts` tasks:
    `by` deals big's rows out, small's rows are there once for each of them. Never broadcast: what small's files take says
    little about its size here."""
    left = big.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [key, "__salt"], how).drop("__salt")


def hot_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """big joined with small, which has a row for each key. Keys that hold more than one in `share` of big's rows, of which there
    can't be more than `share`, are joined by broadcast and so stay where they are; all others meet in a sort-merge join.
    big is read three times: a table that is cheap to read."""
    total = big.count()
    hot = F.broadcast(big.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") * share > total).select(key))
    few = F.broadcast(small.join(hot, key, "left_semi"))
    common = big.join(hot, key, "left_semi").join(few, key, how)
    return common.unionByName(big.join(hot, key, "left_anti").join(small.hint("merge"), key, how))


def components(edges: DataFrame, label: str, rounds: int = 200) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of the component.

    Large-star and small-star rounds by turns; each row count is at most that of the edges, and every round is
    staged in the shared folder. Stops when a round changes nothing. The number of rounds grows with the logarithm of the
    longest path; should `rounds` not do, the job fails rather than return parts of components.
    """

    def neighbours(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def tally(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = tally(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = neighbours(e)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = spread_join(both, least, "a", F.col("b"), salts=4).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            spread_join(large, low, "a", F.col("b"), salts=4).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        ).distinct()
        before, e = e, staged(small, label)
        discard(before)
        now = tally(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    found = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return found.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
