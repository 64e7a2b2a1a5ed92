"""N-gram Jaccard join as a blocked sparse matrix product.

The rows of the matrix are distinct shingle sets, its columns 64-bit shingle hashes. Two sets link when
100 * |intersection| >= percent * |union| (85 by default). Three size-derived bounds keep the product sparse, and none of them loses a link:

* In one global order of the columns, two linked sets share at least m of their first n - ceil(.85 n) + m columns
  (m about .15 n; other thresholds alike). Only those columns are multiplied first, and pairs that accumulate fewer than m common ones go.
* A set needs m columns that some other set has too. Columns that occur once are known from a bit map of bounded size.
* Sizes of linked sets differ by less than the threshold allows.

The order puts columns that very many sets share last, so that common passages are not multiplied. Sets made of such columns
alone (large groups of near copies) are brought together by one chain of edges for each column, never by all pairs. What is
then connected forms families; the families' whole sets are multiplied in tiles of bounded size, and exact overlap counts
decide. Links become components; equal sets are one row of the matrix throughout.

Rows: null and blank texts have empty sets and are components of their own; fewer than four words make one shingle; repeated
rows and ids stay; a component is named after its smallest non-null id; extra columns are dropped (kept by keep_first); an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import ROW, components, in_map, lean, lean_group, membership, mix, slices, split_rows, spread_join, utf8, whole_rows, with_rows, words
from eventloom.llm.katz import pack, unpack
from eventloom.session import staged

WORDS, PERCENT = 4, 85
#: Columns are counted by the first 40 bits of their hash.
RANGE = 1 << 40
COMMON, MOST_COMMON = 16, 1 << 20
MAP_LEAST, MAP_MOST = 1 << 20, 1 << 30
TILE = 600_000

_K = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(texts: pa.Array, n_words: int = WORDS):
    """Portions of a batch: (first row, sorted distinct hashes of all texts in turn, their number for each text)."""
    data, offsets = utf8(texts)
    for a, b in slices(offsets):
        h, counts = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = len(counts)
        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(n), counts)
        size = np.maximum(counts - n_words + 1, (counts > 0).astype(counts.dtype))
        first = np.arange(len(h)) - np.repeat(ends - counts, counts) < np.repeat(size, counts)
        at = np.flatnonzero(first)
        total = np.zeros(len(at), np.uint64)
        for k in range(n_words):
            inside = at + k < ends[doc[at]]
            total[inside] = mix(total[inside] * _K[0] + h[at[inside] + k] * _K[1] + np.uint64(k + 1))
        doc = doc[at].astype(np.uint32 if n > 65535 else np.uint16)
        order = np.argsort(total)
        order = order[np.argsort(doc[order], kind="stable")]
        total, doc = total[order], doc[order]
        new = np.ones(len(total), bool)
        new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
        yield a, total[new], np.bincount(doc[new], minlength=n)


def least_overlap(n, percent: int = PERCENT):
    """The smallest intersection that a set of n columns can link with."""
    return (percent * n + 99) // 100


def margin(n, percent: int = PERCENT):
    """m: so many of their first columns must linked sets share."""
    return np.maximum(1, np.minimum(least_overlap(n, percent), (100 - percent) * n // 100))


def needed(n, percent: int = PERCENT):
    """The smallest margin among the sets that a set of n columns can link with."""
    return np.maximum(1, (100 - percent) * least_overlap(n, percent) // 100)


class Columns:
    """The very common columns, and a map of the columns that occur more than once; both of bounded size."""

    def __init__(self, common: np.ndarray, bits: np.ndarray, size: int):
        self.common, self.bits, self.size = common, bits, size

    def is_common(self, h: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.zeros(len(h), bool)
        key = h >> np.uint64(24)
        at = np.minimum(np.searchsorted(self.common, key), len(self.common) - 1)
        return self.common[at] == key

    def repeats(self, h: np.ndarray) -> np.ndarray:
        """False only for columns that certainly occur once."""
        key = (h >> np.uint64(24)).astype(np.int64)
        slot = np.minimum((key.astype(float) * (self.size / RANGE)).astype(np.int64), self.size - 1)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def count_columns(rows: DataFrame, parts: int, n_words: int) -> Columns:
    """Count the columns over all texts, in blocks by range, and keep what Columns needs."""

    def emit(batches):
        for batch in batches:
            keys = [s >> np.uint64(24) for _, s, _ in shingle_sets(batch.column("text"), n_words)]
            keys, counts = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
            part = np.minimum(keys.astype(float) * (parts / RANGE), parts - 1).astype(np.int64)
            at = np.searchsorted(part, np.arange(parts + 1))
            out = [(p, pack(keys[a:b] - keys[a]), int(keys[a]), np.minimum(counts[a:b], 65535).astype("<u2").tobytes()) for p, a, b in zip(range(parts), at, at[1:]) if b > a]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64(), pa.binary()))], ["p", "steps", "first", "counts"])

    blocks = rows.mapInArrow(lean(emit), "p int, steps binary, first long, counts binary")

    def keys_of(group: pa.Table):
        keys = np.concatenate([unpack(s).astype(np.int64) + f for s, f in zip(group.column("steps").to_pylist(), group.column("first").to_pylist())])
        counts = np.concatenate([np.frombuffer(c, "<u2").astype(np.int64) for c in group.column("counts").to_pylist()])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    def reduce(group: pa.Table) -> pa.Table:
        keys, counts = keys_of(group)
        often = np.flatnonzero(counts >= COMMON)
        often = often[np.argsort(-counts[often], kind="stable")][: MOST_COMMON // parts]
        return pa.table({"p": pa.array([group.column("p")[0].as_py()], pa.int32()), "repeated": pa.array([keys[counts > 1].astype("<i8").tobytes()], pa.binary()), "common": pa.array([np.sort(keys[often]).astype("<i8").tobytes()], pa.binary()), "n": pa.array([int((counts > 1).sum())], pa.int64())})

    counted = staged(blocks.groupBy("p").applyInArrow(lean_group(reduce), "p int, repeated binary, common binary, n long"), "columns")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = MAP_LEAST
    while size < 8 * total and size < MAP_MOST:
        size *= 2

    def mapped(batches):
        for batch in batches:
            bits, lows = [], []
            for p, block in zip(batch.column("p").to_pylist(), batch.column("repeated").to_pylist()):
                slot = np.minimum((np.frombuffer(block, "<i8").astype(float) * (size / RANGE)).astype(np.int64), size - 1)
                low = int(slot[0]) >> 3 if len(slot) else 0
                own = np.zeros((int(slot[-1]) >> 3) - low + 1 if len(slot) else 0, np.uint8)
                np.bitwise_or.at(own, (slot >> 3) - low, (1 << (slot & 7)).astype(np.uint8))
                bits.append(own.tobytes())
                lows.append(low)
            yield pa.RecordBatch.from_arrays([pa.array(lows, pa.int64()), pa.array(bits, pa.binary()), batch.column("common")], ["low", "bits", "common"])

    whole, common = np.zeros(size // 8, np.uint8), []
    for r in counted.mapInArrow(mapped, "low long, bits binary, common binary").toLocalIterator():
        own = np.frombuffer(r["bits"], np.uint8)
        whole[r["low"] : r["low"] + len(own)] |= own
        common.append(np.frombuffer(r["common"], "<i8").astype(np.uint64))
    return Columns(np.sort(np.concatenate(common)) if common else np.empty(0, np.uint64), whole, size)


def _measure(rows: DataFrame, columns, n_words: int, percent: int) -> DataFrame:
    """(id, n, node, light, heavy) of every text: node names its set; light and heavy hold the first columns of sets that may
    link, null for all others."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        known: Columns = columns.value
        for batch in batches:
            for a, flat, counts in shingle_sets(batch.column("text"), n_words):
                n = len(counts)
                ends = np.cumsum(counts)
                common, repeats = known.is_common(flat), known.repeats(flat)
                doc = np.repeat(np.arange(n), counts)
                length = counts - least_overlap(counts, percent) + margin(counts, percent)
                rank = np.cumsum(~common) - (~common)  # among the columns that are not common, in the whole portion
                before = np.concatenate([[0], np.cumsum(~common)])[ends - counts]
                light = ~common & (rank - before[doc] < length[doc])
                n_light = np.bincount(doc[~common], minlength=n)
                may = np.bincount(doc[light & repeats], minlength=n) >= needed(counts, percent)
                short = np.maximum(length - n_light, 0)
                nodes, lights, heavies = [], [], []
                for i in range(n):
                    s, e = ends[i] - counts[i], ends[i]
                    own = flat[s:e]
                    nodes.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if e > s else None)
                    lights.append(own[light[s:e] & repeats[s:e]].tobytes() if e > s and may[i] else None)
                    heavies.append(own[common[s:e]][: short[i]].tobytes() if e > s and short[i] else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, n), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(lights, pa.binary()), pa.array(heavies, pa.binary())],
                    ["id", "n", "node", "light", "heavy"],
                )

    return rows.mapInArrow(lean(run), f"id {kind}, n long, node long, light binary, heavy binary")


def _postings(sets: DataFrame, column: str, parts: int) -> DataFrame:
    """(p, columns, nodes, sizes): the first columns of distinct sets, in blocks by column."""

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(b, np.uint64) for b in batch.column(column).to_pylist()]
            if not own:
                continue
            lengths = [len(x) for x in own]
            flat = np.concatenate(own)
            node = np.repeat(batch.column("node").to_numpy(), lengths)
            size = np.repeat(batch.column("n").to_numpy(), lengths)
            part = (mix(flat) >> np.uint64(33)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            flat, node, size, part = flat[order], node[order], size[order], part[order]
            at = np.searchsorted(part, np.arange(parts + 1))
            out = [(p, flat[a:b].tobytes(), node[a:b].tobytes(), size[a:b].tobytes()) for p, a, b in zip(range(parts), at, at[1:]) if b > a]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["p", "columns", "nodes", "sizes"])

    return sets.where(F.col(column).isNotNull()).select("node", "n", column).mapInArrow(lean(run), "p int, columns binary, nodes binary, sizes binary")


def _lists(group: pa.Table):
    """The block's postings sorted by column, and where each column of two sets or more begins and ends."""
    column, node, size = (np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()]) for c, t in (("columns", np.uint64), ("nodes", np.int64), ("sizes", np.int64)))
    order = np.lexsort((node, column))
    column, node, size = column[order], node[order], size[order]
    at = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1], [True]]))
    keep = np.diff(at) > 1
    return node, size, at[:-1][keep], at[1:][keep]


def _pairs(group: pa.Table, percent: int) -> pa.Table:
    """(a, b, na, nb, c): how many of the block's columns each pair shares, for sizes that can link."""
    node, size, starts, ends = _lists(group)
    names, own = np.unique(node, return_inverse=True)
    sizes = np.zeros(len(names), np.int64)
    sizes[own] = size
    found = [np.empty(0, np.int64)]
    lengths = ends - starts
    for k in np.unique(lengths):
        i, j = np.triu_indices(int(k), 1)
        lists = starts[lengths == k]
        step = max(1, 1_000_000 // len(i))
        for s in range(0, len(lists), step):
            members = own[lists[s : s + step, None] + np.arange(k)]
            a, b = members[:, i].ravel(), members[:, j].ravel()
            fits = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
            found.append(np.unique(a[fits] * len(names) + b[fits]) if len(lists) == 1 else a[fits] * len(names) + b[fits])
    pair, c = np.unique(np.concatenate(found), return_counts=True)
    a, b = (pair // max(1, len(names)), pair % max(1, len(names)))
    return pa.table({"a": names[a], "b": names[b], "na": sizes[a], "nb": sizes[b], "c": c.astype(np.int64)})


def _chains(group: pa.Table) -> pa.Table:
    """(a, b): every set of a column with the column's first."""
    node, _, starts, ends = _lists(group)
    lengths = ends - starts
    a = np.repeat(node[starts], lengths)
    b = node[np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())] if len(starts) else np.empty(0, np.int64)
    edges = np.unique(np.column_stack([a, b])[a != b], axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pa.table({"a": edges[:, 0], "b": edges[:, 1]})


def _whole_sets(rows: DataFrame, wanted, n_words: int) -> DataFrame:
    """(node, columns) of the texts whose set may be in a family, each set once for a task."""

    def run(batches):
        table, seen = np.frombuffer(wanted.value, np.uint8), set()
        for batch in batches:
            for _, flat, counts in shingle_sets(batch.column("text"), n_words):
                ends = np.cumsum(counts)
                nodes, sets = [], []
                for e, n in zip(ends, counts):
                    if n:
                        own = flat[e - n : e].tobytes()
                        node = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)
                        if node not in seen and in_map(table, _slot(np.array([node])))[0]:
                            nodes.append(node)
                            sets.append(own)
                if len(seen) > 200_000:  # only spares rows: the aggregation after it keeps one of each
                    seen.clear()
                seen.update(nodes)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "columns"])

    return rows.mapInArrow(lean(run), "node long, columns binary").groupBy("node").agg(F.first("columns").alias("columns"))


def _slot(nodes: np.ndarray) -> np.ndarray:
    """A node's slot: its low 26 bits, as in the SQL expression beside it."""
    return nodes & ((1 << 26) - 1)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray):
    """Rows i of `left` in turn with (j, |i & j|) for the rows j of `right` that it shares columns with: the sparse product."""
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.cumsum(counts)])
    mine = column[np.argsort(order)]  # the columns of each set in turn
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for i in np.flatnonzero(left):
        c = mine[at[i] : at[i + 1]]
        c = c[counts[c] > 1]
        n = counts[c]
        places = np.repeat(starts[c] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(c) else np.empty(0, np.int64)
        shared = np.bincount(doc[places], minlength=len(sets))
        shared[i] = 0
        j = np.flatnonzero((shared > 0) & right)
        yield i, j, shared[j]


def _multiply(group: pa.Table, percent: int) -> pa.Table:
    """(node, other, links): for each set of a tile a set it is connected with there, and how many documents it links with."""
    node = group.column("node").to_numpy()
    root, k, n, i, j, block = (group.column(c).to_numpy() for c in ("root", "k", "n", "i", "j", "block"))
    sets = [np.frombuffer(s, np.uint64) for s in group.column("columns").to_pylist()]
    others, links = node.copy(), np.zeros(len(node), np.int64)
    order = np.argsort(root, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1], [True]]))
    for a, b in zip(at, at[1:]):
        own = order[a:b]
        if len(own) < 2:
            continue
        within = i[own[0]] == j[own[0]]
        left = np.ones(len(own), bool) if within else block[own] == i[own[0]]
        right = np.ones(len(own), bool) if within else ~left
        parent = np.arange(len(own))

        def top(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sizes = n[own]
        for x, y, shared in overlaps([sets[q] for q in own], left, right):
            y = y[(100 + percent) * shared >= percent * (sizes[x] + sizes[y])]
            links[own[x]] += k[own[y]].sum()
            if not within:
                np.add.at(links, own[y], k[own[x]])
            for z in y:
                p, q = top(x), top(z)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        for x in range(len(own)):
            others[own[x]] = node[own[top(x)]]
    return pa.table({"node": node, "other": others, "links": links})


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n, node, root, links) of every text: root names its component's set, links counts the documents it links with
    that have another set."""
    if not 50 <= percent <= 100:
        raise ValueError("the bounds hold for thresholds from 50 to 100 percent")
    spark = docs.sparkSession
    # several groups for each task, so that the tasks' shares differ little
    parts = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = with_rows(docs, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"}).drop(ROW)
    columns = spark.sparkContext.broadcast(count_columns(rows.select("text"), parts, n_words))
    measured = staged(_measure(rows, columns, n_words, percent), "sets")
    sets = measured.where("light is not null or heavy is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("light").alias("light"), F.first("heavy").alias("heavy"))
    sets = staged(sets, "first-columns")
    pairs = _postings(sets, "light", parts).groupBy("p").applyInArrow(lean_group(lambda group: _pairs(group, percent)), "a long, b long, na long, nb long, c long")
    least = F.greatest(F.lit(1), F.least(*[F.floor((100 - percent) * F.col(x) / 100) for x in ("na", "nb")]))
    close = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(F.col("c") >= least).select("a", "b")
    chains = _postings(sets, "heavy", parts).groupBy("p").applyInArrow(lean_group(_chains), "a long, b long")
    families = staged(components(close.union(chains), "families"), "family")
    wanted = spark.sparkContext.broadcast(membership(families, None, slot=F.expr("node & 67108863")))
    times = measured.where("node is not null").groupBy("node").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    listed = families.join(times, "node")
    blocks = listed.groupBy("root").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("blocks"))
    placed = listed.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    whole = placed.join(_whole_sets(rows.select("text"), wanted, n_words), "node")
    tiles = whole.withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumns({"i": F.least("block", "other_block"), "j": F.greatest("block", "other_block")})
    shared = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(parts))).otherwise(F.col("root"))
    tiled = tiles.withColumn("g", shared).select("g", "root", "i", "j", "block", "node", "n", "k", "columns")
    linked = staged(tiled.groupBy("g", "i", "j", F.when(F.col("j") > 0, F.col("root")).otherwise(F.lit(0)).alias("of")).applyInArrow(lean_group(lambda group: _multiply(group, percent)), "node long, other long, links long"), "links")
    found = components(linked.select(F.col("node").alias("a"), F.col("other").alias("b")), "components")
    count = linked.groupBy("node").agg(F.sum("links").alias("links"))
    out = measured.select("id", "n", "node").join(found, "node", "left").join(count, "node", "left")
    return out.select("id", "n", "node", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): n_links counts the documents of other sets that link with it."""
    found = staged(classes(docs, id_col, text_col, n_words), "classes")
    names = found.where("root is not null").groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("size")).where("size > 1")
    out = spread_join(found, names, "root", F.monotonically_increasing_id(), "left")
    component = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("links").alias("n_links"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one document of each component: that of the smallest id (the first row of repeated ids);
    documents without words stay."""
    rows = whole_rows(docs)
    order = F.struct(F.col(f"doc.`{id_col}`").isNull().alias("none"), F.col(f"doc.`{id_col}`").alias("id"), F.col(ROW).alias("row"))
    found = staged(classes(rows.select(order.alias("doc_id"), F.col(f"doc.`{text_col}`").alias("text")), n_words=n_words, percent=percent), "classes")
    kept = found.where("root is not null").groupBy("root").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
    gone = staged(spread_join(found, kept, "root", F.col("id.row")).where("id <> first").select(F.col("id.row").alias("r")), "copies")
    sure, perhaps = split_rows(rows, gone)
    left = sure.union(perhaps.join(gone, F.col(ROW) == F.col("r"), "left_anti"))
    return left.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
