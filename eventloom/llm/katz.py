"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, any order.

Words are lower-cased runs without white space; every text ends with an end token and is preceded by start tokens. N-grams of
every length up to the order are named by 64-bit hashes and counted over all training texts; every word is a word of its
own and every context has its own backoff weight, in tables partitioned by context. A token's probability is that of its
longest n-gram if it was seen, else the context's backoff weight times the probability one word shorter, down to the word's
own (unseen words share the Good-Turing mass of the unseen). A caller may ask for a class model instead: with `vocabulary`,
all words but so many most frequent ones share one class, inside which a word has its share by its own exact count.

N-grams travel and rest as words, not as hashes: a bounded number of the most frequent words is broadcast and named by ranks,
all others keep their 64-bit hashes, once for each block that has them. The hashes of an n-gram, its context and its shorter
form follow from its words. The longest n-grams travel once, with the texts that have them, so that the partition that has
counted them answers those texts too; only where a text of the held-out part has one that was not seen is a question sent on,
and only for such contexts are backoff weights worked out. Nothing is dropped: the bound decides where a word's count is
looked up, not whether.

Rows: null and empty texts hold the end token alone; rows with a null id are training rows; repeated rows and ids stay; extra
columns are dropped; with no training rows every token is unseen and has probability 1 (score 0); an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import ROW, lean, lean_group, mix, slices, utf8, with_rows, words
from eventloom.session import staged

#: How many words are broadcast; which counts are discounted by Good-Turing, and by how much all others.
CACHED, ORDER_K, TAIL = 1 << 20, 5, 0.5
END = np.uint64(0x5EED0FE0D0C5EED1)  # the hashes of the end token, the start token and the class of all other words
START, OTHERS = np.uint64(0x57A47ED0C5EED0E3), np.uint64(0x07E45C1A550FA115)
_CHAIN = np.uint64(0xA0761D6478BD642F)


def fold(column: str):
    """crc32 of the id as text, mod 7: 2 is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 == 2, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, number of tokens of each text), the end tokens included."""
    data, offsets = utf8(texts)
    found, counts = [], []
    for a, b in slices(offsets):
        h, n = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found.append(np.insert(h, np.cumsum(n), END))
        counts.append(n + 1)
    return (np.concatenate(found), np.concatenate(counts)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in 32 bits where they fit."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return b"\x04" + steps.astype("<u4").tobytes() if not len(steps) or int(steps.max()) < 1 << 32 else b"\x08" + steps.astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The keys of a packed block."""
    return np.cumsum(np.frombuffer(data, "<u4" if data[:1] == b"\x04" else "<u8", offset=1).astype(np.uint64), dtype=np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers, bytes of one rank together and compressed; leading bytes that are zero everywhere are left out."""
    size = values.dtype.itemsize
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, size)[:, :width].T)
    return np.array([len(values), size, width], "<u8").tobytes() + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def expand(data: bytes) -> np.ndarray:
    """The integers of a squeezed array."""
    n, size, width = map(int, np.frombuffer(data, "<u8", 3))
    planes = pa.Codec("zstd").decompress(data[24:], n * width, asbytes=True)
    out = np.zeros((n, size), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view(f"<u{size}").ravel()


def spread(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each key."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def look_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray, missing=0) -> np.ndarray:
    """values of keys in a sorted table."""
    if not len(table):
        return np.full(len(keys), missing, values.dtype)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], missing)


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for 0 < r <= ORDER_K from n[r], the numbers of types seen r times: Katz's Good-Turing ratios, or absolute
    discounts where the counts of counts allow none between 0 and 1."""
    d = np.ones(ORDER_K + 1)
    k = ORDER_K
    cut = (k + 1) * n[k + 1] / n[1] if n[1] else 0
    for r in range(1, k + 1):
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut != 1 else 0
        d[r] = ratio if 0 < ratio < 1 else 1 - TAIL / r
    return d


def adjusted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts: d[r] r up to ORDER_K, above it r - TAIL, so that every context keeps some mass to back off with."""
    return np.where(counts <= ORDER_K, counts * d[np.minimum(counts, ORDER_K)], counts - TAIL)


#: Rows that move between partitions: blocks of counts, questions of batches of texts, and sums for their texts.
_NAMES = ("keys", "counts", "contexts", "words", "values", "weights", "docs", "sums", "batches", "lengths")
_BLOCK = "side string, p int, batch long, " + ", ".join(f"{n} binary" for n in _NAMES)
_ARROW = pa.schema([("side", pa.string()), ("p", pa.int32()), ("batch", pa.int64()), *[(n, pa.binary()) for n in _NAMES]])


def _rows(rows: list[dict], schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    """Dictionaries of arrays and values as rows; what is missing is null."""
    return pa.RecordBatch.from_pylist([{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in r.items()} for r in rows], schema=schema)


def _table(rows: list[dict], schema: pa.Schema = _ARROW) -> pa.Table:
    return pa.Table.from_batches([_rows(rows, schema)])


def _read(row: dict, name: str, kind: str = "<u8") -> np.ndarray:
    return np.frombuffer(row[name] or b"", kind)


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *arrays])


def _runs(part: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values in a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(part) else []
    return list(zip(at, [*at[1:], len(part)]))


def _dealt(side: str, by: np.ndarray, parts: int, **arrays: np.ndarray) -> list[dict]:
    """One row for each partition that `by` falls into, with its share of the arrays."""
    part = spread(by, parts)
    order = np.argsort(part, kind="stable")
    part = part[order]
    arrays = {k: v[order] for k, v in arrays.items()}
    return [{"side": side, "p": int(part[a])} | {k: v[a:b] for k, v in arrays.items()} for a, b in _runs(part)]


def chain(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context with a word after it."""
    return mix(context * _CHAIN + word)


def named(columns: list[np.ndarray]) -> np.ndarray:
    """The hashes of n-grams from the hashes of their words, a column for each place."""
    h = columns[0]
    for w in columns[1:]:
        h = chain(h, w)
    return h


def grams(own: np.ndarray, counts: np.ndarray, order: int, start) -> list[np.ndarray]:
    """For each token the n-gram that ends with it, a column for each place; start stands for what is before a text."""
    at = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    found = [own]
    for k in range(1, order):
        shifted = np.full(len(own), start, own.dtype)
        shifted[k:] = own[: len(own) - k]
        shifted[at < k] = start
        found.insert(0, shifted)
    return found


def arranged(codes: list[np.ndarray], part: np.ndarray | None = None) -> np.ndarray:
    """The order of n-grams by partition and by codes: equal ones are neighbours, and the columns compress well."""
    bits = max(1, *(int(c.max(initial=0)).bit_length() for c in codes))
    if bits * len(codes) > 64:
        return np.lexsort(codes[::-1] if part is None else (*codes[::-1], part))
    key = codes[0].astype(np.uint64)
    for c in codes[1:]:
        key = key << np.uint64(bits) | c
    order = np.argsort(key)
    return order if part is None else order[np.argsort(part[order], kind="stable")]


def _packed(codes: list[np.ndarray], others: np.ndarray, size: int) -> dict:
    """n-grams as fields of a row: the codes of broadcast words, below `size`, and places among the hashes of the row's other words."""
    flat = np.concatenate(codes)
    rare = flat >= size
    used, at = np.unique(flat[rare], return_inverse=True)
    flat[rare] = size + at
    return {"words": squeeze(flat), "keys": others[used.astype(np.int64) - size]}


def _unpacked(rows: list[dict], k: int, m: Model) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of codes of the n-grams of some rows, hashes of the words whose codes come after those of the broadcast ones)."""
    others, size, found = np.unique(np.concatenate([_read(r, "keys") for r in rows])), len(m.names), []
    for r in rows:
        codes = expand(r["words"])
        rare = codes >= size
        codes[rare] = size + np.searchsorted(others, _read(r, "keys"))[codes[rare].astype(np.int64) - size]
        found.append(codes.reshape(k, -1))
    return list(np.concatenate(found, axis=1)), others


class Model:
    """What every task needs: totals, discounts and the broadcast words."""

    def __init__(self, folded: bool):
        self.folded, self.d = folded, {}

    def share(self, spark: SparkSession, words: np.ndarray, counts: np.ndarray) -> None:
        """Broadcasts words, sorted by their hashes, with their counts, and codes for them, the most frequent first."""
        self.size = len(words)
        table = np.concatenate([words, np.array([START, OTHERS])])
        counts = np.concatenate([counts, [0, 0]])
        by_count = np.argsort(-counts, kind="stable")
        names, rank = table[by_count], np.empty(len(table), np.uint32)
        rank[by_count] = np.arange(len(table))
        order = np.argsort(table)
        self.cache = spark.sparkContext.broadcast((table[order], rank[order], names, counts[by_count]))

    @property
    def names(self) -> np.ndarray:
        """The hash of each code."""
        return self.cache.value[2]

    @property
    def times(self) -> np.ndarray:
        """The training count of each code."""
        return self.cache.value[3]

    def hashes(self, codes: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The hashes of words."""
        out, rare = self.names[np.minimum(codes, len(self.names) - 1)], codes >= len(self.names)
        out[rare] = others[codes[rare].astype(np.int64) - len(self.names)]
        return out

    def cached(self, hashes: np.ndarray) -> np.ndarray:
        """Training counts of broadcast words, 0 for all others."""
        found = look_up(hashes, *self.cache.value[:2], np.uint32(0xFFFFFFFF))
        return np.where(found == 0xFFFFFFFF, 0, self.times[np.minimum(found, len(self.names) - 1)])

    def codes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a code of each word, hashes of the words whose codes come after those of the broadcast ones)."""
        found = look_up(hashes, *self.cache.value[:2], np.uint32(0xFFFFFFFF))
        rare = found == 0xFFFFFFFF
        others, at = np.unique(hashes[rare], return_inverse=True)
        found[rare] = len(self.names) + at
        return found, others

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        """The tokens themselves; in a class model OTHERS for those that are not in the vocabulary."""
        return np.where(self.cached(hashes) > 0, hashes, OTHERS) if self.folded else hashes

    def words_p(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of words with their training counts."""
        return np.where(counts > 0, adjusted(counts, self.d[1]) / max(self.total, 1), self.unseen)

    def own_p(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probabilities of classes with their training counts."""
        p = self.words_p(counts)
        return np.where(keys == OTHERS, self.others, p) if self.folded else p

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        """log10((c + 1) / (N + 1 * (V + 1)))."""
        return np.log10((counts + 1) / (self.total + self.types + 1))


def _counted_words(rows: DataFrame, parts: int) -> DataFrame:
    """A staged table of blocks with the words of the training texts and their counts, dealt and sorted by hash."""

    def run(batches):
        for batch in batches:
            found = pa.array(tokens(batch.column("text"))[0]).value_counts()
            keys, times = found.field(0).to_numpy(zero_copy_only=False), found.field(1).to_numpy(zero_copy_only=False)
            yield _rows(_dealt("1", keys, parts, keys=keys, counts=times.astype("<u4")))

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys, counts = summed(np.concatenate([_read(r, "keys") for r in rows]), np.concatenate([_read(r, "counts", "<u4") for r in rows]).astype("<i8"))
        return _table([{"side": "1", "p": rows[0]["p"], "keys": keys, "counts": counts}])

    return staged(rows.where("not held").select("text").mapInArrow(lean(run), _BLOCK).groupBy("p").applyInArrow(lean_group(merge), _BLOCK), "lm-1")


def _parted(batch: pa.RecordBatch, k: int, parts: int, m: Model) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, tuple]:
    """The n-grams of k words of a batch of texts, arranged: (columns of codes, the other words' hashes, partition by context,
    text of each, and of the tokens as they stand in the texts: hashes, texts, training counts of broadcast words)."""
    hashes, counts = tokens(batch.column("text"))
    doc = np.repeat(np.arange(batch.num_rows, dtype="<u4"), counts)
    found = pa.array(hashes).dictionary_encode()
    kinds, at = found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False)
    own = m.classes(kinds)
    part = spread(named(grams(own[at], counts, k, START)[:-1]), parts)
    part = part.astype(np.uint16) if parts < 1 << 16 else part
    codes, others = m.codes(own)
    columns = grams(codes[at], counts, k, m.codes(np.array([START]))[0][0])
    order = arranged(columns, part)
    return [c[order] for c in columns], others, part[order], doc[order], (hashes, doc, m.cached(kinds)[at])


def _held(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("held").to_numpy(zero_copy_only=False).astype(bool)


def _kinds(rows: list[dict], k: int, m: Model) -> tuple[dict, np.ndarray, np.ndarray]:
    """(fields of a block with the different n-grams of some rows, order of the rows' n-grams by it, place there of these)."""
    columns, others = _unpacked(rows, k, m)
    order = arranged(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return _packed([c[new] for c in columns], others, len(m.names)), order, (np.cumsum(new) - 1).astype(np.uint32)


def _counted(rows: DataFrame, k: int, parts: int, m: Model) -> DataFrame:
    """A staged table of blocks with the n-grams of k words of all texts and their counts in the training texts, dealt by context."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, others, part, doc, _ = _parted(batch, k, parts, m)
            new = np.ones(len(part), bool)
            new[1:] = np.logical_or.reduce([part[1:] != part[:-1], *[c[1:] != c[:-1] for c in columns]])
            first = np.flatnonzero(new)
            times = np.add.reduceat((~_held(batch)[doc]).astype(np.uint32), first)
            columns, part = [c[first] for c in columns], part[first]
            yield _rows([{"side": str(k), "p": int(part[a]), "counts": squeeze(times[a:b])} | _packed([c[a:b] for c in columns], others, len(m.names)) for a, b in _runs(part)])

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        block, order, place = _kinds(rows, k, m)
        times = np.bincount(place, np.concatenate([expand(r["counts"]) for r in rows])[order]).astype(np.uint64)
        return _table([{"side": str(k), "p": rows[0]["p"], "counts": squeeze(times)} | block])

    return staged(rows.mapInArrow(lean(run), _BLOCK).groupBy("p").applyInArrow(lean_group(merge), _BLOCK), f"lm-{k}")


def _statistics(table: DataFrame, plain: bool = False) -> tuple[int, int, list[int], np.ndarray]:
    """(total, types, types seen r times up to ORDER_K + 1, types by power of two). plain: counts are not squeezed."""

    def run(batches):
        total, kinds, low, high = 0, 0, np.zeros(ORDER_K + 2, np.int64), np.zeros(64, np.int64)
        for batch in batches:
            for block in batch.column("counts").to_pylist():
                c = np.frombuffer(block, "<i8") if plain else expand(block).astype(np.int64)
                c = c[c > 0]
                total, kinds = total + int(c.sum()), kinds + len(c)
                low += np.bincount(np.minimum(c, ORDER_K + 2), minlength=ORDER_K + 3)[: ORDER_K + 2]
                high += np.bincount(np.log2(c).astype(int), minlength=64)
        yield pa.RecordBatch.from_arrays([pa.array([[total, kinds, *low.tolist(), *high.tolist()]], pa.list_(pa.int64()))], ["s"])

    width = 2 + ORDER_K + 2 + 64
    r = table.select("counts").mapInArrow(run, "s array<long>").agg(*[F.coalesce(F.sum(F.col("s")[i]), F.lit(0)).alias(f"s{i}") for i in range(width)]).first()
    s = list(r)
    return s[0], s[1], s[2 : 4 + ORDER_K], np.array(s[4 + ORDER_K :])


def _most_frequent(table: DataFrame, high: np.ndarray, limit: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the words with the largest counts, sorted by key: at most `limit`. exact: just the limit's, ties by
    key; else those whose count has a power of two that all fit with."""
    tail = np.cumsum(high[::-1])[::-1]
    fits = np.flatnonzero(tail <= limit)
    power = int(fits[0]) if len(fits) else 64
    least = 1 << min(62, max(0, power - 1 if exact else power))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                counts = _read(r, "counts", "<i8")
                keep = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(_read(r, "keys")[keep].view(np.int64)), pa.array(counts[keep])], ["key", "c"])

    found = table.select("keys", "counts").mapInArrow(run, "key long, c long")
    if exact:
        found = found.orderBy(F.desc("c"), "key").limit(limit)
    got = found.toArrow()
    keys, counts = got.column("key").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


class Block:
    """The n-grams of a block, arranged: log10 probabilities of those that were seen, and for each context how often it was, its
    discounted counts and how many classes follow it. The probabilities lack the scale of contexts after which every class was
    seen (`whole`; only a class model has such)."""

    def __init__(self, row: dict | None, k: int, m: Model):
        self.m = m
        self.codes, self.others = _unpacked([row], k, m) if row else ([np.empty(0, np.uint32)] * k, np.empty(0, np.uint64))
        self.counts = expand(row["counts"]).astype(np.int64) if row else np.empty(0, np.int64)
        self.seen = self.counts > 0
        new = np.ones(len(self.counts), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in self.codes[:-1]])
        self.first, self.at = np.flatnonzero(new), np.cumsum(new) - 1
        n, each = len(self.first), np.where(self.seen, adjusted(self.counts, m.d[k]), 0.0)
        self.total, self.kept, self.n = np.bincount(self.at, self.counts, n), np.bincount(self.at, each, n), np.bincount(self.at, self.seen, n)
        self.known, self.missed = self.n > 0, np.bincount(self.at, ~self.seen, n) > 0
        self.whole = self.n > m.size if m.folded else np.zeros(n, bool)
        self.p = np.full(len(self.counts), np.nan)
        self.p[self.seen] = np.log10(each[self.seen] / self.total[self.at[self.seen]])

    def hashes(self, rows, first: int = 0, last: int | None = None) -> np.ndarray:
        """Hashes of some n-grams, or of their words from `first` up to `last`."""
        return named([self.m.hashes(c[rows], self.others) for c in self.codes[first:last]])

    def contexts(self) -> np.ndarray:
        return self.hashes(self.first, 0, -1)


def _weighed(table: DataFrame, shorter: list[DataFrame], k: int, parts: int, m: Model) -> DataFrame:
    """A staged table with log10 backoff weights (weights) and scales (values) of the contexts of k - 1 words that are asked for:
    those before an n-gram of a text of the held-out part that was not seen, and those after which every class was seen.

    A context's weight needs the shorter probabilities of all that follow it: broadcast words are told at once, all else asks the
    partitions of the shorter table, whose sums for each context go back to the partition that has the context."""

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r, k, m)
                chosen = b.known & (b.missed | b.whole)
                use = np.flatnonzero(b.seen & chosen[b.at])
                context, sums = b.contexts(), np.zeros(len(chosen))
                if k == 2:
                    word = b.codes[1][use]
                    near = word < len(m.names)
                    sums = np.bincount(b.at[use[near]], m.own_p(m.names[word[near]], m.times[word[near]]), len(chosen))
                    use = use[~near]
                own = {"contexts": context, "values": b.total, "weights": b.kept, "counts": b.n.astype("<i8"), "sums": sums}
                by = b.hashes(use, 1, -1 if k > 2 else None)
                yield _rows([{"side": "own", "p": r["p"]} | {n: x[chosen] for n, x in own.items()}, *_dealt("ask", by, parts, keys=b.hashes(use, 1), contexts=context[b.at[use]])])

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        if not any(r["side"] in ("ask", "own") for r in rows):
            return _table([])
        base = next((r for r in rows if r["side"] == str(k - 1)), None)
        if k == 2:
            keys, values = (_read(base, "keys"), _read(base, "counts", "<i8")) if base else (np.empty(0, np.uint64), np.empty(0, np.int64))
        else:
            b = Block(base, k - 1, m)
            values = 10**b.p
            for r in rows:
                if r["side"] == f"w{k - 1}":
                    values *= 10 ** look_up(b.contexts(), _read(r, "contexts"), _read(r, "values", "<f8"), 0.0)[b.at]
            seen = np.flatnonzero(b.seen)
            keys = b.hashes(seen)
            order = np.argsort(keys)
            keys, values = keys[order], values[seen][order]
        found, sums = [], []
        for r in rows:
            if r["side"] == "ask":
                own = _read(r, "keys")
                found.append(_read(r, "contexts"))
                sums.append(m.own_p(own, look_up(own, keys, values)) if k == 2 else look_up(own, keys, values, 0.0))
        found, sums = summed(_joined(found, np.uint64), _joined(sums, float))
        return _table([r for r in rows if r["side"] == "own"] + _dealt("sum", found, parts, contexts=found, sums=sums))

    def weigh(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next((r for r in rows if r["side"] == "own"), None)
        if own is None:
            return _table([])
        known, total, kept = _read(own, "contexts"), _read(own, "values", "<f8"), _read(own, "weights", "<f8")
        told = [r for r in rows if r["side"] == "sum"]
        backed = summed(_joined([_read(r, "contexts") for r in told], np.uint64), _joined([_read(r, "sums", "<f8") for r in told], float))
        free = 1 - _read(own, "sums", "<f8") - look_up(known, *backed, 0.0)
        full = free < 1e-12  # every word was seen there: nothing to back off to
        if m.folded:
            full |= _read(own, "counts", "<i8") > m.size
        weight = np.where(full, 1e-300, (total - kept) / total / np.where(full, 1, free))
        order = np.argsort(known)
        return _table([{"side": f"w{k}", "p": own["p"], "contexts": known[order], "weights": np.log10(weight)[order], "values": np.where(full, np.log10(total / kept), 0.0)[order]}])

    asked = table.mapInArrow(lean(ask), _BLOCK)
    for t in shorter:
        asked = asked.unionByName(t)
    return staged(asked.groupBy("p").applyInArrow(lean_group(answer), _BLOCK).groupBy("p").applyInArrow(lean_group(weigh), _BLOCK), f"lm-weights-{k}")


def train(rows: DataFrame, parts: int, order: int = 2, vocabulary: int | None = None, frequent: int | None = None) -> tuple[Model, list[DataFrame], list[DataFrame]]:
    """(model, tables of the n-grams of 1, 2, ... order - 1 words, tables of the weights of contexts in these) from the rows whose
    `held` is false."""
    m = Model(vocabulary is not None)
    tables, weights = [_counted_words(rows, parts)], []
    m.total, m.types, low, high = _statistics(tables[0], plain=True)
    m.d[1] = discounts(low)
    limit = min(CACHED, CACHED if frequent is None else frequent) if vocabulary is None else vocabulary
    top, counts = _most_frequent(tables[0], high, limit, exact=m.folded)
    m.share(rows.sparkSession, top, counts)
    kept = sum(low[r] * r * (1 - m.d[1][r]) for r in range(1, ORDER_K + 1)) + TAIL * (m.types - sum(low[1 : ORDER_K + 1]))
    m.unseen = kept / m.total if m.total else 1.0
    m.others = 1 - m.words_p(counts).sum()
    for k in range(2, order):
        tables.append(_counted(rows, k, parts, m))
        m.d[k] = discounts(_statistics(tables[-1])[2])
        weights.append(_weighed(tables[-1], [tables[-2], *weights[-1:]], k, parts, m))
    return m, tables, weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, vocabulary: int | None = None, frequent: int | None = None, order: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row. frequent: fewer words to broadcast than
    CACHED; the results are the same."""
    if order < 2:
        raise ValueError("a backoff model needs an order of two at least")
    spark: SparkSession = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_rows(docs, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"}).withColumn("held", fold("id"))
    m, tables, weights = train(rows, parts, order, vocabulary, frequent)
    kind = rows.schema["id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.string())
    if kind not in ("bigint", "int", "string"):
        rows, kind = rows.withColumn("id", F.col("id").cast("string")), "string"
    fields = pa.schema([*_ARROW, ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_()))])
    schema = f"{_BLOCK}, ids array<{kind}>, held array<boolean>"

    def emit(batches):
        """What is known here, a row for each batch of texts; words not broadcast, as questions; the longest n-grams with their texts."""
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, others, part, doc, (hashes, own_doc, c) = _parted(batch, order, parts, m)
            name, held = batch.column(ROW)[0].as_py(), _held(batch)
            common = c > 0
            add = lambda x: np.bincount(own_doc[common], x, batch.num_rows)
            sums = np.vstack([np.bincount(own_doc, minlength=batch.num_rows), add(np.ones(common.sum())), add(m.log_base(c[common])), np.zeros(batch.num_rows)])
            found = [{"side": "d", "p": name % parts, "ids": batch.column("id").to_pylist(), "held": held.tolist(), "sums": sums}]
            found += _dealt("1", hashes[~common], parts, keys=hashes[~common], docs=own_doc[~common])
            marked = doc * np.uint32(2) + held[doc]  # one bit tells training texts from those held out
            found += [{"side": "g", "p": int(part[a]), "docs": squeeze(marked[a:b])} | _packed([x[a:b] for x in columns], others, len(m.names)) for a, b in _runs(part)]
            yield _rows([r | {"batch": name} for r in found], fields)

    def told(batches: np.ndarray, text: np.ndarray, *values: np.ndarray) -> list[dict]:
        """Sums for texts: of the score alone, or of known words, base and score. text: place in `batches` and text there, 32 bits each."""
        at, text = np.unique(text, return_inverse=True)
        sums, batch = np.vstack([np.bincount(text, x, len(at)) for x in values]), at >> np.uint64(32)
        return [{"side": "s", "batch": int(batches[batch[a]]), "docs": squeeze(at[a:b].astype(np.uint32)), "sums": sums[:, a:b]} for a, b in _runs(batch)]

    def from_texts(batches: np.ndarray, text: np.ndarray) -> dict:
        """Texts as fields of a row."""
        used, at = np.unique(text >> np.uint64(32), return_inverse=True)
        return {"batches": batches[used], "lengths": squeeze(at.astype(np.uint32)), "docs": squeeze(text.astype(np.uint32))}

    def texts(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """The texts of some rows."""
        batches = np.unique(np.concatenate([_read(r, "batches", "<i8") for r in rows]))
        place = [np.searchsorted(batches, _read(r, "batches", "<i8")).astype(np.uint64)[expand(r["lengths"])] for r in rows]
        return batches, np.concatenate([x << np.uint64(32) | expand(r["docs"]) for x, r in zip(place, rows)])

    def count(group: pa.Table) -> pa.Table:
        """The longest n-grams' counts, and which of them each batch's texts have; the base sums of words that are not broadcast."""
        rows = group.to_pylist()
        if rows[0]["side"] == "d":
            return group.select(fields.names)
        if rows[0]["side"] == "g":
            block, by, place = _kinds(rows, order, m)
            docs, lengths = [expand(r["docs"]) for r in rows], []
            batch = np.repeat(np.arange(len(rows), dtype=np.uint16 if len(rows) < 1 << 16 else np.int64), [len(x) for x in docs])[by]
            docs = np.concatenate(docs)[by]
            times = np.bincount(place, docs & 1 == 0).astype(np.uint64)
            by = np.argsort(batch, kind="stable")  # each batch's n-grams in the order of the block
            batch, place, docs = batch[by], place[by], docs[by]
            runs = _runs(batch)
            steps = np.concatenate([np.diff(place[a:b], prepend=np.uint32(0)) for a, b in runs])
            return _table([{"side": "g", "p": rows[0]["p"], "counts": squeeze(times), "values": squeeze(steps), "docs": squeeze(docs), "batches": np.array([rows[batch[a]]["batch"] for a, _ in runs], "<i8"), "lengths": np.array([b - a for a, b in runs], "<i8")} | block], fields)
        table, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for r in rows:
            if r["batch"] is None:
                table, counts = _read(r, "keys"), _read(r, "counts", "<i8")
        found = []
        for r in rows:
            if r["batch"] is not None:
                c = look_up(_read(r, "keys"), table, counts)
                share = np.log10(m.words_p(c) / m.others) if m.folded else np.zeros(len(c))
                found += told(np.array([r["batch"]]), _read(r, "docs", "<u4").astype(np.uint64), (c > 0).astype(float), m.log_base(c), share)
        return _table(found, fields)

    def asked(k: int, batches: np.ndarray, codes: list[np.ndarray], others: np.ndarray, text: np.ndarray) -> list[dict]:
        """Questions for n-grams of k words, dealt as these are; what broadcast words tell is told at once."""
        if k == 1:
            near = codes[0] < len(m.names)
            word = codes[0][near]
            found = told(batches, text[near], np.log10(np.maximum(m.own_p(m.names[word], m.times[word]), 1e-300)))
            codes, text = [codes[0][~near]], text[~near]
        else:
            found = []
        part = spread(named([m.hashes(c, others) for c in (codes[:-1] or codes)]), parts)
        order = arranged(codes, part)
        part, codes, text = part[order], [c[order] for c in codes], text[order]
        return found + [{"side": f"q{k}", "p": int(part[a]), "batch": -1} | from_texts(batches, text[a:b]) | _packed([c[a:b] for c in codes], others, len(m.names)) for a, b in _runs(part)]

    def replies(k: int, p: int, batches: np.ndarray, text: np.ndarray, value: np.ndarray, codes: list[np.ndarray], others: np.ndarray, known: np.ndarray, whole: np.ndarray) -> list[dict]:
        """Sums for texts from a block of n-grams of k words; what was missed asks on, one word shorter, and, where its context is
        known, for the weight; what was seen asks for the scale where its context is whole."""
        miss = np.isnan(value)
        hit = np.flatnonzero(~miss)
        found = told(batches, text[hit], value[hit])
        for side, rows in (("weights", miss & known), ("values", ~miss & whole)):
            if rows.any():
                context = named([m.hashes(c[rows], others) for c in codes[:-1]])
                found.append({"side": f"w{k}", "p": p, "batch": -1, "contexts": context, "words": side.encode()} | from_texts(batches, text[rows]))
        return found + asked(k - 1, batches, [c[miss] for c in codes[1:]], others, text[miss])

    def resolve_longest(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r, order, m)
                steps, names, lengths = expand(r["values"]), _read(r, "batches", "<i8"), _read(r, "lengths", "<i8")
                ends = np.cumsum(lengths)
                kinds = np.concatenate([np.cumsum(steps[e - n : e], dtype=np.int64) for e, n in zip(ends, lengths)])
                text = np.repeat(np.arange(len(names), dtype=np.uint64), lengths) << np.uint64(32) | (expand(r["docs"]) >> np.uint32(1))
                at = b.at[kinds]
                yield _rows(replies(order, r["p"], names, text, b.p[kinds], [c[kinds] for c in b.codes], b.others, b.known[at], b.whole[at]), fields)

    def resolver(k: int):
        def resolve(group: pa.Table) -> pa.Table:
            rows = group.to_pylist()
            base = next((r for r in rows if r["batch"] is None), None)
            questions = [r for r in rows if r["batch"] is not None]
            if not questions:
                return _table([], fields)
            names, text = texts(questions)
            codes, others = _unpacked(questions, k, m)
            keys = named([m.hashes(c, others) for c in codes])
            if k == 1:
                table, counts = (_read(base, "keys"), _read(base, "counts", "<i8")) if base else (np.empty(0, np.uint64), np.empty(0, np.int64))
                return _table(told(names, text, np.log10(np.maximum(m.own_p(keys, look_up(keys, table, counts)), 1e-300))), fields)
            b = Block(base, k, m)
            own, context = b.hashes(slice(None)), b.contexts()
            by, order = np.argsort(own), np.argsort(context)
            value = look_up(keys, own[by], b.p[by], np.nan)
            before = named([m.hashes(c, others) for c in codes[:-1]])
            known, whole = (look_up(before, context[order], x[order], False) for x in (b.known, b.whole))
            return _table(replies(k, rows[0]["p"], names, text, value, codes, others, known, whole), fields)

        return lean_group(resolve)

    def weigh(group: pa.Table) -> pa.Table:
        """The weights and scales that texts asked for."""
        rows = group.to_pylist()
        base = next((r for r in rows if r["batch"] is None), None)
        found = []
        for r in rows:
            if r["batch"] is not None:
                kept = (_read(base, "contexts"), _read(base, r["words"].decode(), "<f8")) if base else (np.empty(0, np.uint64), np.empty(0))
                found += told(*texts([r]), look_up(_read(r, "contexts"), *kept, 0.0))
        return _table(found, fields)

    def gather(group: pa.Table) -> pa.Table:
        """The texts of one batch, with the sums from all partitions."""
        rows = group.to_pylist()
        head = next(r for r in rows if r["side"] == "d")
        ids, held = head["ids"], head["held"]
        sums = _read(head, "sums", "<f8").reshape(4, len(ids)).copy()
        for r in rows:
            if r["side"] == "s":
                at = expand(r["docs"])
                more = _read(r, "sums", "<f8").reshape(-1, len(at))
                sums[4 - len(more) :, at] += more
        return pa.table({"id": pa.array(ids, id_type), "held_out": held, "n_tokens": sums[0].astype(np.int64), "n_known": np.rint(sums[1]).astype(np.int64), "train_tokens": np.full(len(ids), model_total), "base_score": sums[2], "score": sums[3]})

    model_total = int(m.total)
    empty = {"ids": F.lit(None).cast(f"array<{kind}>"), "held": F.lit(None).cast("array<boolean>")}
    tables, weights = ([t.withColumns(empty) for t in x] for x in (tables, weights))
    counted = staged(rows.mapInArrow(lean(emit), schema).unionByName(tables[0]).groupBy("side", "p").applyInArrow(lean_group(count), schema), "lm-texts")
    longest = counted.where("side = 'g'")
    m.d[order] = discounts(_statistics(longest)[2])
    weights.append(_weighed(longest.drop("ids", "held"), [t.drop("ids", "held") for t in [tables[-1], *weights[-1:]]], order, parts, m).withColumns(empty))
    asking = staged(longest.mapInArrow(lean(resolve_longest), schema), f"lm-asked-{order}")
    sums = [counted.where("side = 'd'"), counted.where("side = 's'"), asking.where("side = 's'")]
    for k in range(order, 0, -1):
        if k < order:
            asking = staged(asking.where(F.col("side") == f"q{k}").unionByName(tables[k - 1]).groupBy("p").applyInArrow(resolver(k), schema), f"lm-asked-{k}")
            sums.append(asking.where("side = 's'"))
        if k > 1:
            sums.append(asking.where(F.col("side") == f"w{k}").unionByName(weights[k - 2]).groupBy("p").applyInArrow(lean_group(weigh), schema))
    out = sums[0]
    for x in sums[1:]:
        out = out.unionByName(x)
    out = out.groupBy("batch").applyInArrow(lean_group(gather), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
