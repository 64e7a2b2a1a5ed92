"""Mining of phrases whose words stand together more often than apart, by merged count-min sketches and one exact pass.

First pass: every task counts the words and n-grams of its texts in a count-min sketch of its own (two rows of saturating cells,
keyed by language and n-gram); the sketches are added up cell by cell, in blocks that travel on their own. An estimate is never too
low, so an n-gram whose smaller cell is under the threshold is rare for certain. Second pass: whatever may be frequent is counted
exactly, by its text; tasks add up their own copies first. Then the phrases are cut, scored and subsumed by joins.

The sketch has a cell for every 8 characters of text, MOST_CELLS at most, so that a task's arrays and the two bit maps that are
broadcast (MOST_CELLS / 4 bytes) have a fixed bound. Beyond that the sketch fills up and lets more n-grams through to the exact count,
which stays exact and is made for that: tasks send their phrases sorted and compressed, by bucket, and a bucket is added up on its own.

Rows: a null text is an empty one, a null language is `und`; repeated rows count each time; extra columns are ignored, whatever their
names; ties of score go to the higher count, then to the phrase that is less in UTF-8; empty texts have no words; a text of any length
is read whole, in slices of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import LOWER, byte_values, hot_join, lean, mix, slices, utf8
from eventloom.session import discard, ship_package, staged

#: Bytes that end a piece, and those that stand between words.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Cells of a sketch row at least and at most, and of a block of them that travels as one row.
LEAST_CELLS, MOST_CELLS, BLOCK = 1 << 16, 1 << 25, 1 << 18
#: Phrases that a task adds up before it sends them on; characters of text for each bucket of phrases, and buckets at least.
HELD, PER_BUCKET, LEAST_BUCKETS = 1 << 21, 1 << 26, 64
_CODEC = "zstd"
_PACKED = {"bucket": pa.int64(), "lang": pa.string(), "phrases": pa.binary(), "size": pa.int64(), "counts": pa.binary(), "n": pa.int64()}
#: First-level groups of the ranking of a language.
SALTS = 64
_NOT_WORD, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_NOT_WORD[list(BREAKS + BLANKS)] = True
_BREAK[list(BREAKS)] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Slice:
    """The words of some texts of one language: distinct words exactly, by their bytes, and each place as a number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~_NOT_WORD[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        first[begins] = inside[begins]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = inside[ends]
        starts, self.n = np.flatnonzero(first), 0
        if not len(starts):
            return
        self.n = len(starts)
        letters = LOWER[data[inside]]
        sizes = np.flatnonzero(last) + 1 - starts
        bounds = np.zeros(self.n + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        words = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        self.words = words.dictionary
        self.id = words.indices.to_numpy().astype(np.int64)
        #: pieces are numbered over all texts: a break or a new text begins another
        self.piece = np.cumsum(_BREAK[data])[starts] + np.searchsorted(offsets, starts, "right")

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        _, bounds, data = self.words.buffers()
        bounds = np.frombuffer(bounds, np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
        data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        sizes = np.diff(bounds)
        within = np.arange(len(data)) - np.repeat(bounds[:-1] - bounds[0], sizes)
        return mix(np.add.reduceat(byte_values(data, within), bounds[:-1] - bounds[0]) + sizes.astype(np.uint64))

    def grams(self, most: int, seed: np.uint64):
        """(k, places where an n-gram of k words begins, their hashes, which of the last ones they go on from) for k from 1 to most."""
        word = self.hashes()[self.id]
        at, h, go = np.arange(self.n), mix(word + seed), np.arange(self.n)
        for k in range(1, most + 1):
            yield k, at, h, go
            fits = at + k < self.n
            fits[fits] = self.piece[at[fits] + k] == self.piece[at[fits]]
            go = np.flatnonzero(fits)
            at = at[go]
            h = mix(h[go] * _STEP + word[at + k])

    def named(self, most: int, seed: np.uint64):
        """(k, places, hashes, names): a name is a number that tells an n-gram from all others of k words in this slice. It is made of
        the name of the n-gram that is a word shorter, numbered anew so that it stays small, and the last word."""
        key = np.zeros(self.n, np.int64)
        for k, at, h, go in self.grams(most, seed):
            key = (np.unique(key, return_inverse=True)[1] if k > 2 else key)[go] * len(self.words) + self.id[at + k - 1]
            yield k, at, h, key

    def texts(self, places: np.ndarray, k: int) -> pa.Array:
        """The n-grams of k words at some places, their words joined by spaces."""
        columns = [self.words.take(pa.array(self.id[places + i])).cast(pa.large_string()) for i in range(k)]
        return pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())).cast(pa.string())


def _seed(lang: str) -> np.uint64:
    """What tells a language's n-grams apart from those of others."""
    raw = np.frombuffer(lang.encode() + b"\0", np.uint8)
    return mix(np.add.reduce(byte_values(raw, np.arange(len(raw))), keepdims=True))[0]


def _by_language(batch: pa.RecordBatch, limit: int = 1 << 20):
    """(language, Slice) over the texts of a batch, about `limit` bytes at a time."""
    langs = batch.column("lang").dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        own = np.flatnonzero(langs.indices.to_numpy() == k)
        data, offsets = utf8(batch.column("text").take(pa.array(own)))
        for start, end in slices(offsets, limit):
            part = Slice(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
            if part.n:
                yield lang, part


def _cells(h: np.ndarray, cells: int):
    """The cell of each hash in both rows of the sketch."""
    yield (h >> np.uint64(1)).astype(np.int64) & (cells - 1)
    yield (h >> np.uint64(33)).astype(np.int64) & (cells - 1)


def _add(row: np.ndarray, cells: np.ndarray, top: int) -> None:
    """Count cells in a row of the sketch; no cell goes beyond top, which is all that the threshold asks for."""
    for at in range(0, len(cells), 1 << 19):
        own, counts = np.unique(cells[at : at + (1 << 19)], return_counts=True)
        row[own] = np.minimum(row[own] + np.minimum(counts, top), top)


def sketch(texts: DataFrame, cells: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit maps: cells whose merged count is `least` or more."""
    top = min(least, 120)
    block = min(BLOCK, cells)

    def count(batches):
        rows = [np.zeros(cells, np.uint8) for _ in range(2)]
        for batch in batches:
            for lang, part in _by_language(batch):
                for _, _, h, _ in part.grams(most, _seed(lang)):
                    for row, own in zip(rows, _cells(h, cells), strict=True):
                        _add(row, own, top)
        for r, row in enumerate(rows):
            for b in range(0, cells, block):
                own = row[b : b + block]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([r * (cells // block) + b // block], pa.int64()), pa.array([pa.compress(own.tobytes(), _CODEC, asbytes=True)], pa.binary())], ["block", "body"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), strict=True):
                own = np.frombuffer(pa.decompress(body, block, _CODEC, asbytes=True), np.uint8)
                sums[b] = np.minimum(sums[b] + own, top) if b in sums else own
        for b, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.packbits(own >= top).tobytes()], pa.binary())], ["block", "body"])

    kind = "block long, body binary"
    merged = staged(texts.mapInArrow(lean(count), kind).repartition("block").mapInArrow(lean(merge), kind), "sketch")
    bits = np.zeros((2, cells // 8), np.uint8)
    for r in merged.collect():  # the bits of a sketch, whose size is bounded
        row, b = divmod(r["block"], cells // block)
        own = np.frombuffer(r["body"], np.uint8)
        bits[row, b * (block // 8) : b * (block // 8) + len(own)] = own
    discard(merged)
    return bits[0], bits[1]


def _set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


class Tally:
    """Exact counts of phrases, added up in a task and packed by bucket: sorted phrases, one a line, and their counts."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.rows = buckets, [], 0

    def add(self, lang: str, phrases: pa.Array, h: np.ndarray, counts: np.ndarray):
        n = len(phrases)
        self.held.append(pa.table({"lang": pa.array([lang] * n, pa.string()), "phrase": phrases, "h": pa.array(h, pa.uint64()), "f": pa.array(counts, pa.int64())}))
        self.rows += n
        return self.packed() if self.rows > HELD else iter(())

    def packed(self):
        """Batches (bucket, lang, phrases, size, counts) of what is held."""
        if not self.held:
            return
        all_ = pa.concat_tables(self.held).group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum"), ("h", "min")])
        self.held, self.rows = [], 0
        own = pa.array((mix(all_["h_min"].to_numpy()) >> np.uint64(20)).astype(np.int64) % self.buckets)
        all_ = all_.append_column("bucket", own).sort_by([("bucket", "ascending"), ("lang", "ascending"), ("phrase", "ascending")]).combine_chunks()
        bucket = all_["bucket"].to_numpy()
        lang = all_["lang"].combine_chunks().dictionary_encode()
        edge = np.flatnonzero(np.diff(bucket) | np.diff(lang.indices.to_numpy())) + 1
        for start, end in zip([0, *edge.tolist()], [*edge.tolist(), len(bucket)], strict=True):
            lines = "\n".join(all_["phrase"].slice(start, end - start).to_pylist()).encode()
            counts = all_["f_sum"].slice(start, end - start).to_numpy().astype("<i8").tobytes()
            row = [int(bucket[start]), all_["lang"][start].as_py(), pa.compress(lines, _CODEC, asbytes=True), len(lines), pa.compress(counts, _CODEC, asbytes=True), end - start]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _PACKED.values(), strict=True)], list(_PACKED))


def _unpacked(batches, least: int):
    """(lang, phrase, f) from packed counts that come bucket by bucket: one bucket is held at a time, each phrase in it once."""
    held, rows, at = [], 0, None

    def merged():
        found = pa.concat_tables(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
        return found.rename_columns({"f_sum": "f"}).select(["lang", "phrase", "f"])

    def done():
        whole = merged()
        return whole.filter(pc.or_(pc.greater_equal(whole["f"], least), pc.equal(whole["phrase"], ""))).combine_chunks().to_batches()

    for batch in batches:
        for r in batch.to_pylist():
            if held and r["bucket"] != at:
                yield from done()
                held, rows = [], 0
            at = r["bucket"]
            lines = pa.decompress(r["phrases"], r["size"], _CODEC, asbytes=True).decode().split("\n")
            counts = np.frombuffer(pa.decompress(r["counts"], 8 * r["n"], _CODEC, asbytes=True), "<i8")
            held.append(pa.table({"lang": pa.array([r["lang"]] * r["n"], pa.string()), "phrase": pa.array(lines, pa.string()), "f": pa.array(counts)}))
            rows += r["n"]
            if rows > HELD:
                held = [merged()]
                rows = 0
    if held:
        yield from done()


def exact(texts: DataFrame, maps: tuple[np.ndarray, np.ndarray], cells: int, most: int, least: int, buckets: int) -> DataFrame:
    """(lang, phrase, f) of every n-gram with f >= least that the sketch lets through, and each language's words, as phrase ''."""
    bits = texts.sparkSession.sparkContext.broadcast(maps)

    def count(batches):
        a, b = bits.value
        tally = Tally(buckets)
        for batch in batches:
            for lang, part in _by_language(batch):
                seed = _seed(lang)
                yield from tally.add(lang, pa.array([""]), np.array([seed]), np.array([part.n]))
                for k, at, h, key in part.named(most, seed):
                    first, second = _cells(h, cells)
                    keep = np.flatnonzero(_set(a, first))
                    keep = keep[_set(b, second[keep])]
                    _, where, n = np.unique(key[keep], return_index=True, return_counts=True)
                    if len(where):
                        yield from tally.add(lang, part.texts(at[keep[where]], k), h[keep[where]], n)
        yield from tally.packed()

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    packed = texts.mapInArrow(lean(count), ", ".join(f"{n} {kinds[t]}" for n, t in _PACKED.items()))
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lean(lambda batches: _unpacked(batches, least)), "lang string, phrase string, f long")


def cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): the lowest-scoring cut of each candidate (lang, phrase, a), ties to the first.

    A part is at least as frequent as the phrase, so counts has it. Very common first and last words are joined where they are.
    """
    known = counts.select(F.struct("lang", "phrase").alias("part"), "f")
    words = F.split("phrase", " ")
    each = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    sides = {"l": F.slice(words, F.lit(1), F.col("k")), "r": F.slice(words, F.col("k") + 1, F.size(words) - F.col("k"))}
    for side, part in sides.items():
        whole = each.withColumn("part", F.struct("lang", F.concat_ws(" ", part).alias("phrase")))
        each = staged(hot_join(whole, known.withColumnRenamed("f", side), "part").drop("part"), "cuts")
    # floor of a quotient of whole numbers beyond 64 bits
    scored = each.withColumn("score", F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")


def subsumed(candidates: DataFrame, share: int) -> DataFrame:
    """(lang, phrase) of candidates (lang, phrase, a) with `share` % or more of their count inside one longer candidate."""
    words = F.split("phrase", " ")
    inner = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.concat_ws(" ", F.slice(words, i, n)))
    longer = candidates.where(F.size(words) > 2).select("lang", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), inner))).alias("phrase"), "a")
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    return candidates.join(most.hint("merge"), ["lang", "phrase"]).where(100 * F.col("within") >= share * F.col("a")).select("lang", "phrase")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to most_words words that stand `least` times or
    more, without those of whose occurrences `share` % or more lie in one longer candidate."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    cells = 1 << max(LEAST_CELLS.bit_length() - 1, min(MOST_CELLS.bit_length() - 1, (chars // 8).bit_length()))
    maps = sketch(texts, cells, most_words, least)
    counts = staged(exact(texts, maps, cells, most_words, least, max(LEAST_BUCKETS, chars // PER_BUCKET)), "phrases")
    candidates = counts.where("instr(phrase, ' ') > 0").select("lang", "phrase", F.col("f").alias("a"))
    scored = cuts(candidates, counts).join(subsumed(candidates, share).hint("merge"), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: DuckDB SQL of the query over `documents`.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces WHERE piece <> ''),
grams AS (
  SELECT lang, unnest(w) AS phrase, 1 AS k FROM worded
  UNION ALL SELECT lang, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]), 2 FROM worded
  UNION ALL SELECT lang, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]), 3 FROM worded),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT *, unnest(range(1, k)) AS c FROM cand),
parts AS (
  SELECT cut.lang, cut.phrase, cut.k, cut.a, cut.c, x.f AS l, y.f AS r, ((1000000::HUGEINT * cut.a * cut.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1:cut.c], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[cut.c + 1:], ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_part AS (
  SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM cand WHERE k = 3),
gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN inner_part i ON i.lang = c.lang AND i.phrase = c.phrase WHERE c.k = 2 AND 100 * i.a >= 50 * c.a),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM best b JOIN total t ON t.lang = b.lang WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = b.lang AND g.phrase = b.phrase))
SELECT * FROM ranked WHERE rank <= 2000
"""
