"""Token-id output as a content-addressed store.

Every text is encoded, its end id appended, and the id stream cut where a rolling gear hash of the last ids says so. A chunk's
key is the digest of its bytes. One shuffle by key keeps each chunk once and carries the documents' recipes (ordered chunk
digests) along; the manifest lists the documents in ascending id order with the position of their first id, a Merkle root
each and a root over each manifest part. Reading back, every stored chunk is hashed again and compared with its key, the
Merkle roots are rebuilt, and a document's CRC is combined from those of its chunks, so that no payload moves twice.

Rows: null and empty texts are the end id alone; rows with a null id come first; repeated rows and ids stay, in the order of
their Merkle roots; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.bpe import printable_bytes
from eventloom.llm.chunking import cuts
from eventloom.llm.common import ROW, byte_values, lean, mix, remembered, with_rows
from eventloom.session import fresh_path, one_time, staged

END, BITS, LEAST, MOST = 2, 8, 64, 1024
#: So many pieces are remembered, by 64-bit hashes, besides those of the batch at hand.
KEPT = 250_000


class _Encoder:
    """Texts to ids by way of the tokenizer's own pieces, which no token reaches over.

    A plain text (letters below U+0300, no special token in it) is normalised by lower-casing alone. Plain texts are cut at
    once over all their bytes, as the vocabulary's pattern says; distinct pieces, told apart by 64-bit hashes, are encoded
    once each by the library's merge model. Words of other texts that are not plain go through the whole library. A bounded
    number of pieces is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        special = "|".join(regex.escape(t["content"]) for t in whole["added_tokens"])
        self.odd = re.compile("[^\x00-\u02ff]" + ("|" + special if special else ""))
        cut = [p["pattern"]["Regex"] for p in (whole["pre_tokenizer"] or {}).get("pretokenizers", ()) if p["type"] == "Split" and p["invert"]]
        lower = [n["type"] for n in (whole["normalizer"] or {}).get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]
        self.fits = cut == [PATTERN] and lower
        self.spell = {b: c for c, b in printable_bytes().items()}
        self.known: dict[int, bytes] = {}

    def lowered(self, text: str) -> bytes | None:
        """A plain text's normal form, None for others."""
        if not self.fits or self.odd.search(text):
            return None
        low = text.lower()
        return low.encode() if low.isascii() or not self.odd.search(low) else None

    def pieces(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each text)."""
        data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
        kinds = KIND_OF[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):  # letters below U+0300 have two bytes, the second takes the kind of the first
            points = ((data[lead] & 31).astype(np.int64) << 6) | (data[lead + 1] & 63)
            kinds = kinds.copy()
            kinds[lead] = kinds[lead + 1] = KIND_OF_POINT[points]
        first = np.empty(len(data), bool)
        first[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
        first |= kinds == 2  # digits stand alone
        if len(lead):
            first[lead + 1] = False
        self._contractions(data, kinds, first)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        real = kinds[starts] != 0
        starts, lengths = starts[real], (ends - starts)[real]
        if not len(starts):
            return np.empty(0, "<u4"), np.zeros(len(raws), np.int64)
        offsets = np.cumsum(lengths) - lengths
        within = np.arange(lengths.sum()) - np.repeat(offsets, lengths)
        hashes = mix(np.add.reduceat(byte_values(data[np.repeat(starts, lengths) + within], within), offsets) + lengths.astype(np.uint64))
        distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known = self._learn(distinct.tolist(), data, starts[at], lengths[at])
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        count = size[inverse]
        base = (np.cumsum(size) - size)[inverse] - (np.cumsum(count) - count)
        ids = flat[np.repeat(base, count) + np.arange(count.sum())]
        text_ends = np.cumsum([len(r) + 1 for r in raws])
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[np.searchsorted(starts, text_ends)], prepend=0)

    @staticmethod
    def _contractions(data: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> None:
        """Cut 's 't 'm 'd 're 've 'll off where an apostrophe begins a piece."""
        at = np.flatnonzero(first & (data == 0x27))
        at = at[at + 2 < len(data)]
        one, two = data[at + 1], data[at + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((one == 0x6C) & (two == 0x6C))
        for own, n in ((at[short], 2), (at[long], 3)):
            first[own + 1] = False
            rest = own + n
            rest = rest[rest < len(data)]
            first[rest[kinds[rest] == 1]] = True

    def _learn(self, hashes: list[int], data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.known) > KEPT:
            self.known = {h: self.known[h] for h in hashes if h in self.known}
        known, tokens, spell, blob = self.known, self.model.tokenize, self.spell.__getitem__, data.tobytes()
        for h, start, n in zip(hashes, starts.tolist(), lengths.tolist()):
            if h not in known:
                raw = blob[start : start + n]
                ids = [t.id for t in tokens(raw.decode() if raw.isalnum() else "".join(map(spell, raw)))]
                known[h] = struct.pack(f"<{len(ids)}I", *ids)
        return list(map(known.__getitem__, hashes))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; a text that is not plain is cut at blanks, which always end a token."""
        raws, place, words = [], [], []
        for i, t in enumerate(texts):
            low = self.lowered(t)
            if low is not None:
                raws.append(low)
                place.append((i, False, 0))
                continue
            for w in t.replace("\n", " ").split(" "):
                low = self.lowered(w)
                place.append((i, low is None, len(words)))
                (words if low is None else raws).append(w if low is None else low)
        odd = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ids, counts = self.pieces(raws) if raws else (np.empty(0, "<u4"), np.empty(0, np.int64))
        plain = iter(np.split(ids, np.cumsum(counts)[:-1])) if raws else iter(())
        own: list[list[np.ndarray]] = [[] for _ in texts]
        for i, is_odd, k in place:
            own[i].append(odd[k] if is_odd else next(plain))
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in own]


#: Fixed value: the pattern of the vocabularies that `pieces` cuts as.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What the pattern tells apart, by code point below U+0300 and by byte: 0 white space, 1 letters, 2 digits, 3 the rest.
KIND_OF_POINT = np.array([next(k for k, p in enumerate((r"\s", r"\p{L}", r"\p{N}", r"(?s:.)")) if regex.fullmatch(p, chr(i))) for i in range(0x300)], np.uint8)
KIND_OF = np.concatenate([KIND_OF_POINT[:128], np.full(128, 3, np.uint8)])


@remembered
@functools.lru_cache(2)
def _encoder(path: str) -> _Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Encoder(path)


def encode_batch(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts, without end ids, as little-endian 32-bit integers."""
    return [ids.tobytes() for ids in _encoder(path).encode(texts)]


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node at the end of a level moves up as it is."""
    level = digests or [b""]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return hashlib.sha256(b"\x00" + level[0]).digest()


class Tree:
    """The same root from leaves that come one after another: holds one node for each level."""

    def __init__(self):
        self.levels: list[tuple[int, bytes]] = []  # (height, node) of whole subtrees, the highest first
        self.leaves = 0

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.levels and self.levels[-1][0] == height:
            leaf = hashlib.sha256(b"\x01" + self.levels.pop()[1] + leaf).digest()
            height += 1
        self.levels.append((height, leaf))
        self.leaves += 1

    def root(self) -> bytes:
        nodes = [n for _, n in self.levels] or [b""]
        top = nodes.pop()
        while nodes:
            top = hashlib.sha256(b"\x01" + nodes.pop() + top).digest()
        return hashlib.sha256(b"\x00" + top).digest()


def pack(ids: np.ndarray) -> bytes:
    """Stored form of a chunk: 16-bit ids where all fit, else 32-bit ids, told apart by the first byte."""
    narrow = not len(ids) or int(ids.max()) < 65536
    return (b"\x02" + ids.astype("<u2").tobytes()) if narrow else (b"\x04" + ids.astype("<u4").tobytes())


def unpack(chunk: bytes) -> np.ndarray:
    """The ids of a stored chunk."""
    return np.frombuffer(chunk, "<u2" if chunk[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


@functools.lru_cache(4096)
def _shift(length: int) -> list[int]:
    """The GF(2) operator on a CRC-32 that `length` zero bytes stand for: what each bit of the CRC becomes."""
    zeros = bytes(length)
    base = zlib.crc32(zeros)
    return [zlib.crc32(zeros, 1 << k) ^ base for k in range(32)]


def join_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings joined, from their own and the second's length."""
    out = second
    for k, row in enumerate(_shift(length)):
        if first >> k & 1:
            out ^= row
    return out


def _records(rows: DataFrame, path: str, end: int) -> DataFrame:
    """(kind, key, id, body, n, digests): chunks by digest, recipes by row; a task sends each chunk once while it remembers it."""
    kind = rows.schema["id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else None

    def run(batches):
        tail, sent = np.array([end], "<u4").tobytes(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                streams = [b + tail for b in encode_batch([t or "" for t in part.column("text").to_pylist()], path)]
                ids = np.frombuffer(b"".join(streams), "<u4")
                offsets = np.zeros(len(streams) + 1, np.int64)
                np.cumsum([len(s) // 4 for s in streams], out=offsets[1:])
                ends = cuts(mix(ids.astype(np.uint64) + np.uint64(1)), offsets, BITS, LEAST, MOST)
                chunks, recipes = {}, []
                for start, e in zip(offsets[:-1].tolist(), ends):
                    own = []
                    for a, b in zip([0, *e[:-1]], e):
                        body = pack(ids[start + a : start + b])
                        own.append(hashlib.sha256(body).digest())
                        if own[-1] not in sent:
                            chunks[own[-1]] = body
                    recipes.append(own)
                if len(sent) > 200_000:  # only spares rows: the aggregation after it keeps one of each
                    sent.clear()
                sent |= chunks.keys()
                n, m = len(chunks), len(streams)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["chunk"] * n + ["recipe"] * m),
                        pa.array(list(chunks) + [int(r).to_bytes(8, "big") for r in part.column(ROW).to_pylist()], pa.binary()),
                        pa.array([None] * n + part.column("id").to_pylist(), id_type or part.column("id").type),
                        pa.array([*chunks.values()] + [None] * m, pa.binary()),
                        pa.array([None] * n + np.diff(offsets).tolist(), pa.int64()),
                        pa.array([None] * n + [b"".join(r) for r in recipes], pa.binary()),
                    ],
                    ["kind", "key", "id", "body", "n", "digests"],
                )

    return rows.mapInArrow(lean(run), f"kind string, key binary, id {kind}, body binary, n long, digests binary")


def write(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the store; (chunks (key, body), manifest (id, start, n_tokens, part, digests, root, key), parts (part, root, n_documents))."""
    spark = docs.sparkSession
    rows = with_rows(docs, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"})
    out = fresh_path(spark, "tokens")
    first = {c: F.first(c).alias(c) for c in ("id", "body", "n", "digests")}
    records = _records(rows, path, end)
    with one_time(spark):
        records.groupBy("kind", "key").agg(*first.values()).write.partitionBy("kind").option("compression", "zstd").parquet(f"{out}/store")
    back = spark.read.schema(records.schema).parquet(f"{out}/store")
    recipes = back.where("kind = 'recipe'").select("id", "n", "digests", "key")
    kind = rows.schema["id"].dataType.simpleString()

    def number(batches):
        """Positions inside a part, Merkle roots, and a last row with the part's own count and root."""
        at, tree, part, schema = 0, Tree(), None, None
        for batch in batches:
            n = batch.column("n").to_numpy()
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            roots = [merkle([d[i : i + 32] for i in range(0, len(d), 32)]) for d in batch.column("digests").to_pylist()]
            for root in roots:
                tree.add(root)
            out = pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(starts, pa.int64()), batch.column("n"), batch.column("part"), batch.column("digests"), pa.array(roots, pa.binary()), batch.column("key")],
                ["id", "within", "n_tokens", "part", "digests", "root", "key"],
            )
            part, schema = batch.column("part")[0].as_py() if batch.num_rows else part, out.schema
            yield out
        if tree.leaves:
            yield pa.RecordBatch.from_pylist([{"within": tree.leaves, "n_tokens": at, "part": part, "root": tree.root()}], schema)

    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = (F.col("id").asc_nulls_first(), F.sha2("digests", 256), "key")
    ordered = recipes.repartitionByRange(count, *order).sortWithinPartitions(*order)
    numbered = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(number, f"id {kind}, within long, n_tokens long, part int, digests binary, root binary, key binary")
    numbered = staged(numbered, "manifest-parts")
    # one row for each part: a small table whatever the input's size
    parts = numbered.where("key is null").select("part", "root", F.col("within").alias("n_documents"), F.col("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(parts.select("part", before.alias("before")))
    manifest = numbered.where("key is not null").join(starts, "part").select("id", (F.col("within") + F.col("before")).alias("start"), "n_tokens", "part", "digests", "root", "key")
    return back.where("kind = 'chunk'").select("key", "body"), manifest, parts.select("part", "root", "n_documents")


def verify_parts(manifest: DataFrame, parts: DataFrame) -> None:
    """Build every part's root anew from the documents' roots in their order; a part that differs stops the job."""

    def run(batches):
        part, tree = None, Tree()
        found = []
        for batch in batches:
            for p, root in zip(batch.column("part").to_pylist(), batch.column("root").to_pylist()):
                if p != part:
                    found += [] if part is None else [(part, tree.root(), tree.leaves)]
                    part, tree = p, Tree()
                tree.add(root)
        found += [] if part is None else [(part, tree.root(), tree.leaves)]
        columns = list(zip(*found)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64()))], ["part", "built", "n"])

    thin = manifest.select("part", "start", F.sha2("digests", 256).alias("d"), "key", "root").repartition("part").sortWithinPartitions("part", "start", "d", "key")
    built = thin.select("part", "root").mapInArrow(lean(run), "part int, built binary, n long")
    wrong = parts.join(built, "part", "full").where("not coalesce(root = built and n_documents = n, false)").select("part").limit(5).collect()
    if wrong:
        raise ValueError(f"manifest parts {[r['part'] for r in wrong]} differ from their roots")


def verified_chunks(chunks: DataFrame) -> DataFrame:
    """(digest, n, crc) of every stored chunk; a chunk that doesn't match its key stops the job."""

    def run(batches):
        for batch in batches:
            sizes, sums = [], []
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                if hashlib.sha256(body).digest() != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                ids = unpack(body)
                sizes.append(len(ids))
                sums.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int32()), pa.array(sums, pa.int64())], ["digest", "n", "crc"])

    return chunks.mapInArrow(lean(run), "digest binary, n int, crc long")


def read(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, n_chunks) of every document, from the stored chunks."""
    listed = manifest.select("key", F.explode(F.sequence(F.lit(0), F.expr("int(length(digests) / 32) - 1"))).alias("seq"), "digests")
    listed = listed.select("key", "seq", F.expr("substring(digests, seq * 32 + 1, 32)").alias("digest"))
    found = listed.join(verified_chunks(chunks), "digest")
    whole = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc", "digest"))).alias("parts"))
    kind = manifest.schema["id"].dataType.simpleString()
    joined = manifest.select("id", "start", "n_tokens", "root", "key").join(whole, "key").drop("key")

    def run(batches):
        for batch in batches:
            sums, counts = [], []
            flat = batch.column("parts")
            lengths = np.diff(flat.offsets.to_numpy())
            inner = flat.flatten()
            n, crc, digest = inner.field("n").to_pylist(), inner.field("crc").to_pylist(), inner.field("digest").to_pylist()
            at = 0
            for size, total, root in zip(lengths.tolist(), batch.column("n_tokens").to_pylist(), batch.column("root").to_pylist()):
                value = 0
                for i in range(at, at + size):
                    value = join_crc(value, crc[i], 4 * n[i])
                if sum(n[at : at + size]) != total or merkle(digest[at : at + size]) != root:
                    raise ValueError("a document differs from its manifest")
                at += size
                sums.append(value)
                counts.append(size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64()), pa.array(counts, pa.int64())], ["id", "start", "n_tokens", "ids_crc32", "n_chunks"])

    return joined.mapInArrow(lean(run), f"id {kind}, start long, n_tokens long, ids_crc32 long, n_chunks long")


def documents(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, ids array) of every document, rebuilt from the stored chunks."""
    listed = manifest.select("id", "key", F.explode(F.sequence(F.lit(0), F.expr("int(length(digests) / 32) - 1"))).alias("seq"), "digests")
    listed = listed.select("id", "key", "seq", F.expr("substring(digests, seq * 32 + 1, 32)").alias("digest"))
    whole = listed.join(chunks.withColumnRenamed("key", "digest"), "digest").groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("parts"))
    kind = manifest.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = [np.concatenate([unpack(p["body"]) for p in parts]).tolist() for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int64()))], ["id", "ids"])

    return whole.mapInArrow(run, f"id {kind}, ids array<long>")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write, verify and read back: (doc_id, start, n_tokens, ids_crc32, n_chunks)."""
    chunks, manifest, parts = write(docs, path, id_col=id_col, text_col=text_col)
    verify_parts(manifest, parts)
    return read(chunks, manifest).withColumnRenamed("id", id_col)
