"""Media columns: content-defined payload chunking with deduplicated storage and verified reconstruction.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the 8-bit samples of a WAV stream. A rolling
gear hash cuts the stream into chunks. A Spark aggregation of the chunk digests finds those that occur more than once: they
go to a shared store, one copy each; all other chunks stay inline with their stream. Reading back, the ordered chunk lists
are joined with both stores, every chunk's digest is checked, and features come from the bytes that were read.

Rows: null and empty texts are 64 zero bytes; repeated rows and ids stay; equal texts have equal values and are stored
once; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.chunking import cuts
from eventloom.llm.common import ROW, in_map, lean, lean_group, membership, slices, utf8, with_rows
from eventloom.session import staged

RATE, BITS, LEAST, MOST = 8000, 11, 256, 16384
_GEAR = np.random.default_rng(977).integers(0, 2**64, 256, dtype=np.uint64)


def header(samples: int) -> bytes:
    """The 44 bytes before the samples of a mono 8-bit WAV stream."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + samples, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", samples)


def to_media(raw: bytes) -> bytes:
    """The stored form of a text's bytes."""
    padded = max(64, -(-len(raw) // 64) * 64)
    return header(padded) + raw + bytes(padded - len(raw))


def features(samples: bytes) -> str:
    """Mean, spread and mean-crossing rate of the samples, from integer sums."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    total, square, n = int(x.sum()), int((x * x).sum()), len(x)
    crossings = int(np.count_nonzero(np.diff((x * n > total).astype(np.int8)))) if n > 1 else 0
    return f"mean={total / n:.4f};var={(square * n - total * total) / (n * n):.4f};cross={crossings / n:.4f};peak={int(x.max())}"


def _streams(texts: pa.Array):
    """Portions of a batch: (first row, media streams, chunk ends of each)."""
    data, offsets = utf8(texts)
    for start, end in slices(offsets, 1 << 22):
        media = [to_media(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(start, end)]
        flat = np.frombuffer(b"".join(media), np.uint8)
        at = np.zeros(len(media) + 1, np.int64)
        np.cumsum([len(m) for m in media], out=at[1:])
        yield start, media, cuts(_GEAR[flat], at, BITS, LEAST, MOST)


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _slot(digests: list[bytes]) -> np.ndarray:
    """The membership slot of digests: their first 26 bits, as in the SQL expression beside it."""
    return np.frombuffer(b"".join(d[:4] for d in digests), ">u4").astype(np.int64) >> 6


def _recipes(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start, media, ends in _streams(batch.column("text")):
                part = batch.slice(start, len(media))
                size = np.diff(utf8(part.column("text"))[1])
                digests = [[_digest(m[a:b]) for a, b in zip([0, *e[:-1]], e)] for m, e in zip(media, ends)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(size, pa.int64()), pa.array([hashlib.sha256(m).digest() for m in media], pa.binary()), pa.array(digests, pa.list_(pa.binary()))],
                    ["id", "n_bytes", "recipe", "digests"],
                )

    return rows.mapInArrow(lean(run), f"id {kind}, n_bytes long, recipe binary, digests array<binary>")


def _inline(texts: DataFrame, repeated) -> DataFrame:
    """(recipe, total, seqs, chunks): each stream's chunks that occur nowhere else."""

    def run(batches):
        table = np.frombuffer(repeated.value, np.uint8)
        for batch in batches:
            for _, media, ends in _streams(batch.column("text")):
                out: list[list] = [[], [], [], []]
                for m, e in zip(media, ends):
                    chunks = [m[a:b] for a, b in zip([0, *e[:-1]], e)]
                    own = np.flatnonzero(~in_map(table, _slot([_digest(c) for c in chunks]))).tolist()
                    if own:
                        for column, value in zip(out, (hashlib.sha256(m).digest(), len(chunks), own, [chunks[i] for i in own])):
                            column.append(value)
                kinds = (pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["recipe", "total", "seqs", "chunks"])

    return texts.mapInArrow(lean(run), "recipe binary, total int, seqs array<int>, chunks array<binary>")


def _shared(texts: DataFrame, repeated) -> DataFrame:
    """(digest, chunk): chunks that may occur more than once, each once for a task."""

    def run(batches):
        table, seen = np.frombuffer(repeated.value, np.uint8), set()
        for batch in batches:
            for _, media, ends in _streams(batch.column("text")):
                found = {}
                for m, e in zip(media, ends):
                    chunks = [m[a:b] for a, b in zip([0, *e[:-1]], e)]
                    digests = [_digest(c) for c in chunks]
                    for i in np.flatnonzero(in_map(table, _slot(digests))).tolist():
                        if digests[i] not in seen:
                            found[digests[i]] = chunks[i]
                if len(seen) > 200_000:  # only spares rows: the aggregation after it keeps one of each
                    seen.clear()
                seen |= found.keys()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "chunk"])

    return texts.mapInArrow(lean(run), "digest binary, chunk binary")


_VALUES = "recipe binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _values(recipes: list[bytes], streams: list[bytes]) -> pa.RecordBatch:
    """What the streams that were read back hold; a stream that isn't its recipe's stops the job."""
    rows = []
    for recipe, m in zip(recipes, streams):
        if hashlib.sha256(m).digest() != recipe:
            raise ValueError(f"media stream {recipe.hex()} cannot be reconstructed")
        samples = m[44:]
        rows.append((recipe, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(m), recipe.hex(), features(samples)))
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _VALUES.split(", ")])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the texts as media; (manifest (id, n_bytes, recipe, digests), inline chunks, shared chunks)."""
    spark = docs.sparkSession
    rows = with_rows(docs, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"}).drop(ROW)
    manifest = staged(_recipes(rows), "media-manifest")
    repeated = manifest.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(membership(repeated.select(F.expr("conv(hex(substring(digest, 1, 4)), 16, 10)").cast("long").alias("v")), None, slot=F.expr("shiftright(v, 6)")))
    texts = rows.select("text")
    inline = staged(_inline(texts, bits), "media-inline")
    shared = staged(_shared(texts, bits).groupBy("digest").agg(F.first("chunk").alias("chunk")), "media-shared")
    return manifest, inline, shared


def read(manifest: DataFrame, inline: DataFrame, shared: DataFrame) -> DataFrame:
    """The values of every distinct stream, from the chunks of both stores."""

    def whole(batches):
        for batch in batches:
            yield _values(batch.column("recipe").to_pylist(), [b"".join(c) for c in batch.column("chunks").to_pylist()])

    def assemble(group):
        chunks = dict(zip(group.column("seq").to_pylist(), group.column("chunk").to_pylist()))
        recipe = group.column("recipe")[0].as_py()
        return pa.Table.from_batches([_values([recipe], [b"".join(chunks[i] for i in range(len(chunks)))])])

    alone = inline.where("size(seqs) = total").mapInArrow(lean(whole), _VALUES)
    lists = manifest.groupBy("recipe").agg(F.first("digests").alias("digests")).select("recipe", F.posexplode("digests").alias("seq", "digest"))
    pieces = lists.join(shared, "digest").select("recipe", "seq", "chunk").union(
        inline.where("size(seqs) < total").select("recipe", F.explode(F.arrays_zip("seqs", "chunks")).alias("z")).select("recipe", "z.seqs", "z.chunks")
    )
    return alone.union(pieces.groupBy("recipe").applyInArrow(lean_group(assemble), _VALUES))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read it back: a row for each document, with what the stored bytes hold."""
    manifest, inline, shared = store(docs, id_col, text_col)
    values = staged(read(manifest, inline, shared), "media-values")
    return manifest.select(F.col("id").alias(id_col), "n_bytes", "recipe").join(values, "recipe").drop("recipe")
