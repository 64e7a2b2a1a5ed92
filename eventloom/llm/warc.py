"""WARC archives: a writer, and the monolithic gzip normaliser with its sidecar offset index.

Each task writes archives as one gzip stream for the whole file, as many crawlers do; such a file can't be read from the
middle. The normaliser inflates every file once, front to back, rewrites each record as a gzip member of its own and writes a
sidecar index of offsets. Records are then read through the index, each from its own place.

Of records with equal payloads of at least LEAST bytes, that with the smallest id is the response; the others revisit it and
carry no payload. Which rows these are is settled on digests; a page's payload never moves unless it may be a copy.

Rows: a null page is an empty payload, always a response; null URLs have no target header; rows with a null id come last
among equals; repeated rows stay, the first of them is the response; extra columns are dropped; an empty table gives an empty
result. Files are opened through pyarrow.fs, so the shared folder may be in any store that it knows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import ROW, lean, split_rows, with_rows
from eventloom.session import fresh_path, staged

LEAST, FILE_BYTES, PIECE = 100, 128 << 20, 1 << 20
DATE = "1970-01-01T00:00:00Z"


def _open(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def record_id(row: int) -> str:
    """A record's id: the same whenever a task is repeated."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page-row:{row}')}>"


def record(row: int, page: int | None, url: str | None, payload: bytes, size: int, digest: str, first_row: int | None, first: int | None) -> bytes:
    """One record: an HTTP response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first_row is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first_row is not None else 'response'}", f"WARC-Record-ID: {record_id(row)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c not in "\r\n" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first_row is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first_row)}", f"X-Refers-To-Page: {'' if first is None else first}"]
    head += [f"X-Page: {'' if page is None else page}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(rows: DataFrame, folder: str) -> DataFrame:
    """(path) of the archives written: gzip streams over whole files of about FILE_BYTES."""

    def run(batches):
        files, out, packer, size = [], None, None, 0
        store, base = _open(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, packer, size = store.open_output_stream(f"{base}/{files[-1]}", compression=None), zlib.compressobj(5, zlib.DEFLATED, 31), 0
                data = record(r[ROW], r["id"], r["url"], (r["html"] or "").encode(), r["size"], r["digest"], r["first_row"], r["first"])
                out.write(packer.compress(data))
                size += len(data)
                if size >= FILE_BYTES:
                    out.write(packer.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], ["name"])

    return rows.mapInArrow(lean(run), "name string")


def _inflate(stream):
    """The bytes of a gzip file of any number of members, piece by piece."""
    state = zlib.decompressobj(31)
    while piece := stream.read(PIECE):
        while piece:
            yield state.decompress(piece)
            piece = state.unused_data
            if state.eof:
                state = zlib.decompressobj(31)
    yield state.flush()


def records(pieces):
    """Whole records from inflated pieces; memory holds one record and one piece."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(header(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def header(data: bytes) -> dict[str, str]:
    """A record's named fields in lower case."""
    lines = data.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def normalise(files: DataFrame, folder: str, out: str) -> DataFrame:
    """(file, offset, length): rewrite monolithic archives with a member for each record; the index also goes beside each file."""

    def run(batches):
        source, base = _open(folder)
        target, to = _open(out)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                index, at, final = [], 0, f"{uuid.uuid4().hex}.warc.gz"
                with source.open_input_stream(f"{base}/{name}", compression=None) as stream, target.open_output_stream(f"{to}/{final}", compression=None) as sink:
                    for r in records(_inflate(stream)):
                        packer = zlib.compressobj(5, zlib.DEFLATED, 31)
                        member = packer.compress(r) + packer.flush()
                        sink.write(member)
                        index.append((at, len(member)))
                        at += len(member)
                with target.open_output_stream(f"{to}/{final}.idx") as sink:
                    sink.write("".join(f"{a} {n}\n" for a, n in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([final] * len(index)), pa.array([a for a, _ in index], pa.int64()), pa.array([n for _, n in index], pa.int64())], ["file", "offset", "length"])

    return files.mapInArrow(lean(run), "file string, offset long, length long")


def read(index: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """The records that an index lists; the payload of each response is hashed and compared with its digest."""

    def run(batches):
        store, base = _open(folder)
        name, stream = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    if stream:
                        stream.close()
                    name, stream = r["file"], store.open_input_file(f"{base}/{r['file']}")
                data = zlib.decompress(stream.read_at(r["length"], r["offset"]), 31)
                head, _, block = data.partition(b"\r\n\r\n")
                fields = header(head)
                http, _, payload = block[:-4].partition(b"\r\n\r\n")
                digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                size = int(header(http)["content-length"])
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"record {fields['warc-record-id']} is damaged")
                rows.append((fields["x-page"] or None, size, digest, kind, fields.get("x-refers-to-page") or None, fields.get("warc-target-uri")))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        if stream:
            stream.close()

    out = index.mapInArrow(lean(run), "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return out.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """Write pages as archives and normalise them: (index, folder of the normalised archives)."""
    spark = pages.sparkSession
    # staged, as rows are read twice and joined by their ids
    rows = staged(with_rows(pages, id_col, url_col, html_col).withColumnsRenamed({id_col: "id", url_col: "url", html_col: "html"}), "pages")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = rows.withColumns({"digest": F.sha2(payload, 256), "size": F.octet_length(payload).cast("long")})
    thin = staged(rows.where(F.col("size") >= LEAST).select("id", ROW, "digest"), "payloads")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col(ROW))
    firsts = thin.groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1").select("digest", F.col(f"f.{ROW}").alias("first_row"), F.col("f.id").alias("first"))
    copies = staged(thin.select(ROW, "digest").join(firsts, "digest").where(F.col(ROW) != F.col("first_row")).select(F.col(ROW).alias("r"), "first_row", "first"), "revisits")
    sure, perhaps = split_rows(rows, copies)
    kind = rows.schema["id"].dataType.simpleString()
    alone = sure.withColumns({"first_row": F.lit(None).cast("long"), "first": F.lit(None).cast(kind)})
    maybe = perhaps.join(copies, F.col(ROW) == F.col("r"), "left").drop("r")
    raw, out = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    for folder in (raw, out):
        store, base = _open(folder)
        store.create_dir(base)
    files = staged(_write(alone.unionByName(maybe), raw), "warc-files")
    count = max(1, files.count())
    index = staged(normalise(files.repartition(min(count, 10_000)), raw, out), "warc-index")
    store, base = _open(raw)
    store.delete_dir(base)  # the monolithic files are all rewritten
    return index, out


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from the archives."""
    index, folder = archive(pages, id_col, url_col, html_col)
    back = read(index, folder, pages.schema[id_col].dataType.simpleString())
    return back.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
