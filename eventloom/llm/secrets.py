"""Secret scans by multipart credential linking.

Strong patterns are found in every text. Access identifiers, bare secrets and endpoints are also taken as parts; an
interval join inside each document brings together the parts whose intervals, widened by REACH code points, meet.
A weak part is reported only when its complement co-occurs: a bare secret with an identifier, a named identifier with a
secret and an endpoint, an endpoint with an identifier and a secret.

Rows: null and empty texts have no spans; repeated rows and ids stay separate rows; extra columns are dropped (kept by
redact); an empty table gives an empty result. Equal starts are ordered by the kinds' order, then by end.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import ROW, lean, split_rows, spread_join, with_rows
from eventloom.session import ship_package, staged

#: The kinds in order, the patterns of the contract.
KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The parts that are weak on their own.
NAMED_ID = re.compile(r"""(?:client|account|user|access)_?(?:id|key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._-]{6,}+)""", re.I | re.A)
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+(?![A-Za-z0-9+/_-])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])")
REACH = 256

_HEX_RUN = b"h" * 32
_HEX_MASK = bytes(ord("h") if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong patterns, sorted; cheap byte searches skip texts that can have none."""
    raw = text.encode()
    low = raw.lower()
    out = []
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_RUN in raw.translate(_HEX_MASK):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out)


def parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int, bool]]:
    """(role, start, end, weak) of what may belong together; none unless the text has some identifier."""
    ids = [("identifier", s, e, False) for s, k, e in base if k == 1]
    if "id" in (low := text.lower()) or "key" in low:  # every name in NAMED_ID ends with one of them
        ids += [("identifier", m.start(1), m.end(1), True) for m in NAMED_ID.finditer(text)]
    if not ids:
        return []
    out = ids + [("secret", s, e, False) for s, k, e in base if k != 1]
    taken = [(s, e) for s, _, e in base] + [(s, e) for _, s, e, _ in ids]
    for m in BARE.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v):
            out.append(("secret", m.start(), m.end(), True))
    out += [("endpoint", m.start(), m.end(), True) for m in ENDPOINT.finditer(text)]
    taken.sort()
    starts = [s for s, _ in taken]
    reach = [0]
    for _, e in taken:
        reach.append(max(reach[-1], e))
    free = lambda s, e: reach[bisect.bisect_left(starts, e)] <= s  # noqa: E731  no base span or identifier overlaps
    return [p for p in out if not p[3] or p[0] == "identifier" and not any(s <= p[1] < e for s, _, e in base) or p[0] != "identifier" and free(p[1], p[2])]


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_PART = pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("weak", pa.bool_())])


def _scan(rows: DataFrame) -> DataFrame:
    """One row for each text: counts, digest, base spans and parts."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            spans, found, shas = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                found.append([dict(zip(("role", "start", "end", "weak"), p)) for p in parts(text, base)])
                shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column(ROW), pa.array(spans, pa.list_(_SPAN)), pa.array(found, pa.list_(_PART)), pa.array(shas, pa.string())],
                ["id", ROW, "base", "parts", "base_sha256"],
            )

    schema = f"id {kind}, {ROW} long, base array<struct<start:int,kind:int,end:int>>, parts array<struct<role:string,start:int,end:int,weak:boolean>>, base_sha256 string"
    return rows.mapInArrow(lean(run), schema)


def link(found: DataFrame, row: str = ROW) -> DataFrame:
    """(row, start, kind, end) of the weak parts whose complement is in reach: an interval join on (row, bucket).

    A weak part goes to the buckets that its widened interval touches, every part to those that it covers itself, whatever
    its length; pairs that meet in several buckets are one in the flags. Text length bounds how many buckets there are, so
    the rows grow with the text only.
    """
    p = found.select(F.col(row).alias(ROW), F.explode("parts").alias("p")).select(ROW, "p.*")
    wide = p.where("weak").withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start") - REACH) / REACH), F.floor((F.col("end") + REACH) / REACH))))
    near = p.select(F.col(ROW).alias("r"), F.col("role").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.floor(F.col("start") / REACH), F.floor(F.col("end") / REACH))).alias("b"))
    met = wide.join(near, (F.col(ROW) == F.col("r")) & (F.col("bucket") == F.col("b")) & (F.col("s") <= F.col("end") + REACH) & (F.col("e") >= F.col("start") - REACH) & (F.col("other") != F.col("role")))
    has = lambda role: F.max((F.col("other") == role).cast("int")) == 1
    flags = met.groupBy(ROW, "role", "start", "end").agg(has("identifier").alias("i"), has("secret").alias("x"), has("endpoint").alias("p"))
    kept = flags.where("(role = 'secret' and i) or (role = 'identifier' and x and p) or (role = 'endpoint' and i and x)")
    kinds = F.create_map(*[F.lit(v) for k in KINDS[3:] for v in (k, KINDS.index(k))])
    return kept.select(ROW, "start", kinds[F.col("role")].alias("kind"), "end")


def _spans(found: DataFrame, row: str = ROW) -> DataFrame:
    """found with all spans, sorted; `row` names each of its rows."""
    added = link(found, row).groupBy(F.col(ROW).alias("r")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    both = found.join(added, found[row] == added["r"], "left").drop("r")
    return both.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans as kind:start:end joined by commas, n_linked)."""
    rows = with_rows(docs, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"})
    out = _spans(staged(_scan(rows), "secrets"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    names = F.array(*map(F.lit, KINDS))
    say = F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return out.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256",
        F.array_join(say, ",").alias("spans"), F.size(F.coalesce("added", F.array())).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with every reported span replaced by [SECRET]; all rows and columns stay, the length column follows.

    Which spans a text has depends on the text alone, so a text's digest is the key: it is the same however often Spark
    computes a row. Only rows that may have spans (by a bit map of fixed size) are joined with them; the others pass
    straight through. Null texts stay null; columns may have any names.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc")).withColumn("text", F.col(f"doc.`{text_col}`").cast("string")).withColumn("digest", F.sha2("text", 256)).withColumn(ROW, F.xxhash64("digest"))
    found = _scan(rows.select(F.col("digest").alias("id"), ROW, "text"))
    marked = staged(found.where("size(base) > 0 or size(parts) > 1"), "secrets").dropDuplicates(["id"])
    spans = staged(_spans(marked, "id").where("size(spans) > 0").select(F.col("id").alias("digest"), F.xxhash64("id").alias("r"), "spans"), "spans")
    sure, perhaps = split_rows(rows, spans)
    joined = spread_join(perhaps, spans.drop("r"), "digest", F.monotonically_increasing_id(), "left").select("doc", "text", "spans")

    def cut(batches):
        for batch in batches:
            texts = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if found:
                    out, at = [], 0
                    for s in found:
                        if s["end"] > at:
                            out += [text[at : max(at, s["start"])], "[SECRET]" if s["start"] >= at else ""]
                            at = s["end"]
                    text = "".join(out) + text[at:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])

    clean = joined.mapInArrow(lean(cut), sure.select("doc", "text").schema)

    def own(c: str):
        if c == text_col:
            return F.col("text").cast(docs.schema[c].dataType).alias(c)
        return F.length("text").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(f"doc.`{c}`").alias(c)

    return sure.select("doc", "text").union(clean).select(*map(own, docs.columns))
