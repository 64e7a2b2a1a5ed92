"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of a text are standardised and mapped to cosines of random projections, which approximate a Gaussian
kernel. Each partition sums its share of the normal equations; the sums are of a fixed size. Ridge scores are calibrated
by isotonic regression over BINS score bins of rows that the ridge fit did not see.

Rows: null and empty texts have all-zero statistics and get a score like any other; repeated rows and ids stay; labels that
are null are not used, of repeated labels the largest counts; without labels every score is 0.5; extra columns are
dropped (kept by keep_good); an empty table gives an empty result. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import ROW, lean, list_of, slices, utf8, with_rows, words
from eventloom.session import staged

COSINES, WIDTH, RIDGE, BINS, SEED = 192, 4.0, 1.0, 2000, 1234
THRESHOLD = 0.7
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "!", "#$%&*@|<>{}[]^~_=+\\/`", " \t", "\n\r"), 1):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:] = 9
STATISTICS = 9 + 10


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of document statistics for each text of a batch."""
    out = np.zeros((len(offsets) - 1, STATISTICS))
    for start, end in slices(offsets):
        out[start:end] = _statistics(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
    return out


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    safe = np.maximum(size, 1)
    out = np.zeros((n, STATISTICS))
    kinds = _CLASS[data]

    def per_text(mask):
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[offsets])

    counts = [per_text(kinds == k) for k in range(1, 10)]
    for k, c in enumerate(counts):
        out[:, k] = c / safe
    hashes, n_words = words(data, offsets)
    many = np.maximum(n_words, 1)
    doc = np.repeat(np.arange(n, dtype=np.uint64), n_words)

    def distinct(values):
        key = np.sort((doc << np.uint64(40)) | (values >> np.uint64(24)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        of = (key[at] >> np.uint64(40)).astype(np.int64)
        runs = np.diff(np.append(at, len(key)))
        top = np.zeros(n)
        np.maximum.at(top, of, runs)
        return np.bincount(of, minlength=n), top

    if len(hashes):
        kinds_of_word, top = distinct(hashes)
        pairs = hashes.copy()
        pairs[1:] ^= hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)
        out[:, 9] = kinds_of_word / many
        out[:, 10] = top / many
        out[:, 11] = distinct(pairs)[0] / many
    letters = counts[0] + counts[1] + counts[8]
    out[:, 12] = counts[1] / np.maximum(letters, 1)
    out[:, 13] = np.log1p(size)
    out[:, 14] = np.log1p(n_words)
    out[:, 15] = np.log1p((size - counts[6] - counts[7]) / many)
    out[:, 16] = np.log1p(n_words / (counts[7] + 1))
    out[:, 17] = np.sqrt(counts[5] / many)
    out[:, 18] = np.sqrt(counts[4] / many)
    return out


def _projection() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return random.normal(0, 1 / WIDTH, (STATISTICS, COSINES)), random.uniform(0, 2 * np.pi, COSINES)


def kernel_features(x: np.ndarray) -> np.ndarray:
    """Random Fourier features, with the statistics themselves and a constant."""
    w, b = _projection()
    return np.hstack([np.cos(x @ w + b) * np.sqrt(2 / COSINES), x / 10, np.ones((len(x), 1))])


def pool_adjacent(count: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Isotonic regression: the non-decreasing fit of positive / count, weighted by count."""
    blocks: list[list[float]] = []
    for c, p in zip(count, positive):
        blocks.append([c, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(k), p / c) for c, p, k in blocks]) if blocks else np.empty(0)


class Model:
    """Standardisation, ridge weights and calibration."""

    def __init__(self, mean, scale, weights, at, value):
        self.mean, self.scale, self.weights, self.at, self.value = mean, scale, weights, at, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        return kernel_features(np.clip((x - self.mean) / self.scale, -8, 8)) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, mod 4."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % 4


def _measure(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = statistics(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), list_of(x.ravel(), np.full(len(x), STATISTICS), pa.float64())], ["id", "x"])

    return rows.mapInArrow(lean(run), f"id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, STATISTICS)


def fit(measured: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """Fit on the labelled rows of measured (id, x) whose fold isn't 2: folds 0 and 1 for ridge, 3 for calibration."""
    truth = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(f"`{label_col}`").cast("double").alias("y"))
    known = staged(measured.where(fold("id") != 2).join(truth, "id").select("x", "y", fold("id").cast("int").alias("fold")), "labelled")
    moments = known.select(
        F.count("*").alias("n"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(STATISTICS)],
        *[F.coalesce(F.stddev_pop(F.col("x")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(STATISTICS)],
    ).first()
    if not moments["n"]:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(COSINES + STATISTICS + 1), np.empty(0), np.empty(0))
    mean = np.array([moments[f"m{i}"] for i in range(STATISTICS)])
    scale = np.maximum(np.array([moments[f"s{i}"] for i in range(STATISTICS)]), 1e-6)
    model = Model(mean, scale, None, np.empty(0), np.empty(0))
    size = COSINES + STATISTICS + 1

    def normal_equations(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = kernel_features(np.clip((_matrix(batch.column("x")) - mean) / scale, -8, 8))
            total += z.T @ np.column_stack([z, batch.column("y").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def add(batches):
        total = np.zeros(size * (size + 1))
        for batch in batches:
            for part in batch.column("part"):
                total += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    # sums of sums, 64 at a time, each level staged: no task adds up more than that however many partitions there are
    sums = staged(known.where("fold <> 3").mapInArrow(lean(normal_equations), "part binary"), "equations")
    n = sums.count()
    while n > 64:
        n = -(-n // 64)
        sums = staged(sums.repartition(n).mapInArrow(lean(add), "part binary"), "equations")
    total = sum((np.frombuffer(r["part"]) for r in sums.toLocalIterator()), np.zeros(size * (size + 1))).reshape(size, size + 1)
    model.weights = np.linalg.solve(total[:, :size] + RIDGE * np.eye(size), total[:, size])

    def binned(batches):
        for batch in batches:
            at = np.clip(((model.raw(_matrix(batch.column("x"))) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("y")], ["bin", "y"])

    held = known.where("fold = 3")
    bins = held.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").collect()
    if not bins:
        bins = known.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").collect()
    model.at = (np.array([r["bin"] for r in bins]) + 0.5) / BINS * 2 - 0.5
    model.value = pool_adjacent(np.array([r["n"] for r in bins], float), np.array([r["p"] for r in bins], float))
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row."""
    rows = with_rows(docs, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"}).drop(ROW)
    measured = staged(_measure(rows), "statistics")
    model = fit(measured, labels, id_col=id_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(_matrix(batch.column("x"))), pa.float64())], ["id", "score"])

    out = measured.mapInArrow(lean(run), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(fold("id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject."""
    rows = with_rows(docs, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"}).drop(ROW)
    model = fit(_measure(rows), labels, id_col=id_col)

    def run(batches):
        for batch in batches:
            keep = model.score(statistics(*utf8(batch.column(text_col)))) >= THRESHOLD
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
