"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: byte trigrams, and one- to three-grams of word shapes
(runs of upper case, lower case, digits, letters beyond ASCII and the punctuation itself,
with a mark for a word equal to the one before).  They are hashed to DIM columns.  Each
indicator is scaled by the log ratio of its smoothed class frequencies and each row to unit
length; a linear hinge-loss model is fitted by dual coordinate descent; margins become
probabilities by a logistic fit on cross-validated margins.

Bounds: at most MAX_TRAIN labelled rows are used for fitting (those with the smallest hash
of the id, a documented sample; everything else is scored whole), and a row has at most DIM
features of two bytes, so what reaches the driver is bounded; the model is DIM numbers.

Edge cases: null and empty texts have no features and get the score of the bias; a label
that is null or whose document is missing is ignored; with several labels for an id the
smallest counts; an id with several texts is learned from the text of the smallest hash;
very long texts are scored and learned whole (a text has at most DIM features); n-grams whose
hashes are equal are one feature; columns other than id and text are ignored, whatever their
names; with labels of one class only every score is the share of label 1 (0.5
without labels); repeated rows are scored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromalake.llm import textkernel as tk
from chromalake.runtime import lean, ship_package, small_batches

DIM = 1 << 16
MAX_TRAIN = 8000
C, EPOCHS, FOLDS, ALPHA = 1.0, 12, 3, 1.0
#: A document is predicted good from this probability on.
CUT = 0.3

# character classes of word shapes; punctuation keeps its own byte
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 128


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct feature numbers of each text end to end as uint16, bounds)."""
    n = len(off) - 1
    low = buf.astype(np.uint32)
    tri = np.zeros(0, np.uint32)
    if len(buf) > 2:
        tri = (low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    w = tk.words(buf, off)
    # shape of a word: its classes with runs collapsed
    kind = _CLASS[buf]
    fresh = np.ones(len(buf), bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | tk.SPACE[buf[:-1]]
    fresh[off[:-1][off[:-1] < len(buf)]] = True
    pos = np.concatenate([[0], np.cumsum(fresh)])
    shape = tk.span_hash(kind[fresh], pos[w.start], pos[w.end], 11)
    own = tk.span_hash(buf, w.start, w.end)
    again = np.zeros(len(own), bool)
    if len(own) > 1:
        again[1:] = own[1:] == own[:-1]
        again[w.first[:-1][w.first[:-1] < len(own)]] = False
    shape = np.where(again, tk.mix(shape), shape)
    grams = [tk.windows(shape, w.first, k) for k in (1, 2, 3)]
    keys = [(g >> np.uint64(48)).astype(np.uint16) for g, _ in grams]
    cuts = [np.searchsorted(at, w.first) for _, at in grams]
    out, size = [], np.zeros(n, np.int64)
    for d in range(n):
        a, b = off[d], off[d + 1]
        x = np.concatenate([tri[a : max(a, b - 2)].astype(np.uint16), *[k[c[d] : c[d + 1]] for k, c in zip(keys, cuts, strict=True)]])
        x = np.sort(x)
        if len(x) > 1:
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        out.append(x)
        size[d] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint16)), np.concatenate([[0], np.cumsum(size)])


@dataclass
class Model:
    """Probability of label 1 is a logistic of slope * margin + shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        size = np.diff(bounds)
        total = np.concatenate([[0.0], np.cumsum(self.weights[x])])
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.sqrt(np.maximum(size, 1)) + self.bias

    def scores(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(x, bounds) + self.shift, -50, 50)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of smoothed feature frequencies in class 1 and in class 0."""
    p, q = np.full(DIM, ALPHA), np.full(DIM, ALPHA)
    for x, label in zip(rows, y, strict=True):
        (p if label else q)[x] += 1
    return np.log(p / (y.sum() + 2 * ALPHA)) - np.log(q / ((1 - y).sum() + 2 * ALPHA))


def hinge_dual(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; classes weigh equally."""
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([max((1 - y).mean(), 1e-9), max(y.mean(), 1e-9)])
    cap = C * 0.5 / share[y]
    norm = [1 / np.sqrt(max(len(x), 1)) for x in rows]
    values = [scale[x] * k for x, k in zip(rows, norm, strict=True)]
    diag = np.array([v @ v + 1 for v in values])
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            g = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - g / diag[i], 0.0), cap[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * scale, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with targets drawn in a little (Platt)."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * margin**2).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([((t - p) * margin).sum(), (t - p).sum()]))
        a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        p = min(max(p, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIM), 0.0, 1.0, float(np.log(p / (1 - p))))

    def once(at: np.ndarray) -> Model:
        part = [rows[i] for i in at]
        return Model(*hinge_dual(part, y[at], log_count_ratios(part, y[at])), 1.0, 0.0)

    every, margin = np.arange(len(y)), np.zeros(len(y))
    folds = min(FOLDS, int(min(y.sum(), (1 - y).sum())))
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % max(folds, 1)
    final = once(every)
    for k in range(folds if folds > 1 else 1):
        out = fold == k if folds > 1 else every >= 0
        model = once(every[~out]) if folds > 1 else final
        part = [rows[i] for i in every[out]]
        margin[out] = model.margins(np.concatenate(part), np.concatenate([[0], np.cumsum([len(x) for x in part])]))
    final.slope, final.shift = logistic(margin, y)
    return final


def is_held_out(doc_id) -> object:
    """crc32 of the id as text, mod 5, is 0; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0


@lean
def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, buf, off in tk.slices(batch.column(1)):
            x, bounds = features(buf, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), tk.binary_column(x, bounds)], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", doc_id: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> Model:
    """Fits on at most ``max_train`` labelled rows that are not held out."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    picked = (
        labels.select(F.col(doc_id).alias("_id"), F.col(target).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("_id").isNotNull() & ~is_held_out(F.col("_id")))
        .groupBy("_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    )
    # max_train ids at most: the broadcast is bounded
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("y", "text", "_id")
    # one text an id, that of the smallest hash, so that repeated ids cannot lengthen what is collected
    text_of = F.min(F.struct(F.xxhash64("text"), F.col("text"))).alias("t")
    one = rows.groupBy("_id", "y").agg(text_of).select("y", "t.text").mapInArrow(_feature_batches, "y int, x binary").toArrow()
    y = one["y"].to_numpy().astype(int)
    x = [np.frombuffer(v, np.uint16) for v in one["x"].to_pylist()]
    order = sorted(range(len(x)), key=lambda i: (len(x[i]), x[i].tobytes(), y[i]))  # the fit does not depend on task order
    return fit([x[i] for i in order], y[order] if len(order) else y)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tk.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.scores(*features(buf, off)))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """The documents that score ``cut`` or more, all columns."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in tk.slices(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(model.scores(*features(buf, off)) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op8_nb_support_vectors(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
