"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massloom.llm.common import word_lists
from massloom.llm.tokens import let_go, tidied

#: Labelled rows that a fit reads at most (those with the smallest hashes of their ids), and hashed features.
MOST_ROWS, BUCKETS = 10_000, 1 << 18
#: Bytes hashed at once.
BLOCK = 1 << 20


def features(text: str) -> np.ndarray:
    """Sorted distinct feature ids of a text: byte n-grams of length 1 to 3, neighbouring pairs of word lengths, and runs of 2 to 5 equal words.

    A-Z is lower-cased. The whole text counts, block by block.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    seen = []
    for at in range(0, len(raw), BLOCK):
        b = raw[at : at + BLOCK + 2].astype(np.uint32)
        grams = [b, (b[:-1] << np.uint32(8) | b[1:]) + np.uint32(1 << 24)]
        if len(b) > 2:
            grams.append((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) + np.uint32(1 << 25))
        seen.append(np.unique(np.concatenate(grams)))
    ends = np.flatnonzero(raw <= 32)
    sizes = np.minimum(np.diff(np.concatenate(([-1], ends, [len(raw)]))) - 1, 60).astype(np.uint32)
    if len(sizes) > 1:
        seen.append(np.unique(sizes[:-1] * np.uint32(64) + sizes[1:] + np.uint32(3 << 24)))
    again, last = bytearray(), []
    for words in word_lists(raw.tobytes()):
        words = last + words
        again += bytes(a == b for a, b in zip(words, words[1:], strict=False))
        last = words[-1:]
    seen.append(np.array([(3 << 25) + k for k in range(1, 5) if b"\1" * k in again], np.uint32))
    if not len(raw):
        return np.empty(0, np.int32)
    mixed = (np.concatenate(seen).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)
    return np.unique(mixed.astype(np.int32))


class Model:
    """Weights on L2-normalised, log-count-ratio scaled indicators, and the sigmoid of the margin."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, slope: float, shift: float):
        self.ratio2 = (ratio * ratio).astype(np.float64)
        self.product = (ratio * weight[:-1]).astype(np.float64)
        self.bias, self.slope, self.shift = float(weight[-1]), slope, shift

    def score(self, ids: np.ndarray) -> float:
        norm = np.sqrt(self.ratio2[ids].sum()) or 1.0
        margin = self.product[ids].sum() / norm + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def _sigmoid(margins: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the labels best, by Newton steps."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(rows: list[np.ndarray], good: np.ndarray, *, alpha: float = 1.0, cost: float = 4.0, epochs: int = 12, seed: int = 7) -> Model:
    """Fit on feature ids and labels: log-count ratios first, then a linear hinge-loss model by dual coordinate descent.

    ratio = log((p / |p|) / (q / |q|)), with p and q the alpha-smoothed indicator counts of the two classes. Each example
    is its indicators times the ratio, scaled to length 1, with a constant 1 for the bias. The dual of the L2-regularised
    hinge loss has one variable in [0, cost] for each example; each step solves one of them exactly. Classes are weighted
    by their inverse frequency.
    """
    p, q = np.full(BUCKETS, alpha), np.full(BUCKETS, alpha)
    for ids, g in zip(rows, good, strict=True):
        (p if g else q)[ids] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    values = [(ratio[ids] / (np.sqrt((ratio[ids] ** 2).sum()) or 1.0)).astype(np.float32) for ids in rows]
    y = np.where(good, 1.0, -1.0)
    upper = cost * np.where(good, len(good) / (2 * max(1, good.sum())), len(good) / (2 * max(1, (~good).sum())))
    square = np.array([(v * v).sum() + 1 for v in values])
    w, dual, order = np.zeros(BUCKETS + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            ids, v = rows[i], values[i]
            gradient = y[i] * (w[ids] @ v + w[-1]) - 1
            after = min(max(dual[i] - gradient / square[i], 0.0), upper[i])
            if after != dual[i]:
                step = (after - dual[i]) * y[i]
                w[ids] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                dual[i] = after
        if moved < 1e-3:
            break
    margins = np.array([w[ids] @ v + w[-1] for ids, v in zip(rows, values, strict=True)])
    slope, shift = _sigmoid(margins, good)
    return Model(ratio, w, slope, shift)


def training_ids(labels: DataFrame, *, id_col: str, label_col: str, most: int) -> DataFrame:
    """id and label of at most ``most`` labelled rows: one per id, those with the smallest hashes."""
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    return rows.orderBy(F.xxhash64("__id"), "__id").limit(most)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_ROWS) -> Model:
    """Fit on the texts of a bounded sample of the labelled rows given; without both classes the model says their share."""
    wanted = training_ids(labels, id_col=id_col, label_col=label_col, most=most)
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(wanted), "__id")
    sample = sample.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))  # of rows that repeat an id, one text whatever their order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py() or "").astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["id", "label", "ids"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("label", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    rows = sample.select("__id", "__text", "__label").mapInArrow(tidied(run), schema).drop("id").toArrow()  # bounded by ``most``
    good = np.array(rows.column("label").to_pylist(), np.int64) > 0
    ids = [np.frombuffer(v.as_buffer(), "<i4") for v in rows.column("ids")]  # views, no copies
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(ids[i]).digest(), good[i]))  # the same model however the rows arrive
    ids, good = [ids[i] for i in order], good[order] if len(good) else good.astype(bool)
    if good.all() or not good.any():
        share = float(good.mean()) if len(good) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS + 1), 1.0, float(np.log(share / (1 - share))))
    model = fit(ids, good)
    del rows, ids, good
    let_go()  # the driver goes on with the model alone
    return model


def scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` (0 to 1) of every row. Null texts count as empty and are scored too; repeated rows stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.score(features(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], [id_col, "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(tidied(run), schema)


def keep(docs: DataFrame, model: Model, least: float, *, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is ``least`` or more, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [held.value.score(features(t.as_py() or "")) >= least for t in batch.column(at)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no fit may learn from: crc32 of the id as text is divisible by 5. A null id is never learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))
