"""Quality of documents: naive Bayes support vectors.

Every document is a set of hashed n-grams (indicators, not counts), of two kinds:
byte n-grams, and n-grams over word shapes (case, digits, trailing signs, and
how many words back the same word stood). An indicator is scaled by the
log-ratio of its smoothed frequencies in the two classes, and a linear model
with hinge loss is fitted on the scaled vectors by dual coordinate descent.
A logistic curve fitted on held-back margins turns margins into scores.

Defined cases: null and empty texts have no n-gram and get the score of the
intercept; repeated rows and ids are scored one by one, but learned from once; a label other than 0 and
1, and a null label or id, is not learned from; without examples of both classes
every score is the share of the class there is (0.5 without any). Only the named
columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import buffers

BITS = 18
BYTE_ORDERS = (1, 2, 3, 4)
SHAPE_ORDERS = (1, 2, 3)
#: At most so many labelled rows are learned from: those with the smallest hash of their id.
SAMPLE_ROWS = 6000
THRESHOLD = 0.3
_SIZE = 1 << BITS


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


# --- features -------------------------------------------------------------------------------------------------------

_CASE = np.zeros(256, np.uint8)
_CASE[65:91] = 1
_CASE[48:58] = 2
_CASE[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 3


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A small number for the shape of each word, and its row."""
    start, end, row = buffers.words(data, offsets)
    if not len(start):
        return start, row
    names = buffers.span_hash(buffers.prefix_hash(data), start, end)
    back = np.zeros(len(start), np.int64)
    for distance in (4, 3, 2, 1):
        same = np.zeros(len(start), bool)
        same[distance:] = (names[distance:] == names[:-distance]) & (row[distance:] == row[:-distance])
        back[same] = distance
    first, last = _CASE[data[start]], _CASE[data[end - 1]]
    second = _CASE[data[np.minimum(start + 1, end - 1)]]
    size = np.minimum(end - start, 15) >> 2
    return (((back * 4 + first) * 4 + last) * 4 + second) * 4 + size, row


def _grams(values: np.ndarray, row: np.ndarray, orders: tuple[int, ...], salt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and row of every n-gram of a sequence, order by order."""
    running = np.zeros(len(values), np.uint32)
    for order in range(1, max(orders) + 1):
        n = len(values) - order + 1
        if n <= 0:
            return
        running = running[:n] * np.uint32(0x01000193) + values[order - 1 :].astype(np.uint32) + np.uint32(1)
        if order in orders:
            inside = row[:n] == row[order - 1 :]
            mixed = (running ^ np.uint32(salt * 16 + order)) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield (mixed >> np.uint32(32 - BITS))[inside].astype(np.int64), row[:n][inside]


class Indicators:
    """Distinct (row, bucket) pairs of chunks of rows, without sorting."""

    def __init__(self) -> None:
        self._slot = np.zeros(0, np.int32)

    def _first(self, key: np.ndarray, size: int) -> np.ndarray:
        if len(self._slot) < size:
            self._slot = np.zeros(size, np.int32)
        at = np.arange(len(key), dtype=np.int32)
        self._slot[key] = at  # the last one written stands for all equal keys
        return self._slot[key] == at

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (row, bucket) pairs of all n-grams of the given rows; a bucket that two orders share counts once."""
        rows = len(offsets) - 1
        byte_row = np.repeat(np.arange(rows), np.diff(offsets))
        shape, shape_row = _shapes(data, offsets)
        keys = [of * _SIZE + bucket
                for values, row, orders, salt in ((data, byte_row, BYTE_ORDERS, 1), (shape, shape_row, SHAPE_ORDERS, 2))
                for bucket, of in _grams(values, row, orders, salt)]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        key = key[self._first(key, rows * _SIZE)]
        return key >> BITS, key & (_SIZE - 1)


#: Rows and bytes of one chunk: the slots take 4 * 2**BITS bytes a row.
_ROWS, _BYTES = 16, 1 << 18


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for first, last in buffers.row_chunks(offsets, _BYTES):
        for at in range(first, last, _ROWS):
            yield at, min(at + _ROWS, last)


# --- the model ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, already times the log-count ratio
    bias: float
    slope: float
    offset: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))


def log_count_ratio(examples: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """log of the smoothed share of each indicator among the positives over that among the negatives."""
    counts = np.ones((2, _SIZE))
    for x, y in zip(examples, label, strict=True):
        counts[int(y > 0), x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def fit_dual(
    examples: list[np.ndarray], label: np.ndarray, scale: np.ndarray, cost: float = 1.0, passes: int = 12
) -> tuple[np.ndarray, float]:
    """Hinge loss with a squared norm, by dual coordinate descent; rows have length 1, plus a constant feature."""
    weight, bias, alpha = np.zeros(_SIZE), 0.0, np.zeros(len(examples))
    # the scaled values are looked up again in every pass, or else they would take more memory than the sets
    lengths = [max(np.sqrt(scale[x] @ scale[x]), 1e-12) for x in examples]
    share = np.clip(np.array([(label < 0).mean(), (label > 0).mean()]), 1e-9, None)
    upper = {-1.0: cost * 0.5 / share[0], 1.0: cost * 0.5 / share[1]}  # the rarer class weighs more
    order = np.arange(len(examples))
    rng = np.random.default_rng(7)
    for _ in range(passes):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            x, y = examples[i], label[i]
            if not len(x):
                continue
            v = scale[x] / lengths[i]
            slope = y * (weight[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), upper[y])
            step = (new - alpha[i]) * y
            if step:
                alpha[i] = new
                weight[x] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight, bias


def margins(examples: list[np.ndarray], scale: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(examples), bias)
    for i, x in enumerate(examples):
        if len(x):
            v = scale[x]
            out[i] += weight[x] @ v / max(np.sqrt(v @ v), 1e-12)
    return out


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    target = np.where(label > 0, (np.sum(label > 0) + 1) / (np.sum(label > 0) + 2), 1 / (np.sum(label < 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([(p - target) @ margin + 1e-3 * a, np.sum(p - target)])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[w @ margin**2 + 1e-3, w @ margin], [w @ margin, w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        step *= min(1.0, 5.0 / max(size, 1e-12))
        a, b = a - step[0], b - step[1]
        if size < 1e-8:
            break
    return max(a, 1e-3), b


def fit(examples: list[np.ndarray], label: np.ndarray) -> Model:
    """Fit on sets of buckets with labels -1 and 1; every fifth row is held back for the curve."""
    if not len(label) or len(set(label)) < 2:
        share = min(max(float(np.mean(label > 0)) if len(label) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(_SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    every = np.arange(len(label))
    a, b = every % 5 != 0, every % 5 == 0
    slope, offset = 4.0, 0.0
    if len(set(label[a])) == 2 and b.any():
        part = [examples[i] for i in every[a]]
        scale = log_count_ratio(part, label[a])
        weight, bias = fit_dual(part, label[a], scale)
        slope, offset = logistic(margins([examples[i] for i in every[b]], scale, weight, bias), label[b])
    scale = log_count_ratio(examples, label)
    weight, bias = fit_dual(examples, label, scale)
    model = Model(weight * scale, bias, slope, offset)
    model.scale = scale  # type: ignore[attr-defined]
    return model


# --- on Spark -------------------------------------------------------------------------------------------------------


def _indicator_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buffers.forget()
    indicators = Indicators()
    for batch in batches:
        data, offsets = buffers.utf8(batch.column("text"))
        out: list[np.ndarray] = []
        for i in range(batch.num_rows):
            o = offsets[i : i + 2]
            out.append(np.sort(indicators.of(data[o[0] : o[1]], o)[1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("order"), batch.column("y"), pa.array(out, pa.list_(pa.int32()))], ["order", "y", "x"]
        )


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled rows that are not held out, at most ``rows`` of them.

    The sample is chosen by a hash of the id before any text is read, and only
    its bucket sets reach the driver: at most rows * 2**BITS integers.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))  # the higher of contradicting labels
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(rows)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("order", "y", "text")
    rows_ = texts.mapInArrow(_indicator_rows, "order long, y int, x array<int>")
    # one row for each id, however often it occurs
    found = rows_.groupBy("order").agg(F.min(F.struct("y", "x")).alias("r")).select("order", "r.*").toArrow()
    order = np.argsort(found["order"].to_numpy(), kind="stable")
    label = np.where(found["y"].to_numpy() > 0, 1.0, -1.0)
    sets = [np.asarray(x.values) for x in found["x"]]  # views of the received table
    model = fit([sets[i] for i in order], label[order])
    del found, sets
    pa.default_memory_pool().release_unused()
    return model


class Scorer:
    """Scores of a batch; made once a task."""

    def __init__(self, model: Model) -> None:
        self.model, self.indicators = model, Indicators()
        self.scale = getattr(model, "scale", np.zeros(_SIZE))
        # product of the two, and the squared length, looked up together
        self.table = np.stack([model.weight, self.scale**2], axis=1)

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, offsets = buffers.utf8(column)
        margin = np.zeros(len(offsets) - 1)
        for first, last in _chunks(offsets):
            o = offsets[first : last + 1]
            row, bucket = self.indicators.of(data[o[0] : o[-1]], o)
            both = self.table[bucket]
            total, length = (np.bincount(row, both[:, c], last - first) for c in (0, 1))
            margin[first:last] = total / np.sqrt(np.maximum(length, 1e-24))
        return self.model.score(margin + self.model.bias)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers.forget()
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scorer(batch.column("text")))], ["doc_id", "score"]
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double"
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers.forget()
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column("text")) >= threshold))

    return documents.mapInArrow(run, documents.schema)
