"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (of the lower-cased code points, orders 1 to 4) are hashed to
2**BITS buckets; a row is log(1 + count) * idf, scaled to length 1. The weights
are fitted with follow-the-regularised-leader steps and elastic-net penalties,
which leaves most of them zero; a temperature fitted on held-back rows turns
the outputs into probabilities. Document frequencies are counted over all
documents that may be learned from; the weights are fitted on a bounded sample.

Defined cases: a null text or one without a letter gives ``und`` with score 0;
rows with a null lang or id are not learned from, and of rows that repeat an id the weights see one; with a single language it is
predicted with score 1; without any, every row is ``und``; repeated rows are predicted one by one;
an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import buffers

BITS = 16
ORDERS = (1, 2, 3, 4)
#: At most so many labelled rows are fitted on: those with the smallest hash of their id.
SAMPLE_ROWS = 4000
_SIZE = 1 << BITS


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def code_points(data: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def gram_buckets(points: np.ndarray) -> np.ndarray:
    """The bucket of every n-gram of one text."""
    out, running = [], np.zeros(len(points), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        n = len(points) - order + 1
        if n <= 0:
            break
        running = running[:n] * np.uint32(0x01000193) + points[order - 1 :] + np.uint32(1)
        mixed = (running ^ np.uint32(order)) * np.uint32(0x85EBCA6B)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x9E3779B1)
        out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how often each occurs."""
    all_ = np.bincount(gram_buckets(code_points(data)), minlength=_SIZE)
    at = np.flatnonzero(all_)
    return at, all_[at]


def _lower(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return buffers.utf8(pc.utf8_lower(batch.column("text").cast(pa.string())))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weight: np.ndarray  # languages x buckets
    bias: np.ndarray
    temperature: float

    def vector(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts(data)
        x = np.log1p(n) * self.idf[at]
        return at, x / max(np.sqrt(x @ x), 1e-12)

    def outputs(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weight[:, at] @ x + self.bias

    def probabilities(self, out: np.ndarray) -> np.ndarray:
        z = out / self.temperature
        p = np.exp(z - z.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, coordinate by coordinate, with elastic-net penalties."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> None:
        # the last column is the constant, without penalty
        self.z, self.n = np.zeros((classes, _SIZE + 1)), np.zeros((classes, _SIZE + 1))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        free = np.arange(_SIZE + 1)[at] == _SIZE
        l1, l2 = np.where(free, 0.0, self.l1), np.where(free, 1e-6, self.l2)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, _SIZE), np.append(x, 1.0)
        w = self.weights(at)
        out = w @ x
        p = np.exp(out - out.max())
        p /= p.sum()
        p[label] -= 1.0
        g = p[:, None] * x
        n = self.n[:, at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[:, at] += g - sigma * w
        self.n[:, at] = n + g * g


def fit_temperature(outputs: np.ndarray, label: np.ndarray) -> float:
    """The temperature of the smallest log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        z = outputs / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(label)), label]))

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(examples: list[tuple[np.ndarray, np.ndarray]], names: list[str], idf: np.ndarray, passes: int = 3) -> Model:
    """Fit on (buckets, counts) rows; every sixth is held back for the temperature.

    Rows are weighed whenever they are used: weighted copies of all of them would take several times the memory.
    """
    languages = sorted(set(names))
    model = Model(languages, idf, np.zeros((len(languages), _SIZE)), np.zeros(len(languages)), 1.0)
    if len(languages) < 2:
        return model
    label = np.array([languages.index(n) for n in names])

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = examples[i]
        x = np.log1p(n) * idf[at]
        return at, x / max(np.sqrt(x @ x), 1e-12)

    back = np.arange(len(examples)) % 6 == 5
    leader, order, rng = Ftrl(len(languages)), np.flatnonzero(~back), np.random.default_rng(3)
    for _ in range(passes):
        rng.shuffle(order)
        for i in order:
            leader.step(*row(i), label[i])
    w = leader.weights(slice(None))
    model.weight, model.bias = np.ascontiguousarray(w[:, :_SIZE]), w[:, _SIZE]
    if back.any():
        model.temperature = fit_temperature(np.array([model.outputs(*row(i)) for i in np.flatnonzero(back)]), label[back])
    return model


def _frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(_SIZE, np.int64), 0
    for batch in batches:
        data, offsets = _lower(batch)
        for i in range(batch.num_rows):
            total[counts(data[offsets[i] : offsets[i + 1]])[0]] += 1
        rows += batch.num_rows
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, _SIZE)), pa.array(np.append(total[at], rows))], ["bucket", "n"])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _lower(batch)
        pairs = [counts(data[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("order"), batch.column("lang"), pa.array([a.astype(np.int32) for a, _ in pairs], pa.list_(pa.int32())),
             pa.array([n.astype(np.int32) for _, n in pairs], pa.list_(pa.int32()))], ["order", "lang", "at", "n"])


def train(documents: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    table = known.select(F.col("text").cast("string")).mapInArrow(_frequency_rows, "bucket long, n long")
    # at most 2**BITS + 1 rows
    found = table.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(_SIZE + 1)
    seen[found["bucket"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + seen[_SIZE]) / (1 + seen[:_SIZE])) + 1.0
    order = F.xxhash64("doc_id").alias("order")
    # the bound on the hash is found without reading texts
    chosen = known.select(order).orderBy("order").limit(rows).agg(F.max("order")).first()[0]
    sample = known.select(order, F.col("lang").cast("string"), F.col("text").cast("string")).where(F.col("order") <= F.lit(chosen))
    got = sample.mapInArrow(_count_rows, "order long, lang string, at array<int>, n array<int>")
    # one row for each id, however often it occurs: rows * 2**BITS numbers at most
    got = got.groupBy("order").agg(F.min(F.struct("lang", "at", "n")).alias("r")).select("order", "r.*").toArrow()
    place = np.argsort(got["order"].to_numpy(), kind="stable")
    names, buckets, numbers = got["lang"].to_pylist(), got["at"], got["n"]
    # views of the received table
    return fit([(np.asarray(buckets[i].values), np.asarray(numbers[i].values)) for i in place.tolist()], [names[i] for i in place], idf)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = _lower(batch)
            letters = batch.column("letters").to_pylist()
            names, scores = [], []
            for i in range(batch.num_rows):
                if not letters[i] or not model.languages:
                    names.append("und")
                    scores.append(0.0)
                    continue
                p = model.probabilities(model.outputs(*model.vector(data[offsets[i] : offsets[i + 1]])))
                names.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    ).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(documents, train(documents)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
