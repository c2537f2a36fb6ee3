"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens (runs of ASCII letters, digits and bytes above ASCII, lower-cased) are
hashed to 2**BITS buckets. The score of a bucket is the log-odds of the toxic
against the other labelled texts (a text counts a token once) under a Dirichlet
prior in proportion to its frequency in all documents, moved CAUTION standard errors towards zero and less a
drift, so that ordinary tokens count against a passage. One linear scan of
the running sum finds every maximal segment of positive score (each is the best
one around it and no two overlap).

Scores of segments become evidence by extreme-value statistics: in n ordinary
tokens the best score exceeds s with probability 1 - exp(-K n exp(-rate s)). The rate
solves the usual equation for the token scores of ordinary texts; K is its maximum
likelihood estimate on best scores of ordinary texts, each scored by a model that
has not seen it. A segment whose expected number is at most SIGNIFICANT is a
toxic passage. The passages of a text are taken together by the sum of their
normalized scores, and a logistic curve turns this evidence into a probability.

Defined cases: null and empty texts have no token and get the score of no
evidence; repeated rows and ids are scored one by one; labels other than 0 and 1,
null labels and null ids are not learned from, and of contradicting labels the
higher counts; without examples of both classes every score is the smoothed share
of the class there is (0.5 without any) and no passage is found; an empty
table gives no rows. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import buffers
from cohortlab.scratch import materialize

BITS = 20
#: At most so many labelled documents are learned from: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
CAUTION = 1.0
DRIFT = 0.1
SIGNIFICANT = 0.05
THRESHOLD = 0.3
_SIZE = 1 << BITS
#: Scores are whole multiples of 1 / _UNIT, so that sums have no rounding.
_UNIT = 1024
#: Evidence outside of these limits counts as the limit.
_EVIDENCE = -20, 60


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


# --- tokens and segments ----------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MEMBER = np.zeros(256, bool)
_MEMBER[48:58] = _MEMBER[97:123] = _MEMBER[128:] = True


def token_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, row, start and end of every token."""
    data = _LOWER[data]
    start, end, row = buffers.runs(_MEMBER[data], offsets)
    names = buffers.span_hash(buffers.prefix_hash(data), start, end)
    return (names >> np.uint64(64 - BITS)).astype(np.int64), row, start, end


def best_sums(score: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The largest sum of a run of consecutive scores of each row (0 for the empty run)."""
    # a zero before each row's scores stands for its empty prefix
    count = np.bincount(row, minlength=rows)
    head = np.concatenate(([0], np.cumsum(count)[:-1])) + np.arange(rows)
    padded = np.zeros(len(score) + rows, np.int64)
    padded[np.arange(len(score)) + row + 1] = score
    total = np.cumsum(padded)
    # rows sink below each other, so that a running minimum starts anew with each row
    sink = np.repeat(np.arange(rows), count + 1) * (int(np.abs(score).sum()) + 1)
    total -= sink
    return np.maximum.reduceat(total - np.minimum.accumulate(total), head) if rows else np.zeros(0, np.int64)


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, int]]:
    """(score, first, last + 1) of every maximal segment, from left to right, in linear time.

    Runs of scores of one sign are taken together first. Every candidate keeps a
    link to the nearest earlier one that begins at a lower running sum; those in between are never looked at again.
    """
    sign = score > 0
    border = np.flatnonzero(np.diff(sign)) + 1
    first = np.concatenate(([0], border)) if len(score) else border
    sums = np.add.reduceat(score, first).tolist() if len(score) else []
    ends = [*border.tolist(), len(score)]
    low: list[int] = []  # the running sum before each candidate
    high: list[int] = []
    span: list[tuple[int, int]] = []
    link: list[int] = []
    total = 0
    for begin, end, value in zip(first.tolist(), ends, sums):
        before, total = total, total + value
        if value <= 0:
            continue
        at = len(low) - 1
        while True:
            while at >= 0 and low[at] >= before:
                at = link[at]
            if at < 0 or high[at] >= total:
                break
            # the earlier candidate and all after it become part of this one
            before, begin = low[at], span[at][0]
            previous = link[at]
            del low[at:], high[at:], span[at:], link[at:]
            at = previous
        low.append(before)
        high.append(total)
        span.append((begin, end))
        link.append(at)
    return [(h - l, *s) for l, h, s in zip(low, high, span)]


# --- the model --------------------------------------------------------------------------------------------------------


@dataclass
class Segments:
    """Token scores in units, and the constants of their extreme values."""

    score: np.ndarray
    rate: float
    constant: float = 1.0

    def size(self, tokens: np.ndarray | int) -> np.ndarray:
        """Log of the constant times the number of tokens."""
        return np.log(self.constant * np.maximum(tokens, 1))

    def evidence(self, best: int, tokens: int, segments: list[int]) -> float:
        """The least log probability, negated, of the best score or of the highest segments taken together."""
        size = float(self.size(tokens))
        most, total = self.rate * best / _UNIT - size, 0.0
        for r, score in enumerate(sorted(segments, reverse=True), 1):
            total += self.rate * score / _UNIT - size
            if r > 1 and total > 1:
                most = max(most, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return most


def log_odds(toxic: np.ndarray, other: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Bucket scores: log-odds under the Dirichlet prior, less CAUTION standard errors."""
    strength = max(toxic.sum(), 1.0)
    # half a token is added everywhere, for buckets that no document has
    prior = (background + 0.5) * (strength / (background.sum() + 0.5 * len(background)))
    a, b = toxic + prior, other + prior
    difference = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    return np.sign(difference) * np.maximum(np.abs(difference) - CAUTION * np.sqrt(1 / a + 1 / b), 0.0)


def growth_rate(score: np.ndarray, share: np.ndarray) -> float:
    """The positive solution of sum(share * exp(rate * score)) = 1, for scores with a negative mean."""
    low, high = 0.0, 1e-3
    # large exponents would overflow; sums above 2 are far beyond the solution
    value = lambda rate: float(share @ np.exp(np.minimum(rate * score, 50.0)))
    while value(high) < 1 and high < 20:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return min(high, 20.0)


def segments_model(toxic: np.ndarray, other: np.ndarray, background: np.ndarray) -> Segments:
    score = log_odds(toxic, other, background)
    share = other + (background + 0.5) / (background.sum() + 0.5 * len(background))
    share = share / share.sum()
    drift = DRIFT + max(float(share @ score), 0.0)
    units = np.round((score - drift) * _UNIT).astype(np.int32)
    return Segments(units, growth_rate(units / _UNIT, share))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (at least 0) and offset of P(y = 1), by Newton steps that are halved until the loss falls."""
    rows = np.stack([x, np.ones(len(x))], axis=1)
    loss = lambda w: float(np.logaddexp(0, rows @ w).sum() - y @ rows @ w + ridge * w[0] ** 2 / 2)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -50, 50)))
        gradient = rows.T @ (p - y) + [ridge * w[0], 0]
        step = np.linalg.solve((rows.T * np.maximum(p * (1 - p), 1e-9)) @ rows + np.diag([ridge, 1e-9]), gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


@dataclass
class Model:
    segments: Segments | None  # none: every score is ``base``
    slope: float = 1.0
    offset: float = 0.0
    base: float = 0.5

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -50, 50)))


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffers.utf8(column)
    for first, last in buffers.row_chunks(offsets):
        o = offsets[first : last + 1]
        yield first, last, data[o[0] : o[-1]], o - o[0]


def scan(column: pa.Array, model: Segments, passages: bool = True) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """For every text: best score, tokens, and the significant segments as (score, start, end) in bytes."""
    for first, last, data, offsets in _chunks(column):
        bucket, row, start, end = token_buckets(data, offsets)
        score = model.score[bucket]
        n = np.bincount(row, minlength=last - first)
        best = best_sums(score, row, last - first)
        needed = np.ceil((model.size(n) - math.log(SIGNIFICANT)) / model.rate * _UNIT)
        begin = np.concatenate(([0], np.cumsum(n)))
        for i in range(last - first):
            found: list[tuple[int, int, int]] = []
            if passages and best[i] >= needed[i] and best[i] > 0:
                a, b = begin[i], begin[i + 1]
                found = [(s, int(start[a + x] - offsets[i]), int(end[a + y - 1] - offsets[i]))
                         for s, x, y in maximal_segments(score[a:b]) if s >= needed[i]]
            yield int(best[i]), int(n[i]), i + first, found


# --- on Spark ---------------------------------------------------------------------------------------------------------


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by class and bucket of a token; one row for each that occurs in the task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        part = batch.column("part").to_numpy()
        for first, last, data, offsets in _chunks(batch.column("text")):
            bucket, row, _, _ = token_buckets(data, offsets)
            # a text counts a token once, however often it repeats it
            once = np.unique(row * _SIZE + bucket)
            of, bucket = part[first:last][once >> BITS], once & (_SIZE - 1)
            for p in np.unique(of).tolist():
                total[p] = total.get(p, 0) + np.bincount(bucket[of == p], minlength=_SIZE)
    for p, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), p, np.int32)), pa.array(at), pa.array(counts[at])], ["part", "bucket", "n"])


def token_counts(texts: DataFrame) -> dict[int, np.ndarray]:
    """For every value of ``part`` how many texts hold a token of each bucket."""
    rows = texts.select(F.col("part").cast("int"), F.col("text").cast("string")).mapInArrow(
        _count_rows, "part int, bucket long, n long")
    found = rows.groupBy("part", "bucket").agg(F.sum("n").alias("n")).toArrow()  # parts * 2**BITS rows at most
    part, bucket, n = (found[c].to_numpy() for c in ("part", "bucket", "n"))
    out = {}
    for p in np.unique(part).tolist():
        out[p] = np.zeros(_SIZE)
        out[p][bucket[part == p]] = n[part == p]
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """order, y and text of the documents that are learned from."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("order", F.xxhash64("doc_id"))
    total = known.count()
    if total > 2 * rows:
        # about twice as many as needed: only these are sorted
        known = known.where(F.col("order") <= int(-(1 << 63) + (1 << 64) * (2 * rows / total)))
    known = known.orderBy("order", "doc_id").limit(rows)
    return materialize(documents.select("doc_id", F.col("text").cast("string")).join(F.broadcast(known), "doc_id").select(
        "order", "y", "text"), "labelled")


def _best_rows(models: list[Segments]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("part").to_numpy()
            evidence, best, tokens = np.zeros(len(fold)), np.zeros(len(fold), np.int64), np.zeros(len(fold), np.int64)
            for f, model in enumerate(models):
                at = np.flatnonzero(fold == f)
                for s, n, i, found in scan(batch.column("text").take(pa.array(at)), model):
                    best[at[i]], tokens[at[i]] = s, n
                    evidence[at[i]] = model.evidence(s, n, [x[0] for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("y"), pa.array(best), pa.array(tokens), pa.array(evidence)],
                ["order", "y", "best", "tokens", "evidence"])

    return run


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled documents that are not held out, at most ``rows`` of them; the prior counts all documents."""
    sample = labelled_sample(documents, labels, label, rows)
    fold = F.col("order").bitwiseAND(F.lit(1)).cast("int")
    by = token_counts(sample.select((fold * 2 + F.col("y")).alias("part"), "text"))
    sizes = dict(sample.groupBy("y").agg(F.countDistinct("order")).collect())
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Model(None, base=share)
    background = token_counts(documents.select(F.lit(0).alias("part"), "text")).get(0, np.zeros(_SIZE))
    of = lambda f, y: by.get(2 * f + y, np.zeros(_SIZE))
    whole = segments_model(of(0, 1) + of(1, 1), of(0, 0) + of(1, 0), background)
    # each fold is scored by what the other one teaches
    models = [segments_model(of(1 - f, 1), of(1 - f, 0), background) for f in (0, 1)]
    folded = sample.select("order", "y", fold.alias("part"), "text")
    schema = "order long, y int, best long, tokens long, evidence double"
    spark = documents.sparkSession

    def constants(models: list[Segments]) -> dict[int, float]:
        found = folded.where("y = 0").mapInArrow(_best_rows(models), schema)
        rate = F.when(F.col("order").bitwiseAND(F.lit(1)) == 0, models[0].rate).otherwise(models[1].rate)
        found = found.groupBy(F.col("order").bitwiseAND(F.lit(1)).alias("fold")).agg(
            (F.count("*") / F.sum(F.greatest("tokens", F.lit(1)) * F.exp(-rate * F.col("best") / _UNIT))).alias("k"))
        return {r["fold"]: r["k"] for r in found.collect()}

    k = constants(models)
    for f, model in enumerate(models):
        model.constant = k.get(f, 1.0)
    whole.constant = float(np.mean(list(k.values()))) if k else 1.0
    # one row for each id, however often it occurs
    rows_ = folded.mapInArrow(_best_rows(models), schema).groupBy("order").agg(F.max("y").alias("y"), F.max("evidence").alias("e"))
    found = rows_.toArrow()
    order = np.argsort(found["order"].to_numpy())
    evidence = np.clip(found["e"].to_numpy()[order], *_EVIDENCE)
    slope, offset = logistic(evidence, found["y"].to_numpy()[order].astype(np.float64))
    return Model(whole, slope, offset)


def find_passages(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the toxic ``passages`` (start and end in code points, evidence) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, spans = np.full(batch.num_rows, model.base), [[] for _ in range(batch.num_rows)]
            if model.segments is not None:
                column = batch.column("text")
                data, offsets = buffers.utf8(column)
                evidence = np.zeros(batch.num_rows)
                for best, n, i, found in scan(column, model.segments):
                    evidence[i] = model.segments.evidence(best, n, [x[0] for x in found])
                    if found:
                        at = np.concatenate(([0], np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)))
                        size = float(model.segments.size(n))
                        spans[i] = [(int(at[a]), int(at[b]), model.segments.rate * s / _UNIT - size) for s, a, b in found]
                scores = model.probability(np.clip(evidence, *_EVIDENCE))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array(spans, pa.list_(passage))], ["doc_id", "score", "passages"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double, passages array<struct<start:long,end:long,evidence:double>>")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return find_passages(documents, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))
