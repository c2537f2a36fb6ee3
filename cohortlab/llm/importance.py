"""Documents drawn towards a target distribution: importance weights and a distributed radix sort.

Words are runs of digits, lower-cased ASCII letters and bytes above ASCII. The
features of a text are its words and pairs of consecutive words, hashed (CRC-32)
to BUCKETS. One pass over the documents and one over the target count the
buckets; the gain of a bucket, in thousandths, is the log-ratio of its smoothed
shares. The weight of a text is the mean gain of its features, looked up in the
array of all gains. Gumbel noise that depends on the id alone is added, so that
the highest scores are a weighted sample without replacement.

The order comes from a radix sort of the composite key (score falling, id rising),
least significant digit first. Each pass is a stable counting sort: rows are
counted by (digit, block), prefix sums over the digits and over the blocks of a
digit give the offset of each group, and a row moves to that offset plus its place
in the group. A block is about the square root of the number of rows, so neither a
group of rows nor the offsets of a digit outgrow one task. Digits that are the same in all rows are left out.

Defined cases: a null text has no feature, like an empty one; a text without a
feature has weight 0; a null id hashes as the empty string and comes before any
other id; rows that repeat an id and score follow each other in no fixed order;
without a target text every bucket's target count is 0; empty tables give no
rows. Only the named columns are read, so further ones may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.llm import buffers
from cohortlab.scratch import materialize

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
#: Percent of the documents with enough words that are drawn.
PERCENT = 25
DIGIT_BITS = 11
_LEAST = -(1 << 63)
_ALL = np.uint32(0xFFFFFFFF)

# --- CRC-32 of words and pairs of words -----------------------------------------------------------------------------


def _byte_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = (steps >> np.uint32(1)) ^ np.where(steps & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return steps


_STEP = _byte_steps()
#: Words up to this length are hashed byte by byte in step with each other.
_SHORT = 32


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _STEP[(state ^ np.asarray(byte, np.uint32)) & np.uint32(255)] ^ (state >> np.uint32(8))


def _apply(tables: np.ndarray, state: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """A linear map of states, given as the images of the values of each byte (``which`` picks the map)."""
    out = np.zeros(len(state), np.uint32)
    for k in range(4):
        byte = (state >> np.uint32(8 * k)) & np.uint32(255)
        out ^= tables[k][byte] if which is None else tables[which, k, byte]
    return out


def _zero_bytes() -> tuple[np.ndarray, list[np.ndarray]]:
    """The maps for 0 to _SHORT - 1 zero bytes, and for _SHORT, 2 * _SHORT, 4 * _SHORT, ... of them."""
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    few = []
    for _ in range(_SHORT):
        few.append(now)
        now = _step(now, 0)
    many = []
    for _ in range(27):
        many.append(now)
        now = np.stack([_apply(now, row) for row in now])
    return np.stack(few), many


_FEW, _MANY = _zero_bytes()


def _pass_zeros(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    state = _apply(_FEW, state, n % _SHORT)
    rest = n // _SHORT
    for k in range(int(rest.max(initial=0)).bit_length()):
        at = np.flatnonzero(rest >> k & 1)
        state[at] = _apply(_MANY[k], state[at])
    return state


def _word_states(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    state = np.full(len(start), _ALL, np.uint32)
    size = end - start
    alive = np.arange(len(start))
    for i in range(min(_SHORT, int(size.max(initial=0)))):
        alive = alive[size[alive] > i]
        state[alive] = _step(state[alive], data[start[alive] + i])
    for i in np.flatnonzero(size > _SHORT):
        state[i] = zlib.crc32(data[start[i] + _SHORT : end[i]], int(state[i] ^ _ALL)) ^ 0xFFFFFFFF
    return state


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MEMBER = np.zeros(256, bool)
_MEMBER[48:58] = _MEMBER[97:123] = _MEMBER[128:] = True


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every feature, and the number of words of each row."""
    data = _LOWER[data]
    start, end, row = buffers.runs(_MEMBER[data], offsets)
    state = _word_states(data, start, end)
    pair = row[1:] == row[:-1]
    left, right = _step(state[:-1][pair], 0x20), state[1:][pair]
    both = _pass_zeros(left ^ _ALL, (end - start)[1:][pair]) ^ right
    names = np.concatenate((state, both)) ^ _ALL
    return (names % np.uint32(buckets)).astype(np.int64), np.concatenate((row, row[1:][pair])), np.bincount(row, minlength=len(offsets) - 1)


def _text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffers.utf8(column)
    for first, last in buffers.row_chunks(offsets):
        o = offsets[first : last + 1]
        yield first, last, data[o[0] : o[-1]], o


# --- weights ----------------------------------------------------------------------------------------------------------


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in _text_chunks(batch.column("text")):
                total += np.bincount(feature_buckets(data, offsets, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one row for each bucket
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-ratio of the smoothed shares of each bucket, in thousandths, rounded down."""
    s, t = documents.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for first, last, data, offsets in _text_chunks(batch.column("text")):
                bucket, row, words = feature_buckets(data, offsets, len(gain))
                n = np.bincount(row, minlength=last - first)
                total = np.zeros(last - first, np.int64)
                np.add.at(total, row, gain[bucket])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    ["doc_id", "n_words", "n_features", "weight"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down; a function of the id and the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


# --- order ------------------------------------------------------------------------------------------------------------


def _counting_pass(rows: DataFrame, digit: Column, block: int) -> DataFrame:
    """``rows`` with ``_at`` as their places after a stable counting sort by ``digit``."""
    dealt = rows.withColumns({"_digit": digit, "_block": F.floor(F.col("_at") / block)})
    sizes = dealt.groupBy("_digit", "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))), "counts")
    # one row for each digit, 2**DIGIT_BITS at most
    smaller = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    digits = sizes.groupBy("_digit").agg(F.sum("_n").alias("_n")).select(
        "_digit", F.coalesce(F.sum("_n").over(smaller), F.lit(0)).alias("_smaller"))
    starts = sizes.join(F.broadcast(digits), "_digit").select("_digit", "_block", (F.col("_smaller") + F.col("_before")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("_at")) - 1
    moved = dealt.withColumn("_place", place).join(starts.hint("merge"), ["_digit", "_block"])
    return moved.withColumn("_at", F.col("_start") + F.col("_place")).select(*rows.columns)


def radix_sorted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_at``, their 0-based place in rising order of the long columns ``keys`` (no nulls)."""
    # signed numbers in the order of unsigned ones
    unsigned = {k: F.col(k).bitwiseXOR(F.lit(_LEAST)) for k in keys}
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "unsorted")
    ends = rows.agg(F.count("*").alias("n"), *[f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)]).first()
    block = max(math.isqrt(ends["n"]), 1)
    for key in reversed(keys):
        if not ends["n"]:
            break
        bits = (ends[f"min_{key}"] ^ ends[f"max_{key}"]) % (1 << 64)  # above the highest bit that differs all are equal
        for shift in range(0, bits.bit_length(), DIGIT_BITS):
            digit = F.shiftrightunsigned(unsigned[key], shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
            rows = materialize(_counting_pass(rows, digit, block), "sorted")
    if ends["n"] and all(ends[f"min_{k}"] == ends[f"max_{k}"] for k in keys):
        rows = materialize(_counting_pass(rows, F.lit(0).cast("long"), block), "sorted")
    return rows


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row, and ``rank`` (from 1) of the drawn ones.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred are drawn.
    """
    gain = gains(bucket_counts(documents), bucket_counts(target))
    scored = weighted(documents, gain)
    scored = materialize(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    fit = scored.where(F.col("n_words") >= min_words)
    # a falling score is a rising complement
    keyed = fit.withColumns({"_fall": F.bitwise_not("score"), "_id": F.coalesce("doc_id", F.lit(_LEAST))})
    drawn = percent * fit.count() // 100
    rank = F.when(F.col("_at") < drawn, F.col("_at") + 1).cast("long").alias("rank")
    ranked = radix_sorted(keyed, ["_fall", "_id"]).select(*scored.columns, rank)
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def keep_drawn(documents: DataFrame, ranked: DataFrame) -> DataFrame:
    """The documents whose id is drawn, with all their columns."""
    ids = ranked.where("rank IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    return documents.join(ids, documents["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return resample(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte, for all distinct features at once.
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, 0 AS k, i AS v FROM range(256) r(i)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN v % 2 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END FROM bits WHERE k < 8
), steps AS MATERIALIZED (
  SELECT byte, v FROM bits WHERE k = 8
), split AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, false AS target FROM documents
  UNION ALL
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), true FROM benchmark
), features AS MATERIALIZED (
  SELECT doc_id, target, f, count(*) AS n FROM (
    SELECT doc_id, target, unnest(w) AS f FROM split
    UNION ALL
    SELECT doc_id, target, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM split) GROUP BY ALL
), walk AS (
  SELECT f, hex(encode(f)) AS h, 0::BIGINT AS pos, 4294967295::BIGINT AS c FROM (SELECT DISTINCT f FROM features)
  UNION ALL
  SELECT f, h, pos + 1, xor(c >> 8, s.v) FROM walk JOIN steps s ON s.byte = (xor(c, ('0x' || substr(h, 2 * pos + 1, 2))::BIGINT) & 255)
  WHERE pos < length(h) // 2
), named AS MATERIALIZED (
  SELECT f, xor(c, 4294967295::BIGINT) % {BUCKETS} AS bucket FROM walk WHERE pos = length(h) // 2
), counted AS MATERIALIZED (
  SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target), 0)::DOUBLE AS t
  FROM features JOIN named USING (f) GROUP BY bucket
), gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + {BUCKETS})
    / ((s + 1) * ((SELECT sum(t) FROM counted) + {BUCKETS}))))::BIGINT AS g FROM counted
), weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight
  FROM features JOIN named USING (f) JOIN gain USING (bucket) WHERE NOT target GROUP BY doc_id
), scored AS MATERIALIZED (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(w.n_features, 0) AS n_features, coalesce(w.weight, 0) AS weight,
         coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296)))::BIGINT AS score
  FROM split d LEFT JOIN weights w USING (doc_id) WHERE NOT d.target
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= {MIN_WORDS}
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN p.place <= {PERCENT} * p.n // 100 THEN p.place END AS rank
FROM scored s LEFT JOIN placed p USING (doc_id)
"""
