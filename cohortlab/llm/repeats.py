"""Long byte strings that stand elsewhere earlier, by prefix doubling on position rank pairs.

Positions are ranked by the ANCHOR bytes that follow them, then by pairs of ranks
at growing offsets, and leave as soon as their rank is unique or the compared
length is past LENGTH. Only anchors are followed: the positions whose first rank is
the smallest in some window, so that every string of LENGTH bytes holds one, chosen
by its own bytes alone. Ranks are 64-bit hash names, so that no step has to number all
positions in one order; what decides a removal has 128 bits.

1. ANCHOR bytes: an anchor whose rank occurs once proves all strings around it unique.
2. The whole context, LENGTH bytes on and LENGTH - ANCHOR back (or up to the border of the text): where it
   stands earlier, all strings around the anchor do. They are one run, and only the
   first anchor of every context goes on.
3. Contexts of LENGTH - STEP bytes at SIDES offsets: a string around the anchor holds one of
   them. If one is unique, the strings that hold it are.
4. LENGTH bytes, as pairs of ranks of the two halves, for the strings that are left. Those
   that their own text holds further ahead are settled where they are found; the others meet once.

Defined cases: null texts count as empty; a text that stands with a smaller id
is removed whole if it has LENGTH bytes; rows that repeat an id are one document
whose texts start at the same place; a null id is smaller than any other; an
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import buffers
from cohortlab.llm.skew import weighted_join
from cohortlab.scratch import materialize, release

LENGTH = 100
ANCHOR = 32
#: How far a context reaches back from its anchor.
BACK = LENGTH - ANCHOR
#: The strings around an anchor by how far they reach back: SIDES ranges of STEP bytes.
SIDES = 4
STEP = BACK // SIDES
_LEAST = -(1 << 63)
_KEY = ["doc", "body"]
_SIDES = [f"side{k}" for k in range(SIDES)]


def slide(x: np.ndarray, w: int, op: np.ufunc, filler: int) -> np.ndarray:
    """op over every window of w values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, filler, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Positions and ranks of the anchors of one text; each window of ``length`` bytes holds one."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(data) - size + 1)
    rank = buffers.span_hash(buffers.prefix_hash(data), at, at + size)
    w = length - size + 1
    least = slide(rank, w, np.minimum, (1 << 64) - 1)
    # a position is chosen if one of the windows around it has its rank as the smallest
    around = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    chosen = np.flatnonzero(slide(around, w, np.maximum, 0)[: len(rank)] == rank)
    return chosen, rank[chosen]


def _batched(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from tuples of equally long arrays, or of (values, where they are null)."""
    out: list[tuple] = []
    held = 0
    for columns in rows:
        if len(columns[0]):
            out.append(columns)
            held += len(columns[0])
        if held > 200_000:
            yield pa.RecordBatch.from_arrays([_joined(c) for c in zip(*out, strict=True)], names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([_joined(c) for c in zip(*out, strict=True)], names)


def _joined(parts: tuple) -> pa.Array:
    missing = None
    if isinstance(parts[0], tuple):
        parts, missing = zip(*parts, strict=True)
        missing = np.concatenate(missing)
    values = np.concatenate(parts)
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, mask=missing)


def _texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = buffers.utf8(batch.column("text"))
    for i in range(batch.num_rows):
        yield i, data[offsets[i] : offsets[i + 1]]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            body = batch.column("body").to_numpy()
            for i, text in _texts_of(batch):
                rank, times = np.unique(anchors(text)[1], return_counts=True)
                yield rank, np.full(len(rank), body[i]), times

    yield from _batched(rows(), ["rank", "body", "times"])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            doc, body, near = batch.column("doc").to_numpy(), batch.column("body").to_numpy(), batch.column("near")
            for i, text in _texts_of(batch):
                at, rank = anchors(text)
                back, on = np.minimum(at, BACK), np.minimum(len(text) - at, LENGTH)
                known = np.sort(np.asarray(near[i].values).view(np.uint64))
                keep = (known[np.minimum(np.searchsorted(known, rank), len(known) - 1)] == rank) & (back + on >= LENGTH)
                at, rank, back, on = at[keep], rank[keep], back[keep], on[keep]
                n, prefix = len(at), buffers.prefix_hash(text)
                whole = buffers.mix(buffers.span_hash(prefix, at - back, at + on) + back.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                low = at - np.arange(SIDES)[:, None] * STEP
                high = low - STEP + LENGTH
                missing = (low < 0) | (high > len(text))
                names = buffers.span_hash(prefix, np.maximum(low, 0), np.minimum(high, len(text)))
                sides = zip(names, missing, strict=True)
                yield np.full(n, doc[i]), np.full(n, body[i]), at, rank, whole, *sides, at - back, at - np.maximum(LENGTH - on, 0)

    yield from _batched(rows(), ["doc", "body", "at", "rank", "whole", *_SIDES, "low", "high"])


def _covered(low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """The bytes of the strings that start from ``low`` up to ``high``."""
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, low, 1)
    np.add.at(mark, np.minimum(high + LENGTH, size), -1)
    return np.cumsum(mark)[:size] > 0


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    half, none = LENGTH // 2, (1 << 64) - 1

    def rows() -> Iterator[tuple]:
        for batch in batches:
            doc, body, near = batch.column("doc").to_numpy(), batch.column("body").to_numpy(), batch.column("near")
            for i, text in _texts_of(batch):
                prefix, count = buffers.prefix_hash(text), len(text) - LENGTH + 1
                every = np.arange(len(text) - ANCHOR + 1)
                rank = buffers.span_hash(prefix, every, every + ANCHOR)
                least = slide(rank, BACK + 1, np.minimum, none)
                chosen = np.zeros(count, bool)
                places, sides = np.asarray(near[i].values.field("at")), np.asarray(near[i].values.field("side"))
                for k in range(SIDES):
                    active = np.full(len(rank), none, np.uint64)
                    at = places[sides == k]
                    active[at] = rank[at]
                    # the anchor of a string that starts at p is at p + k * STEP or up to STEP further on
                    chosen |= slide(active, STEP + 1, np.minimum, none)[k * STEP : k * STEP + count] == least
                at = np.flatnonzero(chosen)
                a, b = buffers.span_hash(prefix, at, at + half).view(np.int64), buffers.span_hash(prefix, at + half, at + LENGTH).view(np.int64)
                # of a string that its text holds further ahead nothing else has to be known
                order = np.lexsort((b, a))
                again = np.zeros(len(at), bool)
                again[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
                for part in np.array_split(np.arange(len(at)), max(1, len(at) // 200_000)):
                    n = len(part)
                    yield np.full(n, doc[i]), np.full(n, body[i]), at[part], a[part], b[part], again[part]

    yield from _batched(rows(), ["doc", "body", "at", "a", "b", "again"])


def _keyed_columns() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc"), F.xxhash64(text).alias("body"), text.alias("text")]


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(*_keyed_columns())


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key other rows have as well; rows with a null in the key are left out."""
    given = rows.dropna(subset=key)
    groups = materialize(given.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "groups")
    return weighted_join(given, groups, key, "n", given.count()).drop("n")


def _copies(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc and body of the first document with each text, and of the others."""
    sums = materialize(texts.select("doc", "body", F.xxhash64(F.lit(5), "text").alias("more")), "sums")
    groups = materialize(sums.groupBy("body", "more").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "groups")
    copies = weighted_join(sums, groups.where("n > 1"), ["body", "more"], "n", sums.count()).where("doc > first")
    copies = materialize(copies.select(*_KEY).distinct(), "copies")
    release(sums)
    firsts = groups.select(F.col("first").alias("doc"), "body")
    firsts.stored_path = groups.stored_path
    return firsts, copies


def repeated_runs(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, runs) by doc and body: texts that stand with a smaller id, and for the others
    runs of starts, from ``low`` to ``high``, of strings that also start earlier."""
    texts = _keyed(documents).where(F.octet_length("text") >= LENGTH)
    firsts, copies = _copies(texts)
    # 1. ANCHOR bytes; equal texts have one name, so they do not make a rank repeated
    found = materialize(texts.mapInArrow(_anchor_rows, "rank long, body long, times long"), "anchors")
    again = found.groupBy("rank").agg(F.min("body").alias("a"), F.max("body").alias("b"), F.max("times").alias("times"), F.count("*").alias("n"))
    again = materialize(again.where("a <> b OR times > 1").select("rank", "n"), "ranks")
    near = weighted_join(found.select("rank", "body"), again, ["rank"], "n", found.count()).groupBy("body").agg(F.collect_set("rank").alias("near"))
    near = materialize(near.join(firsts.hint("merge"), "body"), "near")
    release(found, again)
    # 2. the whole context
    schema = f"doc long, body long, at long, rank long, whole long, {', '.join(f'{x} long' for x in _SIDES)}, low long, high long"
    contexts = materialize(texts.join(near.hint("merge"), _KEY).mapInArrow(_context_rows, schema), "contexts")
    release(near)
    first = F.min(F.struct("doc", "at", "body", *_SIDES)).alias("first")
    groups = materialize(contexts.groupBy("rank", "whole").agg(first, F.count("*").alias("n")), "groups")
    settled = weighted_join(
        contexts.select("doc", "body", "at", "rank", "whole", "low", "high"),
        groups.where("n > 1").select("rank", "whole", "n", F.struct("first.doc", "first.at").alias("first")),
        ["rank", "whole"], "n", contexts.count()).where(F.struct("doc", "at") > F.col("first"))
    settled = materialize(settled.select(*_KEY, "low", "high"), "settled")
    # 3. nearly the length, at several offsets
    left = groups.select("rank", "first.*")
    single = firsts.groupBy("doc").count().where("count > 1").isEmpty()
    if not single:  # texts of one id may hold a context at the same place, and none of them is later
        tied = weighted_join(
            contexts.select("rank", "whole", "doc", "at", "body", *_SIDES),
            groups.where("n > 1").select("rank", "whole", "n", F.struct("first.doc", "first.at").alias("first"), F.col("first.body").alias("other")),
            ["rank", "whole"], "n", contexts.count()).where((F.struct("doc", "at") == F.col("first")) & (F.col("body") != F.col("other")))
        left = left.unionByName(materialize(tied.select(*left.columns), "tied"))
    active = None
    for k, side in enumerate(_SIDES):
        found = _repeated(left.select(*_KEY, "at", "rank", side), ["rank", side]).select(*_KEY, "at", F.lit(k).alias("side"))
        active = found if active is None else active.unionByName(found)
    near = materialize(active.groupBy(*_KEY).agg(F.collect_set(F.struct("at", "side")).alias("near")), "near")
    release(contexts, groups)
    # 4. the strings themselves
    pairs = materialize(texts.join(near.hint("merge"), _KEY).mapInArrow(_pair_rows, "doc long, body long, at long, a long, b long, again boolean"), "rank-pairs")
    release(near)
    # a text holds a string once here, so ids decide, unless several texts have one; a plain number is aggregated without sorting
    place = F.col("doc") if single else F.struct("doc", "at")
    strings = pairs.where("NOT again").drop("again")
    first = materialize(strings.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first-pairs")
    release(firsts)
    later = weighted_join(strings, first, ["a", "b"], "n", pairs.count()).where(place > F.col("first")).select(*_KEY, "at")
    later = materialize(later.unionByName(pairs.where("again").select(*_KEY, "at")), "later")
    release(pairs, first)
    later = later.select(*_KEY, F.col("at").alias("low"), F.col("at").alias("high"))
    return copies, settled.unionByName(later)


def _kept(text: np.ndarray, whole: bool, runs: pa.Array | None) -> tuple[bytes, int]:
    """The bytes that stay and the number of removed runs."""
    if whole:
        return b"", 1
    if runs is None or not len(runs):
        return text.tobytes(), 0
    gone = _covered(np.asarray(runs.field("low")), np.asarray(runs.field("high")), len(text))
    return text[~gone].tobytes(), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes ``kept`` of every row."""
    copies, runs = repeated_runs(documents)
    runs = runs.groupBy(*_KEY).agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    marks = copies.withColumns({"whole": F.lit(True), "runs": F.lit(None).cast(runs.schema["runs"].dataType)}).unionByName(
        runs.withColumn("whole", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers.utf8(batch.column("text"))
            whole, runs = batch.column("whole"), batch.column("runs")
            for low, high in buffers.row_chunks(offsets, 16 << 20):
                rows = []
                for i in range(low, high):
                    text = data[offsets[i] : offsets[i + 1]]
                    kept, spans = _kept(text, bool(whole[i].as_py()), runs[i].values if runs[i].is_valid else None)
                    rows.append((len(text), len(text) - len(kept), spans, kept))
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_keyed_columns())
    return rows.join(marks, _KEY, "left").select("doc_id", "text", "whole", "runs").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(documents).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
