"""Near-duplicates by ProbMinHash over weighted word shingles.

The shingles are five words in a row (lower case, split at white space),
weighted by how often they occur. Every shingle starts a Poisson process whose
rate is its weight; an arrival falls into a random register, which keeps the
earliest one. A process ends when its time has passed the latest register, so
most shingles take one or two steps. The share of equal registers of two texts
estimates their probability Jaccard similarity. As links are judged by sets, a
second row of registers takes every weight as 1. Both are banded; texts that
share a band are candidates, and links are found by comparing their shingle sets
exactly (Jaccard).

Equal texts are one node before anything is hashed. The members of a bucket are
compared with one of them, and where they then are of several components, with a member of
another component and with the most typical member, whose shingles most other sets have: of edits
of one text that is the least edited one, which all links of the others lead to or pass nearby.
That takes a row or two for each member and joins what belongs together in nearly all buckets. For buckets that still hold several components every pair of components has to be
shown different: their members meet by shared rare shingles only. Of a set of n
shingles in order of rarity, the first n - ceil(0.8 n) + 1 are looked up among the first
n - ceil(8/9 n) + 1 of sets that are not larger, and only where the first shared one leaves
enough shingles behind it in both sets; no pair with similarity 0.8 escapes that.
Members of one component never meet, and no link between classes is lost. Classes are the
connected components of the links.

Defined cases: null texts and texts without a word are in a class of their own;
a text of one to four words is one shingle; a row belongs to the class of its
text, so rows that repeat an id with other texts may be in different classes; a null
id is smaller than any other; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import buffers
from cohortlab.scratch import materialize, release

SHINGLE = 5
SIMILARITY = 0.8
BANDS, WIDTH = 24, 5
_M = BANDS * WIDTH
_LEAST = -(1 << 63)
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Rows and bytes of text that are hashed at once.
_ROWS, _BYTES = 1024, 1 << 18
_WORD = r"[^ \t\n\x0b\f\r]"
#: The frequency of a shingle is counted in so many buckets; it only orders shingles.
_RARITY_BITS = 20


def shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of rows: first row, last row, hashes of the shingles and their rows (from 0 in the chunk)."""
    buffers.forget()
    for at in range(0, len(column), _ROWS):
        # copies of texts are made for one piece of a batch at a time
        data, offsets = buffers.utf8(pc.utf8_lower(column.slice(at, _ROWS).cast(pa.string())))
        for first, last in buffers.row_chunks(offsets, _BYTES, _ROWS):
            o = offsets[first : last + 1]
            hashes, rows = _shingle_hashes(data[o[0] : o[-1]], o)
            yield at + first, at + last, hashes, rows
    pa.default_memory_pool().release_unused()


def _shingle_hashes(part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(offsets) - 1
    start, end, row = buffers.words(part, offsets)
    names = buffers.span_hash(buffers.prefix_hash(part), start, end)
    n = max(len(names) - SHINGLE + 1, 0)
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total = total * _ODD + names[i : i + n]
    whole = row[:n] == row[SHINGLE - 1 :] if n else np.zeros(0, bool)
    hashes, rows = [buffers.mix(total[whole])], [row[:n][whole]]
    count = np.bincount(row, minlength=size)
    begin = np.concatenate(([0], np.cumsum(count)))
    for r in np.flatnonzero((count > 0) & (count < SHINGLE)):
        value = np.full(1, count[r], np.uint64)
        for name in names[begin[r] : begin[r + 1]]:
            value = buffers.mix(value * _ODD + name)
        hashes.append(value)
        rows.append(np.array([r]))
    return np.concatenate(hashes), np.concatenate(rows)


def _weighted(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: hash, row, weight."""
    key = buffers.mix(hashes + buffers.mix(row.astype(np.uint64) + np.uint64(1)))
    _, at, weight = np.unique(key, return_index=True, return_counts=True)
    return hashes[at], row[at], weight.astype(np.float64)


def signatures(hashes: np.ndarray, row: np.ndarray, rows: int, registers: int = _M, unit: bool = False) -> np.ndarray:
    """The ProbMinHash registers of each row (``unit``: every weight is 1); rows without shingles have zeros."""
    element, row, weight = _weighted(hashes, row)
    if unit:
        weight = np.ones(len(weight))
    earliest = np.full(rows * registers, np.inf)
    names = np.zeros(rows * registers, np.uint64)
    time = np.zeros(len(element))
    step = 0
    while len(element):
        step += 1
        draw = buffers.mix(element + np.full(1, step, np.uint64) * _ODD)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight
        slot = row * registers + (buffers.mix(draw) % np.uint64(registers)).astype(np.int64)
        better = time < earliest[slot]
        np.minimum.at(earliest, slot[better], time[better])
        best = better & (time == earliest[slot])
        names[slot[best]] = element[best]
        latest = earliest.reshape(rows, registers).max(axis=1)
        alive = time < latest[row]
        element, row, weight, time = element[alive], row[alive], weight[alive], time[alive]
    return names.reshape(rows, registers)


def band_values(names: np.ndarray) -> np.ndarray:
    """The bands of each row of registers."""
    value = np.zeros((len(names), BANDS), np.uint64)
    for i in range(WIDTH):
        value = value * _ODD + names[:, i * BANDS : (i + 1) * BANDS]
    return buffers.mix(value + np.arange(BANDS, dtype=np.uint64))


def bands_of(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bands from unit weights of all rows, and from counts where they differ: values and their rows."""
    plain = band_values(signatures(hashes, row, rows, unit=True))
    counted = band_values(signatures(hashes, row, rows))
    more, band = np.nonzero(counted != plain)
    return np.concatenate((plain.ravel(), counted[more, band])), np.concatenate((np.repeat(np.arange(rows), BANDS), more))


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column("node").to_numpy()
        for first, last, hashes, row in shingles(batch.column("text")):
            if not len(hashes):
                continue
            kept = np.unique(row)
            value, at = bands_of(hashes, np.searchsorted(kept, row), len(kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(node[first:last][kept][at])], ["bucket", "node"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, hashes, row in shingles(batch.column("text")):
            h, r, _ = _weighted(hashes, row)
            order = np.argsort(r, kind="stable")
            bounds = np.searchsorted(r[order], np.arange(last - first + 1)).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(bounds), pa.array(h[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(first, last - first), parts, batch.column("leads").slice(first, last - first)],
                ["node", "parts", "leads"])


# --- nodes --------------------------------------------------------------------------------------------------------------


def _keyed(documents: DataFrame) -> DataFrame:
    """``doc`` (null: the least), the text and two hashes of it."""
    text = F.col("text").cast("string")
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc"), text.alias("text"),
                            F.xxhash64(text).alias("w1"), F.xxhash64(F.lit(3), text).alias("w2"))


def nodes_of(documents: DataFrame) -> DataFrame:
    """w1, w2, the smallest id ``doc`` and a number ``node`` of every distinct text that has a word."""
    first = _keyed(documents).where(F.col("text").rlike(_WORD)).groupBy("w1", "w2").agg(F.min("doc").alias("doc"))
    # the numbers are unique, and fixed once they are written
    return materialize(first.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _texts(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with their texts."""
    key = ["doc", "w1", "w2"]
    whole = _keyed(documents).where(F.col("text").rlike(_WORD)).groupBy(*key).agg(F.first("text").alias("text"))
    return whole.join(nodes.hint("merge"), key)


# --- links --------------------------------------------------------------------------------------------------------------


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, lead) whose shingle sets are similar enough."""
    # a lead may have very many partners: the sorted join splits such a key
    lead = sets.select(F.col("node").alias("lead"), F.col("parts").alias("other"))
    leads = pairs.select("lead").distinct()
    both = pairs.join(sets.select("node", "parts").hint("merge"), "node").join(
        lead.join(leads.hint("merge"), "lead", "left_semi").hint("merge"), "lead")
    return _similar(both, similarity)


def _similar(both: DataFrame, similarity: float) -> DataFrame:
    sizes = F.size("parts") + F.size("other")
    # the smaller set must be large enough, or else nothing is compared
    near = both.where(F.least(F.size("parts"), F.size("other")) >= similarity * F.greatest(F.size("parts"), F.size("other")))
    common = F.size(F.array_intersect("parts", "other"))
    return near.select("node", "lead", common.alias("common"), sizes.alias("both")).where(
        F.col("common") >= similarity * (F.col("both") - F.col("common"))).select("node", "lead")


def _with_root(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, node and root of the buckets that hold several components; ``high`` is the largest root of the bucket."""
    rooted = materialize(_with_root(members.select("bucket", "node"), labels), "rooted")
    ends = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    found = materialize(rooted.join(ends.select("bucket", "high").hint("merge"), "bucket"), "mixed")
    release(rooted)
    return found


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each of 2**_RARITY_BITS buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _RARITY_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_bucket(batch.column("parts").flatten()), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = sets.select("parts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << _RARITY_BITS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _bucket(parts: pa.Array) -> np.ndarray:
    return (np.asarray(parts).view(np.uint64) >> np.uint64(64 - _RARITY_BITS)).astype(np.int64)


def _typical(members: DataFrame, sets: DataFrame, rarity: Broadcast) -> DataFrame:
    """Pairs (node, lead) of the members of each bucket and its most typical member, where that is of another component.

    A set is the less typical the larger the mean of 1 / frequency of its shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            size = pc.list_value_length(parts).to_numpy()
            total = np.bincount(np.repeat(np.arange(len(size)), size), 1 / rarity.value[_bucket(parts.flatten())], len(size))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(total / np.maximum(size, 1))], ["node", "odd"])

    odd = sets.select("node", "parts").mapInArrow(run, "node long, odd double")
    ranked = members.select("bucket", "node", "root").join(odd.hint("merge"), "node")
    centres = ranked.groupBy("bucket").agg(F.min(F.struct("odd", "node", "root")).alias("centre"))
    return members.select("bucket", "node", "root").join(centres.hint("merge"), "bucket").where(F.col("root") != F.col("centre.root")).select(
        "node", F.col("centre.node").alias("lead"))


def _rare_shingles(sets: DataFrame, similarity: float, shared: Broadcast) -> DataFrame:
    """node, root, n, shingle of the rare shingles of each set; ``few`` marks those by which it is looked up as the smaller set.

    ``slack``: with a share of s / (1 + s) of both sizes in common, a set of m shingles that shares no earlier
    one needs ``slack`` >= m * s / (1 + s).
    """
    least = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            parts = batch.column("parts")
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            node, root = batch.column("node").to_numpy(), batch.column("root").to_numpy()
            for i in range(batch.num_rows):
                h = np.asarray(parts[i].values)
                n = len(h)
                many = n - math.ceil(similarity * n - 1e-9) + 1
                few = n - math.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1
                rare = h[np.lexsort((h, rarity[_bucket(h)]))[:many]]
                for column, values in zip(out, (np.full(many, node[i]), np.full(many, root[i]), np.full(many, n), rare, np.arange(many) < few,
                                                  n - np.arange(many) - least * n + 1e-6)):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["node", "root", "n", "shingle", "few", "slack"])

    return sets.select("node", "root", "parts").mapInArrow(run, "node long, root long, n long, shingle long, few boolean, slack double")


def _meeting(sets: DataFrame, similarity: float, rarity: Broadcast) -> DataFrame:
    """Pairs (node, lead) of different components that share a rare shingle and whose sizes allow a link."""
    rows = materialize(_rare_shingles(sets.where(F.size("parts") > 0), similarity, rarity), "rare")
    ends = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    rows_ = materialize(rows.join(ends.hint("merge"), "shingle"), "shared")
    release(rows)
    # components meet first, so that the members of one component never do
    least = similarity / (1 + similarity)
    smaller = rows_.where("few").groupBy("shingle", "root").agg(F.max("slack").alias("slack"), F.min("n").alias("n"))
    larger = rows_.groupBy("shingle", F.col("root").alias("lead_root")).agg(F.max("slack").alias("lead_slack"), F.min("n").alias("m"))
    enough = (F.col("slack") >= least * F.col("m")) & (F.col("lead_slack") >= least * F.col("n"))
    meet = smaller.join(larger.hint("merge"), "shingle").where((F.col("root") != F.col("lead_root")) & enough).select(
        "shingle", "root", "lead_root")
    pairs = meet.join(rows_.where("few").select("shingle", "root", "node", "n", "slack").hint("merge"), ["shingle", "root"]).join(
        rows_.select("shingle", F.col("root").alias("lead_root"), F.col("node").alias("lead"), F.col("n").alias("m"),
                     F.col("slack").alias("lead_slack")).hint("merge"),
        ["shingle", "lead_root"]).where((F.col("n") <= F.col("m")) & (F.col("n") >= similarity * F.col("m")) & enough)
    found = materialize(pairs.select("node", "lead").distinct(), "meeting")
    release(rows_)
    return found


def links(documents: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (node, lead) of one class that join all nodes that belong together: similar ones, and nodes with the least one of theirs."""
    bands = materialize(_texts(documents, nodes).select("node", "text").mapInArrow(_band_rows, "bucket long, node long"), "bands")
    ends = bands.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = materialize(bands.join(ends.select("bucket", "low").hint("merge"), "bucket"), "members")
    release(bands)
    # every member with the least ones of its buckets: a few numbers for each node
    leads = members.groupBy("node").agg(F.array_remove(F.collect_set("low"), F.col("node")).alias("leads"))
    needed = nodes.join(leads.hint("merge"), "node")
    sets = materialize(_texts(documents, needed).select("node", "text", "leads").mapInArrow(
        _set_rows, "node long, parts array<long>, leads array<long>"), "sets")
    stars = sets.select("node", "parts", F.explode("leads").alias("lead"))
    centres = members.select(F.col("low").alias("lead")).distinct()
    other = sets.select(F.col("node").alias("lead"), F.col("parts").alias("other")).join(centres.hint("merge"), "lead", "left_semi")
    found = materialize(_similar(stars.join(other.hint("merge"), "lead"), similarity), "links")
    labels = components(found)
    mixed = _mixed(members, labels)
    release(members)
    # the members of other components with a member of the component that has the largest root, and with the most typical member
    pairs = mixed.where("root <> high").select("node", F.col("high").alias("lead"))
    used = mixed.select("node").union(mixed.select("high")).distinct()
    held = materialize(sets.select("node", "parts").join(used.hint("merge"), "node"), "held")
    release(sets)
    rarity = held.sparkSession.sparkContext.broadcast(_rarity(held))
    pairs = materialize(pairs.union(_typical(mixed, held, rarity)).distinct(), "pairs")
    more = materialize(_linked(pairs, held, similarity), "links")
    # a label stands for the links it comes from, which leaves shorter ways to walk
    joined = components(labels.select("node", F.col("root").alias("lead")).unionByName(more))
    again = _mixed(mixed, joined)
    release(mixed, labels, pairs)
    left = materialize(held.join(again.select("node", "root").distinct().hint("merge"), "node"), "left")
    last = materialize(_linked(_meeting(left, similarity, rarity), left, similarity), "links")
    release(held, again, left)
    return joined.select("node", F.col("root").alias("lead")).unionByName(last)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component, by labels that jump over labels."""
    both = materialize(edges.select(F.col("node").alias("a"), F.col("lead").alias("b"))
                       .union(edges.select(F.col("lead").alias("a"), F.col("node").alias("b"))), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root").hint("merge"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = materialize(labels.join(seen.withColumnRenamed("a", "node").hint("merge"), "node").select(
            "node", "root", F.least("root", "near").alias("new")), "step")
        if step.where("root <> new").isEmpty():  # no edge joins two labels
            release(both, labels)
            stored = step.select("node", "root")
            stored.stored_path = step.stored_path
            return stored
        up = step.select(F.col("node").alias("new"), F.col("new").alias("top"))
        jumped = materialize(step.join(up.hint("merge"), "new", "left").select(
            "node", F.least("new", F.coalesce("top", "new")).alias("root")), "labels")
        release(labels, step)
        labels = jumped


# --- classes ------------------------------------------------------------------------------------------------------------


def classes(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """w1 and w2 of every distinct text, and the smallest (doc, w1, w2) ``head`` of its class."""
    nodes = nodes_of(documents)
    labelled = _with_root(nodes, components(links(documents, nodes, similarity)))
    heads = labelled.groupBy("root").agg(F.min(F.struct("doc", "w1", "w2")).alias("head"))
    # a class may hold very many texts: the sorted join splits it
    return materialize(labelled.join(heads.hint("merge"), "root").select("w1", "w2", "head"), "classes")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class of near-duplicates."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = _keyed(documents)
    return found.drop("text").join(classes(documents).hint("merge"), ["w1", "w2"], "left").select(
        F.when(F.col("doc") != _LEAST, F.col("doc")).alias("doc_id"), F.coalesce("head.doc", "doc").alias("class_id"))


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with the smallest id of their class, with all their columns; rows that repeat one stay with it."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    text, doc = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    keys = documents.select(doc.alias("doc"), F.xxhash64(text).alias("w1"), F.xxhash64(F.lit(3), text).alias("w2"), F.coalesce(~text.rlike(_WORD), F.lit(True)).alias("none"),
                            *[documents[c].alias(n) for c, n in zip(documents.columns, names)])
    # of each class one key; rows without a word are classes by themselves
    heads = classes(documents, similarity).where((F.col("head.w1") == F.col("w1")) & (F.col("head.w2") == F.col("w2")))
    kept = keys.where(~F.col("none")).join(heads.select(F.col("head.doc").alias("doc"), "w1", "w2").hint("merge"), ["doc", "w1", "w2"], "left_semi")
    rows = kept.unionByName(keys.where("none"))
    return rows.select(*[F.col(n).alias(c) for c, n in zip(documents.columns, names)])
