"""Fingerprints of closed syncmers, in DataFrame functions only.

The alphabet is short pieces of text: lower-case letters with the capital before
them, digits, and every other character by itself, white space aside (PIECE).
Where a piece ends depends on the characters around it, so scripts without
blanks and long words without them have pieces as well. Of every k
pieces in a row, the hashes of the inner runs of s pieces are compared; the k-mer is
an anchor if the smallest of them stands at either edge. Whether a k-mer is an
anchor depends on its own pieces only, so equal passages have equal anchors
wherever they stand. The k-mer at the smallest run of the whole text is an
anchor of every text. A fingerprint is the sorted set of the anchors' hashes;
the likeness of two fingerprints is the share of common anchors (Jaccard).

Defined cases: a text of fewer than k pieces, null and empty ones included, has
one anchor made of all its pieces; equal texts have equal fingerprints; ties
for the smallest hash count at an edge if an edge is among them; rows that
repeat an id are ordered by a hash of their text; a single row is its own
neighbour; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, S = 8, 4
PIECE = r"\p{Lu}?\p{Ll}{1,12}|\p{Nd}{1,4}|[^\x20\x09-\x0D]"
_LEAST = -(1 << 63)


def with_anchors(rows: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """``rows`` with column ``out``: the sorted distinct anchor hashes of column ``text``.

    Each step is a column of its own, so that no array is computed twice. Two
    runs of s pieces cover a k-mer, so their hashes name it.
    """
    if not s < k <= 2 * s:
        raise ValueError("two runs of s pieces must cover a k-mer")
    w, h = f"_{out}_w", f"_{out}_h"
    inner = k - s + 1
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0))
    rows = rows.withColumn(w, F.transform(pieces, lambda x: F.xxhash64(x)))
    rows = rows.withColumn(h, F.when(F.size(w) >= k, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - s, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(s)]))))

    def named(i: Column) -> Column:
        return F.hash(F.get(h, i), F.get(h, i + (inner - 1)))

    def anchor(i: Column) -> Column:
        edges = F.least(F.get(h, i), F.get(h, i + (inner - 1)))
        between = [F.get(h, i + j) for j in range(1, inner - 1)]
        inside = F.least(*between) if len(between) > 1 else between[0] if between else edges
        return F.when(edges <= inside, named(i))

    last = F.size(h) - inner
    least = F.least((F.array_position(h, F.array_min(h)) - 1).cast("int"), last)
    found = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), anchor), lambda x: x.isNotNull())
    whole = F.when(F.col(h).isNotNull(), F.concat(found, F.array(named(least)))).otherwise(F.array(F.hash(w)))
    return rows.withColumn(out, F.array_sort(F.array_distinct(whole))).drop(w, h)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Common anchors over all anchors; two empty sets are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.greatest(both, F.lit(1)))


def as_text(anchors: str | Column) -> Column:
    """Eight hexadecimal digits for each anchor, without separators."""
    column = F.col(anchors) if isinstance(anchors, str) else anchors
    return F.array_join(F.transform(column, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def cut_points(rows: DataFrame, key: str, tie: str) -> list[tuple[int, int]]:
    """(key, tie) pairs that cut the rows into about as many even ranges as there are shuffle partitions.

    A key that fills several ranges is cut at quantiles of its ties.
    """
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / pieces for i in range(1, pieces)] or [0.5]
    keys = rows.select(F.percentile_approx(key, shares, 10_000).alias("c")).first()[0] or []
    cuts = {(k, _LEAST) for k in keys}
    hot = sorted({k for k in keys if keys.count(k) > 1})  # fewer than ``pieces``
    if hot:
        ties = rows.where(F.col(key).isin(hot)).groupBy(key).agg(F.percentile_approx(tie, shares, 10_000)).collect()
        for k, found in ties:
            step = max(1, len(found) // keys.count(k))
            cuts |= {(k, t) for t in found[::step]}
    return sorted(cuts)


def with_next(rows: DataFrame, key: str, tie: str, cuts: list[tuple[int, int]], values: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(rows)`` with ``next``, a struct of the ``values`` of the row that follows in descending (key, tie); the last takes the first.

    The rows are cut into ranges, and the last row of a range is followed by a copy of
    the first row of the next range that has any, so that one window finds all successors.
    """
    place = F.struct(F.col(key), F.col(tie))
    pair = "struct<k:bigint,t:bigint>"
    borders = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).cast("long").alias("t")) for k, t in cuts]).cast(f"array<{pair}>")
    ranged = rows.withColumn("_range", F.aggregate(borders, F.lit(0), lambda n, x: n + (x < place.cast(pair)).cast("int")))
    # one row for each range
    heads = ranged.groupBy("_range").agg(F.max(place).alias("h")).select("_range", F.col(f"h.{key}").alias("_k"), F.col(f"h.{tie}").alias("_t")).collect()
    ranges = sorted((r["_range"] for r in heads), reverse=True)
    before = {b: a for a, b in zip(ranges, ranges[1:] + ranges[:1], strict=True)}
    first = rows.sparkSession.createDataFrame([(before[r["_range"]], r["_k"], r["_t"]) for r in heads], "_range int, _k long, _t long")
    # rows that repeat an id and text are the same head
    copies = rows.join(F.broadcast(first), (F.col(key) == F.col("_k")) & (F.col(tie) == F.col("_t"))).dropDuplicates(["_range"])
    both = make(ranged).withColumn("_copy", F.lit(False)).unionByName(make(copies.select(*ranged.columns)).withColumn("_copy", F.lit(True)))
    window = Window.partitionBy("_range").orderBy("_copy", F.col(key).desc(), F.col(tie).desc())
    return both.withColumn("next", F.lead(F.struct(*values)).over(window)).where("NOT _copy").drop("_range", "_copy")


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """The fingerprints of every text and of its edited text, whose last third comes from the next document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"_key": F.coalesce("doc_id", F.lit(_LEAST)), "_tie": F.xxhash64("text")})
    cuts = cut_points(rows, "_key", "_tie")
    # the anchors go with their text, so that they are found once
    rows = with_next(rows, "_key", "_tie", cuts, ["text", "own"], lambda r: with_anchors(r, "text", "own"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("other"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next.text", F.lit(1), cut)).alias("edited"))
    return with_anchors(rows, "edited", "new").select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"), as_text("new").alias("edited_fingerprint"),
        likeness("own", "new").alias("near_edited"), likeness("own", "other").alias("near_next"),
    )
