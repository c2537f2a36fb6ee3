"""Lines that many documents share, removed with levelled sorted runs of line hashes.

Each batch of documents becomes one row for each line key, with the number of
documents and the largest id. It is anti-joined with the runs before it: the lines
that were never seen before become a run, sorted by their hash, and the others are
updates of lines that a run has. So every line is in exactly one run, and only
lines that came again are counted. When a level holds ``fanout`` runs they are
merged into one of the next level.

Defined cases: a null or empty text is one empty line; a null id counts as one
document that is smaller than any other; rows that repeat an id count as one
document, and each row loses its own lines; an empty table gives no rows. Only
``doc_id`` and ``text`` are read, further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cohortlab.llm.skew import weighted_join
from cohortlab.scratch import fresh_path, materialize, release

MIN_CHARS = 20
MIN_DOCS = 3
#: Batches that one whole table is dealt into, and runs of a level that are merged.
BATCHES = 4
FANOUT = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAST = -(1 << 63)
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def line_rows(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line with a long enough key: doc, body (hash of the text), pos, h1, h2."""
    return (
        documents.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc"),
            F.xxhash64("text").alias("body"),
            F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"),
        )
        .select("doc", "body", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


class LineRuns:
    """Runs of line hashes in levels; every run is a Parquet table sorted by hash."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.updates: list[DataFrame] = []

    def _store(self, run: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, "line-run")
        run.sortWithinPartitions(*_HASH).write.parquet(path)
        return self.spark.read.schema(run.schema).parquet(path)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose line is in no run."""
        for run in self.runs():
            rows = rows.join(run.select(*_HASH).hint("merge"), _HASH, "left_anti")
        return rows

    def add(self, rows: DataFrame) -> DataFrame:
        """Add the part of a batch of line rows that no earlier run has as a run, and return it; the rest are updates.

        A document has to be whole in one batch.
        """
        batch = (
            rows.select(*_HASH, "doc").distinct()
            .groupBy(*_HASH).agg(F.count("*").alias("docs"), F.max("doc").alias("last"))
        )
        first = not self.levels
        batch = self._store(batch) if first else materialize(batch, "line-batch")
        if first:
            fresh = batch
        else:
            fresh = self._store(self.unseen(batch))
            self.updates.append(materialize(batch.join(fresh.select(*_HASH).hint("merge"), _HASH, "left_anti"), "line-updates"))
            release(batch)
        self._push(0, fresh)
        return fresh

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._store(self._merged(self.levels[level]))
            self.levels[level] = []
            self._push(level + 1, merged)

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """No line is in two runs."""
        return self._union(runs).repartition(*[F.col(h) for h in _HASH])

    def shared(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """Lines of at least ``min_docs`` documents: h1, h2, docs, last."""
        rows = self._union(self.runs())
        if self.updates:
            more = self._union(self.updates).groupBy(*_HASH).agg(F.sum("docs").alias("_docs"), F.max("last").alias("_last"))
            rows = rows.join(more, _HASH, "left").select(
                *_HASH, (F.col("docs") + F.coalesce("_docs", F.lit(0))).alias("docs"), F.greatest("last", "_last").alias("last"))
        return rows.where(F.col("docs") >= min_docs)


def dropped_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                  batches: int = BATCHES) -> DataFrame:
    """For every document that loses lines: doc, body and the sorted positions ``drop``."""
    spark = documents.sparkSession
    path = fresh_path(spark, "lines")
    rows = line_rows(documents, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    rows.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    runs = LineRuns(spark)
    for batch in range(batches):
        runs.add(stored.where(F.col("batch") == batch))
    shared = materialize(runs.shared(min_docs), "shared-lines")
    found = weighted_join(stored.drop("batch"), shared, _HASH, "docs", stored.count())
    return (
        found.where(F.col("doc") < F.col("last"))
        .groupBy("doc", "body").agg(F.array_sort(F.collect_set("pos")).alias("drop"))
    )


@F.pandas_udf(StringType())
def _without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, drop in parts:
        out = []
        for t, d in zip(text, drop, strict=True):
            if d is not None and t is not None:
                gone = set(d)
                t = "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)
            out.append(t)
        yield pd.Series(out, dtype=object)


def _joined(documents: DataFrame, **limits: int) -> DataFrame:
    """All rows as a struct ``row`` with the positions ``drop`` of the lines they lose (null: none)."""
    drops = dropped_lines(documents, **limits)
    rows = documents.select(
        F.struct(*[documents[c] for c in documents.columns]).alias("row"),
        F.coalesce(documents["doc_id"].cast("long"), F.lit(_LEAST)).alias("doc"),
        F.xxhash64(documents["text"]).alias("body"),
    )
    return rows.join(drops, ["doc", "body"], "left").select("row", "drop")


def drop_shared_lines(documents: DataFrame, **limits: int) -> DataFrame:
    """The documents with all their columns, their texts without the shared lines; null texts stay null."""
    columns = [
        _without(F.col("row.text"), F.col("drop")).alias(c) if c == "text" else F.col("row").getField(c).alias(c)
        for c in documents.columns
    ]
    return _joined(documents, **limits).select(*columns)


def with_char_counts(documents: DataFrame) -> DataFrame:
    """``n_chars`` set to the length of the text, where there is such a column."""
    if "n_chars" not in documents.columns:
        return documents
    kind = documents.schema["n_chars"].dataType
    return documents.withColumn("n_chars", F.char_length("text").cast(kind))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return _joined(documents).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        _without(text, F.col("drop")).alias("kept"),
    ).select("doc_id", "n_lines", F.when(F.col("n_dropped") < 0, 0).otherwise(F.col("n_dropped")).alias("n_dropped"),
             F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, (s.last IS NOT NULL AND k.doc_id < s.last) AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
