"""Mixing of sources to target weights: iterative proportional fitting, in DataFrame functions only.

Documents fall into cells by source, language and topic. The default targets
flatten each margin: a share s becomes s**FLATTEN, scaled so that PART of all tokens is
drawn. A value whose target is above all the tokens it has gets these, and the
other values of its margin share the rest. Starting from PART, the weights of the
cells are raked to one margin after the other; what a weight above 1 cannot draw counts as
missing, so that the other cells of the margin make up for it. The weight, at most 1, is the
probability that a document of the cell is sampled.

The topic is the layout of the text: ``symbols`` if at least a twentieth of the
characters are signs, ``lines`` if there is a line break in every 200
characters, else ``prose``.

Defined cases: null source or lang count as the empty name; a null or empty
text has no token and the topic ``prose``; a margin without tokens keeps its
factor; rows that repeat an id are drawn alike; an empty table gives no rows.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.functions.rand import u
from cohortlab.functions.sizing import broadcast_if_small, fits
from cohortlab.plans.tables import u_sql
from cohortlab.scratch import materialize, release

MARGINS = ("src", "lng", "topic")
FLATTEN = 0.7
ROUNDS = 8
#: Share of all tokens that is drawn, and steps to find the scale for it.
PART = 0.5
STEPS = 12
#: So few cells are raked in one partition, without shuffles; their number follows the sources and languages, not the documents.
FEW_CELLS = 10_000


def topic_of(text: Column) -> Column:
    size = F.char_length(text)
    # a match takes a whole run, or else every character would cost one
    signs = F.char_length(F.regexp_replace(text, r"[^!-/:-@\[-`{-~]+", ""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when((size > 0) & (signs * 20 >= size), "symbols").when((size > 0) & (breaks * 200 >= size), "lines").otherwise("prose")


def described(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    # a word and the white space after it become one character
    words = F.char_length(F.regexp_replace(F.ltrim(text, F.lit(" \t\n\r")), r"[^ \t\n\r]+[ \t\n\r]*", "w"))
    return documents.select(
        F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lng"), topic_of(text).alias("topic"),
        words.cast("long").alias("n_tokens"),
    )


def default_targets(cells: DataFrame, part: float = PART) -> dict[str, DataFrame]:
    """For each margin its values and the tokens to draw of them, never more than there are."""
    targets, few = {}, fits(cells, FEW_CELLS)
    cells = cells.coalesce(1) if few else cells
    for margin in MARGINS:
        sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens"))
        # wanted of every token, up to a scale for the whole margin
        wanted = materialize(sums.select(
            margin, "tokens", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(FLATTEN)) / F.col("tokens")).otherwise(0.0).alias("factor")), "wanted")
        scale = calibrated_scale(wanted.coalesce(1) if few else wanted, part)
        targets[margin] = materialize(
            wanted.select(margin, (F.col("tokens") * F.least(F.col("factor") * scale, F.lit(1.0))).alias("target")), f"target-{margin}")
    return targets


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, part: float = PART) -> DataFrame:
    """Cells with ``factor``: tokens * least(factor, 1) has the target margins, up to the precision of the rounds.

    ``cells`` has one row for each source, language and topic that occur together.
    """
    targets, few = targets or default_targets(cells, part), fits(cells, FEW_CELLS)
    # every cell carries its three targets, so that a step joins nothing but the sums of one margin
    now = cells.select(*MARGINS, "tokens", F.lit(part).alias("factor"))
    for margin in MARGINS:
        now = now.join(targets[margin].withColumnRenamed("target", f"to_{margin}"), margin)
    now = materialize(now, "targets")
    for _ in range(rounds):
        before = now
        now = before.coalesce(1) if few else before
        for margin in MARGINS:
            drawn = F.sum(F.col("tokens") * F.least(F.col("factor"), F.lit(1.0)))
            target = F.col(f"to_{margin}")
            # in one partition a window needs no shuffle; many cells are summed up first, or else a value would have all of its cells in one task
            summed = now.withColumn("has", drawn.over(Window.partitionBy(margin))) if few else now.join(
                now.groupBy(margin).agg(drawn.alias("has")), margin)
            now = summed.withColumn(
                "factor", F.when(F.col("has") > 0, F.col("factor") * target / F.col("has")).otherwise(F.col("factor"))).drop("has")
        now = materialize(now, "raked")
        release(before)
    return now.select(*MARGINS, "tokens", "factor")


def calibrated_scale(factors: DataFrame, part: float = PART, steps: int = STEPS) -> float:
    """The number c for which min(1, c * factor) draws ``part`` of all tokens.

    Each step gives the rows that are drawn whole their tokens and scales the others to the rest.
    """
    scale, before = 0.0, -1.0
    for _ in range(steps):
        if scale == before:
            break
        full = F.col("factor") * scale >= 1.0
        rest, mass = factors.agg(
            F.sum("tokens") * part - F.sum(F.when(full, F.col("tokens")).otherwise(0)),
            F.sum(F.when(~full, F.col("tokens") * F.col("factor"))),
        ).first()
        scale, before = (rest / mass if mass else 1.0), scale
    return scale


def sampled(documents: DataFrame) -> DataFrame:
    """Every document with its cell, sampling probability and whether it is drawn."""
    # texts are measured once; what follows reads a few numbers for each document
    rows = materialize(described(documents), "described")
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    chances = materialize(
        rake(cells).select(*MARGINS, F.round(F.least(F.col("factor"), F.lit(1.0)), 9).alias("prob")), "chances")

    return rows.join(broadcast_if_small(chances, 100_000), list(MARGINS)).select(
        "doc_id", F.col("src").alias("source_name"), F.col("lng").alias("language"), "topic", "n_tokens", "prob",
        (u(4, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) < F.col("prob")).alias("drawn"),
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_drawn(documents: DataFrame) -> DataFrame:
    """The drawn documents with all their columns."""
    drawn = sampled(documents).where("drawn").select(F.col("doc_id").alias("_id")).distinct()
    return documents.join(drawn, documents["doc_id"].eqNullSafe(drawn["_id"]), "left_semi")


def _oracle() -> str:
    targets, steps, name = [], [], "f0"
    for m in MARGINS:
        targets.append(f"""w_{m} AS MATERIALIZED (SELECT {m}, tokens, CASE WHEN tokens > 0 THEN pow(tokens, {FLATTEN}) / tokens ELSE 0.0 END::DOUBLE AS factor
  FROM (SELECT {m}, sum(tokens)::DOUBLE AS tokens FROM cells GROUP BY {m})), s_{m}_0 AS (SELECT 0.0::DOUBLE AS c)""")
        targets += [f"""s_{m}_{i + 1} AS MATERIALIZED (SELECT coalesce((sum(tokens) * {PART} - coalesce(sum(tokens) FILTER (factor * c >= 1.0), 0))
  / nullif(sum(tokens * factor) FILTER (factor * c < 1.0), 0), 1.0)::DOUBLE AS c FROM w_{m}, s_{m}_{i})""" for i in range(STEPS)]
        targets.append(f"t_{m} AS MATERIALIZED (SELECT {m}, tokens * least(factor * c, 1.0) AS target FROM w_{m}, s_{m}_{STEPS})")
    for i in range(ROUNDS):
        for j, margin in enumerate(MARGINS):
            new = f"f{i * len(MARGINS) + j + 1}"
            steps.append(f"""{new} AS MATERIALIZED (
  SELECT c.src, c.lng, c.topic, c.tokens,
         CASE WHEN s.has > 0 THEN c.factor * t.target / s.has ELSE c.factor END AS factor
  FROM {name} c JOIN (SELECT {margin}, sum(tokens * least(factor, 1.0)) AS has FROM {name} GROUP BY {margin}) s USING ({margin})
  JOIN t_{margin} t USING ({margin}))""")
            name = new
    return f"""
WITH x AS (
  SELECT doc_id, coalesce(source, '') AS src, coalesce(lang, '') AS lng, coalesce(text, '') AS text FROM documents
), measured AS (
  SELECT doc_id, src, lng, length(text) AS size,
         length(regexp_replace(text, '[^!-/:-@\\[-`{{-~]', '', 'g')) AS signs,
         length(text) - length(replace(text, chr(10), '')) AS breaks,
         length(regexp_replace(regexp_replace(text, '[^ \\t\\n\\r]+', 'w', 'g'), '[ \\t\\n\\r]+', '', 'g')) AS n_tokens
  FROM x
), docs AS MATERIALIZED (
  SELECT doc_id, src, lng, n_tokens,
         CASE WHEN size > 0 AND signs * 20 >= size THEN 'symbols'
              WHEN size > 0 AND breaks * 200 >= size THEN 'lines' ELSE 'prose' END AS topic
  FROM measured
), cells AS MATERIALIZED (
  SELECT src, lng, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL
), {", ".join(targets)},
f0 AS (SELECT *, {PART}::DOUBLE AS factor FROM cells),
{", ".join(steps)},
chances AS (
  SELECT src, lng, topic, round(least(factor, 1.0), 9) AS prob FROM {name})
SELECT d.doc_id, d.src AS source_name, d.lng AS language, d.topic, d.n_tokens, c.prob,
       {u_sql(4, "coalesce(d.doc_id::VARCHAR, '')")} < c.prob AS drawn
FROM docs d JOIN chances c ON d.src = c.src AND d.lng = c.lng AND d.topic = c.topic
"""


ORACLE_SQL = _oracle()
