"""The input tables, the columns derived from them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators.groups import GroupSpace, Recipe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a table is stored in fewer pieces than there are cores.

    A table with enough pieces, as any large one has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels: y, c, split code, logits and batch number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    key = F.col("doc_id")
    bucket = F.pmod(key, F.lit(10))
    z0 = (F.pmod(key * 31, F.lit(89)) - 44) / F.lit(16.0)
    z1 = (F.pmod(F.col("n_chars"), F.lit(97)) - 48) / F.lit(16.0)
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", "n_chars",
        F.col("quality").alias("y"), F.col("toxic").alias("c"),
        F.when(bucket < 8, 0).when(bucket == 8, 1).otherwise(2).alias("split"),
        F.array(z0, z1).alias("logits"),
        F.floor(key / 64).cast("long").alias("batch"),
    )


# y and c are binary in the label table
SPACE = GroupSpace(2, 2)
RECIPE = Recipe("y", ("c",))

LAB = """
lab AS (
  SELECT d.doc_id, d.lang, d.n_chars, l.quality AS y, l.toxic AS c, l.quality * 2 + l.toxic AS g,
         CASE WHEN d.doc_id % 10 < 8 THEN 0 WHEN d.doc_id % 10 = 8 THEN 1 ELSE 2 END AS split,
         ((d.doc_id * 31 % 89) - 44) / 16.0::DOUBLE AS z0, ((d.n_chars % 97) - 48) / 16.0::DOUBLE AS z1,
         d.doc_id // 64 AS batch
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""
SCORED = LAB + """,
scored AS (
  SELECT *, CASE WHEN z0 >= z1 THEN 0 ELSE 1 END AS pred,
         greatest(z0, z1) + ln(exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1)))
           - CASE WHEN y = 0 THEN z0 ELSE z1 END AS loss,
         CASE WHEN (CASE WHEN z0 >= z1 THEN 0 ELSE 1 END) = y THEN 1 ELSE 0 END AS correct
  FROM lab
)"""
GROUPS = SCORED + """,
groups AS (
  SELECT k.g, count(s.doc_id) AS n, coalesce(avg(s.loss), 0) AS avg_loss, coalesce(avg(s.correct), 0) AS avg_acc
  FROM range(4) k(g) LEFT JOIN scored s ON s.g = k.g GROUP BY k.g
)"""


def r6(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), 6)


def u_sql(*keys: object) -> str:
    """The SQL text of the same random number; string keys are SQL expressions."""
    joined = ", ".join(f"({k})::VARCHAR" if isinstance(k, str) else f"'{k}'" for k in keys)
    return f"(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
