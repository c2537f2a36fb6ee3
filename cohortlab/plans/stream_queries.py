"""The event table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.plans.registry import query
from cohortlab.plans.tables import r6, table
from cohortlab.scratch import fresh_path
from cohortlab.streaming import group_metrics as S


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scored rows: the type is the group, the value is the loss."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(
        "ts", F.col("event_type").alias("g"), F.col("value").alias("loss"), (F.col("value") > 30).cast("int").alias("correct")
    )


@query("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS g, count(*) AS n, round(avg(value), 6) AS avg_loss,
       round(avg(CASE WHEN value > 30 THEN 1 ELSE 0 END), 6) AS avg_acc
FROM events GROUP BY 1, 2""")
def stream_windowed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = S.run_available(S.windowed_metrics(event_stream(spark, sf)), ["window_start", "g"])
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "g", "n", r6("avg_loss").alias("avg_loss"),
        r6("avg_acc").alias("avg_acc"),
    )


@query("""
SELECT event_type AS g, count(*) AS n, round(avg(value), 6) AS avg_loss,
       round(avg(CASE WHEN value > 30 THEN 1 ELSE 0 END), 6) AS avg_acc FROM events GROUP BY 1""")
def stream_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    out = S.run_available(S.running_totals(event_stream(spark, sf)), ["g"])
    return out.select("g", "n", r6("avg_loss").alias("avg_loss"), r6("avg_acc").alias("avg_acc"))


@query("""
WITH RECURSIVE m AS (
  SELECT event_type AS g, day(ts) AS batch, count(*) AS n, sum(value) AS s, sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) AS c,
         row_number() OVER (PARTITION BY event_type ORDER BY day(ts)) AS t
  FROM events GROUP BY 1, 2),
walk AS (
  SELECT g, t, s / n AS e, n, s, c FROM m WHERE t = 1
  UNION ALL
  SELECT m.g, m.t, 0.9::DOUBLE * w.e + 0.1::DOUBLE * m.s / m.n, w.n + m.n, w.s + m.s, w.c + m.c
  FROM walk w JOIN m ON m.g = w.g AND m.t = w.t + 1)
SELECT g, round(max_by(e, t), 6) AS exp_loss, max(t) AS batches, max(n)::BIGINT AS n, round(max_by(s / n, t), 6) AS avg_loss,
       round(max_by(c / n, t), 6) AS avg_acc
FROM walk GROUP BY g""")
def stream_ema(spark: SparkSession, sf: str) -> DataFrame:
    """Averages by day of the month from a table stored in four files, whose rows are in no order: one micro-batch each."""
    events = table(spark, sf, "events")
    rows = events.select(
        F.dayofmonth("ts").alias("batch"), F.col("event_type").alias("g"), F.col("value").alias("loss"),
        (F.col("value") > 30).cast("int").alias("correct"))
    path = fresh_path(spark, "scored")
    rows.repartition(4, F.xxhash64(*rows.columns)).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = S.ema_totals(stream)
    return out.select("g", r6("exp_loss").alias("exp_loss"), "batches", "n", r6("avg_loss").alias("avg_loss"), r6("avg_acc").alias("avg_acc"))
