"""Queries over runs: the events of a user are a run, its days are epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.rand import u
from cohortlab.operators import groups as G
from cohortlab.operators import metrics as M
from cohortlab.operators import runs as R
from cohortlab.plans.registry import query
from cohortlab.plans.tables import LAB, SPACE, labelled, r6, table, u_sql
from cohortlab.scratch import fresh_path
from cohortlab.sources import files


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.groupBy("user_id", F.dayofmonth("ts").alias("epoch")).agg(
        F.round(F.avg("value"), 0).cast("long").alias("average")
    )


EPOCHS = "ep AS (SELECT user_id, day(ts)::INTEGER AS epoch, round(avg(value), 0)::BIGINT AS average FROM events GROUP BY ALL)"


@query(f"""
WITH {EPOCHS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY average DESC, epoch) AS k FROM ep)
SELECT user_id, epoch AS best_epoch, average AS best_value FROM r WHERE k = 1""")
def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return R.best_epoch(epochs(spark, sf), ["user_id"], "average")


@query(f"""
WITH RECURSIVE {EPOCHS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS k FROM ep),
w(user_id, k, epoch, best, wait) AS (
  SELECT user_id, k, epoch, average, 0 FROM o WHERE k = 1
  UNION ALL
  SELECT o.user_id, o.k, o.epoch, greatest(w.best, o.average), CASE WHEN o.average > w.best THEN 0 ELSE w.wait + 1 END
  FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, min(epoch) FILTER (wait >= 3) AS stop_epoch, max(epoch) AS last_epoch FROM w GROUP BY user_id""")
def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    return R.early_stop(epochs(spark, sf), ["user_id"], "average")


NATURAL = """array_to_string([CASE WHEN p ~ '^[0-9]' THEN lpad(p, 20, '0') ELSE p END
  FOR p IN regexp_extract_all(lower({0}), '[0-9]+|[^0-9]+')], '')"""


@query(f"""
SELECT url, row_number() OVER (ORDER BY {NATURAL.format('url')}, url) AS place FROM pages""")
def natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses in natural order; the place is counted after the sort."""
    from cohortlab.operators.ordering import dense_index

    keyed = table(spark, sf, "pages").select("url", R.natural_key(F.col("url")).alias("k"))
    return dense_index(keyed, ["k", "url"], "i").select("url", (F.col("i") + 1).alias("place"))


CHECKPOINTS = "ck AS (SELECT o_custkey, 'step_' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '.json' ELSE '.bin' END AS file FROM orders)"


@query(f"""
WITH {CHECKPOINTS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {NATURAL.format('file')} DESC, file DESC) AS k
  FROM ck WHERE file LIKE '%.bin%')
SELECT o_custkey, file, CASE WHEN k = 1 THEN 'final' WHEN k <= 2 THEN 'keep' ELSE 'delete' END AS action FROM r""")
def retain_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as checkpoint files, customers as runs."""
    suffix = F.when(F.col("o_orderstatus") == "P", ".json").otherwise(".bin")
    files_of = table(spark, sf, "orders").select(
        "o_custkey", F.concat(F.lit("step_"), F.col("o_orderkey").cast("string"), suffix).alias("file")
    )
    return R.retain_latest(files_of, ["o_custkey"])


@query("""
WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, value, value * value AS sq FROM events),
c AS (SELECT user_id, step, avg(value) OVER w AS loss, avg(sq) OVER w AS att FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step))
SELECT user_id, step, round(loss, 9) AS loss, round(att, 9) AS att_loss FROM c WHERE (step + 1) % 10 = 0""")
def training_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as steps, reported at every tenth."""
    from pyspark.sql import Window

    steps = table(spark, sf, "events").select(
        "user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("step"),
        F.col("value").alias("loss"), (F.col("value") * F.col("value")).alias("att_loss"),
    )
    out = R.training_curve(steps, ["user_id"], "step", ["loss", "att_loss"], 10)
    # nine digits: means of a multiple of ten hundredths can end in a five at the seventh
    return out.withColumns({c: F.round(c, 9) for c in ("loss", "att_loss")})


RUNS = f"""
runs AS (
  SELECT m.method, m.setting, s.seed, doc_id, y, g,
         CASE WHEN {u_sql('m.method', 's.seed', 'doc_id')} < m.rate THEN y ELSE 1 - y END AS pred
  FROM lab, (VALUES ('base', NULL, 0.9::DOUBLE), ('up', '20', 0.7::DOUBLE)) m(method, setting, rate), (VALUES (1), (2), (3), (4), (5)) s(seed)),
acc AS (SELECT method, setting, seed, g, count(*) AS n, avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS a FROM runs GROUP BY ALL)"""


def written_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Write predictions of two methods and five seeds to their folders and load them back."""
    root = fresh_path(spark, "runs")
    df = G.assign_group(labelled(spark, sf), SPACE)
    for method, setting, rate in (("base", None, 0.9), ("up", "20", 0.7)):
        for seed in R.SEEDS:
            right = u(method, seed, F.col("doc_id")) < rate
            scored = df.withColumn("pred", F.when(right, F.col("y")).otherwise(1 - F.col("y")))
            files.write_predictions(scored, f"{root}/{R.run_path('documents', method, setting, seed)}/predictions.csv")
    return files.load_runs(spark, root)


@query(f"""
WITH {LAB}, {RUNS}
SELECT 'documents' AS data, method, setting, seed, g, pred, y, count(*) AS n FROM runs GROUP BY ALL""")
def load_runs(spark: SparkSession, sf: str) -> DataFrame:
    return written_runs(spark, sf).groupBy("data", "method", "setting", "seed", "g", "pred", "y").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(f"""
WITH {LAB}, {RUNS},
s AS (SELECT method, setting, seed, sum(n * a) / sum(n) AS average_acc,
             CASE WHEN count(*) < 4 THEN 0.0 ELSE min(a) END AS worst_acc FROM acc GROUP BY method, setting, seed)
SELECT 'documents' AS data, method, setting, count(*) AS n_seeds, round(avg(average_acc), 6) AS average_acc_mean,
       round(stddev_samp(average_acc), 6) AS average_acc_std, round(avg(worst_acc), 6) AS worst_acc_mean,
       round(stddev_samp(worst_acc), 6) AS worst_acc_std
FROM s GROUP BY method, setting""")
def seed_summary(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["data", "method", "setting", "seed"]
    rows = written_runs(spark, sf).withColumns({"loss": F.lit(0.0), "correct": (F.col("pred") == F.col("y")).cast("int")})
    per_run = M.robustness_summary(M.group_metrics(rows, SPACE, by=keys), by=keys)
    out = R.seed_summary(per_run, keys[:-1], ["average_acc", "worst_acc"])
    return out.withColumns({c: r6(c) for c in out.columns if c.endswith(("_mean", "_std"))})
