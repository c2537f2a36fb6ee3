"""Queries over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import groups as G
from cohortlab.operators import metrics as M
from cohortlab.plans.registry import query
from cohortlab.plans.tables import GROUPS, LAB, SCORED, SPACE, labelled, r6, table


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return M.score_rows(G.assign_group(labelled(spark, sf), SPACE))


def _r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


@query(f"WITH {SCORED} SELECT doc_id, pred FROM scored")
def predict(spark: SparkSession, sf: str) -> DataFrame:
    return M.predict(labelled(spark, sf)).select("doc_id", "pred")


@query("""
WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT label AS k, avg(v) AS v, i FROM (SELECT label, unnest(e) AS v, unnest(range(1, len(e) + 1)) AS i FROM x)
      GROUP BY label, i),
z AS (SELECT x.vec_id, m.k, sum(round(x.e[m.i] * 65536) * round(m.v * 65536)) AS s FROM x, m GROUP BY x.vec_id, m.k)
SELECT vec_id, arg_max(k, (s, -k))::INTEGER AS pred FROM z GROUP BY vec_id""")
def predict_ten_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Ten logits per vector: dot products with the mean vector of each label.

    Factors are scaled to integers first, so sums do not depend on their order.
    """
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    dims = vectors.select("label", F.posexplode("embedding").alias("dim", "v"))
    means = dims.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centre = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: F.round(s["v"] * 65536)).alias("m")
    )
    # one row for all labels: labels x dimensions numbers, independent of the number of vectors
    stacked = centre.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "m"))), lambda s: s["m"]).alias("ms"))
    scaled = F.transform("embedding", lambda v: F.round(v.cast("double") * 65536))

    def dot(m):
        return F.aggregate(F.zip_with(scaled, m, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)

    logits = vectors.withColumn("ms", stacked.scalar()).select("vec_id", F.transform("ms", dot).alias("logits"))
    return M.predict(logits).select("vec_id", "pred")


@query(f"WITH {SCORED} SELECT doc_id, round(loss, 6) AS loss FROM scored")
def sample_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(M.sample_loss(labelled(spark, sf)).select("doc_id", "loss"), "loss")


@query(f"""
WITH {LAB}
SELECT doc_id, round(greatest(0, 1 - (CASE WHEN y = 1 THEN z1 - z0 ELSE z0 - z1 END)), 6) AS loss FROM lab""")
def sample_loss_custom(spark: SparkSession, sf: str) -> DataFrame:
    """A hinge loss passed in by the caller."""
    def hinge(logits, y):
        margin = F.element_at(logits, 2) - F.element_at(logits, 1)
        return F.greatest(F.lit(0.0), 1 - F.when(y == 1, margin).otherwise(-margin))

    return _r6(M.sample_loss(labelled(spark, sf), loss=hinge).select("doc_id", "loss"), "loss")


@query(f"WITH {GROUPS} SELECT g::INTEGER AS g, n, round(avg_loss, 6) AS avg_loss, round(avg_acc, 6) AS avg_acc FROM groups")
def group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(M.group_metrics(scored(spark, sf), SPACE), "avg_loss", "avg_acc")


@query(f"""
WITH {GROUPS}
SELECT sum(n)::BIGINT AS n, round(sum(n * avg_acc) / sum(n), 6) AS average_acc, round(min(avg_acc), 6) AS worst_acc,
       round(sum(n * avg_loss) / sum(n), 6) AS average_loss
FROM groups""")
def robustness_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = M.robustness_summary(M.group_metrics(scored(spark, sf), SPACE))
    return _r6(out, "average_acc", "worst_acc", "average_loss")


@query(f"""
WITH {SCORED}, k AS (
  SELECT split, g, count(*) AS n, avg(loss) AS avg_loss, avg(correct) AS avg_acc FROM scored GROUP BY split, g)
SELECT split, sum(n)::BIGINT AS n, round(sum(n * avg_acc) / sum(n), 6) AS average_acc, round(min(avg_acc), 6) AS worst_acc,
       round(sum(n * avg_loss) / sum(n), 6) AS average_loss
FROM k GROUP BY split""")
def robustness_summary_by_split(spark: SparkSession, sf: str) -> DataFrame:
    per_group = M.group_metrics(scored(spark, sf), SPACE, by=["split"])
    out = M.robustness_summary(per_group, by=["split"], ignore_empty=True)
    return _r6(out, "average_acc", "worst_acc", "average_loss")


@query(f"""
WITH {SCORED}, k AS (
  SELECT batch, g, count(*) AS n, avg(loss) AS avg_loss, avg(correct) AS avg_acc FROM scored GROUP BY batch, g)
SELECT batch, sum(n)::BIGINT AS n, round(sum(n * avg_acc) / sum(n), 6) AS average_acc,
       round(CASE WHEN count(*) < 4 THEN 0.0 ELSE min(avg_acc) END, 6) AS worst_acc,
       round(sum(n * avg_loss) / sum(n), 6) AS average_loss
FROM k GROUP BY batch""")
def robustness_summary_by_run(spark: SparkSession, sf: str) -> DataFrame:
    """Batches stand for runs; a run without any row of a group has a worst accuracy of 0."""
    per_group = M.group_metrics(scored(spark, sf), SPACE, by=["batch"])
    return _r6(M.robustness_summary(per_group, by=["batch"]), "average_acc", "worst_acc", "average_loss")


RUNNING = SCORED + """,
b AS (SELECT g, batch, count(*) AS n, sum(loss) AS loss_sum, sum(correct) AS correct_sum FROM scored GROUP BY g, batch)"""


@query(f"""
WITH {RUNNING}
SELECT g, batch, (sum(n) OVER w)::BIGINT AS processed, (count(*) OVER w)::BIGINT AS batches,
       round(sum(loss_sum) OVER w / sum(n) OVER w, 6) AS avg_loss,
       round(sum(correct_sum) OVER w / sum(n) OVER w, 6) AS avg_acc
FROM b WINDOW w AS (PARTITION BY g ORDER BY batch)""")
def running_group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(M.running_group_metrics(scored(spark, sf)), "avg_loss", "avg_acc")


@query(f"""
WITH {SCORED}, b AS (
  SELECT batch, count(*) AS n, sum(loss) AS loss_sum, sum(correct) AS correct_sum FROM scored GROUP BY batch)
SELECT batch, (sum(n) OVER w)::BIGINT AS processed, (count(*) OVER w)::BIGINT AS batches,
       round(avg(loss_sum / n) OVER w, 6) AS avg_actual_loss,
       round(sum(loss_sum) OVER w / sum(n) OVER w, 6) AS avg_per_sample_loss,
       round(sum(correct_sum) OVER w / sum(n) OVER w, 6) AS avg_acc
FROM b WINDOW w AS (ORDER BY batch)""")
def running_overall(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(M.running_overall(scored(spark, sf)), "avg_actual_loss", "avg_per_sample_loss", "avg_acc")


EMA = RUNNING.replace("WITH ", "") + """,
o AS (SELECT g, loss_sum / n AS x, row_number() OVER (PARTITION BY g ORDER BY batch) AS t FROM b),
fold AS (
  SELECT g, t, x AS e FROM o WHERE t = 1
  UNION ALL
  SELECT f.g, o.t, 0.9::DOUBLE * f.e + 0.1::DOUBLE * o.x FROM fold f JOIN o ON o.g = f.g AND o.t = f.t + 1
),
ema AS (SELECT g, max(t) AS batches, arg_max(e, t) AS exp_loss FROM fold GROUP BY g)"""


@query(f"WITH RECURSIVE {EMA} SELECT g, batches, round(exp_loss, 6) AS exp_loss FROM ema")
def ema_group_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(M.ema_group_loss(scored(spark, sf)), "exp_loss")


@query(f"""
WITH RECURSIVE {EMA}, n AS (SELECT g, count(*) AS n FROM scored GROUP BY g)
SELECT n.g, n.n, round(exp_loss, 6) AS exp_loss, round(exp_loss + (n.g + 1) / sqrt(n.n), 6) AS adjusted_loss,
       0.25::DOUBLE AS adv_prob
FROM n JOIN ema ON n.g = ema.g""")
def adjusted_loss(spark: SparkSession, sf: str) -> DataFrame:
    df = scored(spark, sf)
    out = M.adjusted_loss(M.ema_group_loss(df), G.group_counts(df, SPACE), SPACE, [1.0, 2.0, 3.0, 4.0])
    return _r6(out, "exp_loss", "adjusted_loss")


@query(f"""
WITH RECURSIVE {EMA}, k AS (
  SELECT s.g, count(*)::DOUBLE AS n, avg(loss) AS avg_loss, avg(correct) AS avg_acc, any_value(exp_loss) AS exp_loss,
         any_value(batches)::DOUBLE AS batches
  FROM scored s JOIN ema ON s.g = ema.g GROUP BY s.g),
per_batch AS (SELECT batch, avg(loss) AS m FROM scored GROUP BY batch)
SELECT 'avg_loss_group:' || g AS stat, round(avg_loss, 6) AS value FROM k
UNION ALL SELECT 'exp_avg_loss_group:' || g, round(exp_loss, 6) FROM k
UNION ALL SELECT 'avg_acc_group:' || g, round(avg_acc, 6) FROM k
UNION ALL SELECT 'processed_data_count_group:' || g, n FROM k
UNION ALL SELECT 'update_data_count_group:' || g, n FROM k
UNION ALL SELECT 'update_batch_count_group:' || g, batches FROM k
UNION ALL SELECT 'avg_actual_loss', round(avg(m), 6) FROM per_batch
UNION ALL SELECT 'avg_per_sample_loss', round(avg(loss), 6) FROM scored
UNION ALL SELECT 'avg_acc', round(avg(correct), 6) FROM scored""")
def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(M.group_stats(scored(spark, sf), SPACE), "value")


@query(f"WITH {SCORED} SELECT lang, round(avg(correct), 6) AS acc FROM scored GROUP BY lang")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(M.accuracy(scored(spark, sf), ["lang"]), "acc")


F1 = """
avg(correct) AS acc,
CASE WHEN count(*) FILTER (pred = 1) + count(*) FILTER (y = 1) = 0 THEN 0
     ELSE 2.0::DOUBLE * count(*) FILTER (pred = 1 AND y = 1) / (count(*) FILTER (pred = 1) + count(*) FILTER (y = 1)) END AS f1"""


@query(f"""
WITH {SCORED}, k AS (SELECT g, {F1} FROM scored GROUP BY g)
SELECT g, round(acc, 6) AS acc, round(f1, 6) AS f1, round((acc + f1) / 2, 6) AS acc_and_f1 FROM k""")
def acc_and_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(M.acc_and_f1(scored(spark, sf), ["g"]), "acc", "f1", "acc_and_f1")


MCC = """
CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
     ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END"""
CELLS = """
(count(*) FILTER (pred = 1 AND y = 1))::DOUBLE AS tp, (count(*) FILTER (pred = 1 AND y = 0))::DOUBLE AS fp,
(count(*) FILTER (pred = 0 AND y = 1))::DOUBLE AS fn, (count(*) FILTER (pred = 0 AND y = 0))::DOUBLE AS tn"""


@query(f"WITH {SCORED}, k AS (SELECT lang, {CELLS} FROM scored GROUP BY lang) SELECT lang, round({MCC}, 6) AS mcc FROM k")
def mcc(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(M.mcc(scored(spark, sf), ["lang"]), "mcc")


SPEARMAN = """
ranked AS (
  SELECT l_extendedprice AS a, l_quantity AS b,
         rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS ra,
         rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rb
  FROM lineitem),
k AS (SELECT corr(a, b) AS p, corr(ra, rb) AS s FROM ranked)"""


@query(f"WITH {SPEARMAN} SELECT round(p, 6) AS pearson, round(s, 6) AS spearmanr, round((p + s) / 2, 6) AS corr FROM k")
def pearson_and_spearman(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("pred"), F.col("l_quantity").alias("y"))
    return _r6(M.pearson_and_spearman(pairs), "pearson", "spearmanr", "corr")


@query(f"""
WITH {SCORED}, {SPEARMAN}, c AS (SELECT {CELLS} FROM scored), f AS (SELECT {F1} FROM scored)
SELECT 'cola' AS task, 'mcc' AS metric, round({MCC}, 6) AS value FROM c
UNION ALL SELECT t, 'acc', round(acc, 6) FROM f, unnest(['sst-2', 'mnli', 'mnli-mm', 'qnli', 'rte', 'wnli', 'mrpc', 'qqp']) x(t)
UNION ALL SELECT t, 'f1', round(f1, 6) FROM f, unnest(['mrpc', 'qqp']) x(t)
UNION ALL SELECT t, 'acc_and_f1', round((acc + f1) / 2, 6) FROM f, unnest(['mrpc', 'qqp']) x(t)
UNION ALL SELECT 'sts-b', 'pearson', round(p, 6) FROM k
UNION ALL SELECT 'sts-b', 'spearmanr', round(s, 6) FROM k
UNION ALL SELECT 'sts-b', 'corr', round((p + s) / 2, 6) FROM k""")
def task_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every task's metric set, regression on prices, classification on the scored documents; one scan of either."""
    named = [t for t, kind in M.TASK_METRICS.items() if kind != "correlation"]
    labels = scored(spark, sf).select("doc_id", F.explode(F.array(*[F.lit(t) for t in named])).alias("task"), F.col("y").cast("double").alias("y"))
    preds = scored(spark, sf).select("doc_id", F.col("pred").cast("double").alias("pred"))
    classified = M.join_predictions(preds, labels, "doc_id").select("task", "pred", "y")
    pairs = table(spark, sf, "lineitem").select(
        F.lit("sts-b").alias("task"), F.col("l_extendedprice").cast("double").alias("pred"), F.col("l_quantity").cast("double").alias("y"))
    return _r6(M.all_task_metrics(classified.unionByName(pairs)), "value")


@query(f"WITH {SCORED} SELECT g, pred, y AS label, count(*) AS n FROM scored GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(scored(spark, sf), ["g"])


@query(f"""
WITH {SCORED}
SELECT g, y AS label, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1
FROM scored GROUP BY g, y""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion_matrix(scored(spark, sf), [0, 1], ["g"])


@query(f"""
WITH RECURSIVE {EMA}, groups AS (
  SELECT s.g, count(*) AS n, avg(loss) AS avg_loss, avg(correct) AS avg_acc, any_value(exp_loss) AS exp_loss
  FROM scored s JOIN ema ON s.g = ema.g GROUP BY s.g),
per_batch AS (SELECT avg(m) AS m FROM (SELECT avg(loss) AS m FROM scored GROUP BY batch)),
tot AS (SELECT sum(n * avg_loss) / sum(n) AS l, sum(n * avg_acc) / sum(n) AS a, min(avg_acc) AS w FROM groups)
SELECT 0 AS line_no, 'Average incurred loss: ' || printf('%.3f', l) AS line FROM tot
UNION ALL SELECT 1, 'Average sample loss: ' || printf('%.3f', m) FROM per_batch
UNION ALL SELECT 2, 'Average acc: ' || printf('%.3f', a) FROM tot
UNION ALL SELECT 3, 'Worst acc: ' || printf('%.3f', w) FROM tot
UNION ALL SELECT 4 + g, 'quality = ' || (g // 2) || ', toxic = ' || (g % 2) || ' [n = ' || n || ']: loss = '
  || printf('%.3f', avg_loss) || ' exp loss = ' || printf('%.3f', exp_loss) || ' adjusted loss = '
  || printf('%.3f', exp_loss) || ' adv prob = 0.250000 acc = ' || printf('%.3f', avg_acc) FROM groups""")
def group_report(spark: SparkSession, sf: str) -> DataFrame:
    df = scored(spark, sf)
    stats = M.group_metrics(df, SPACE)
    adjusted = M.adjusted_loss(M.ema_group_loss(df), stats, SPACE).drop("n")
    groups = stats.join(adjusted, "g")
    per_batch = df.groupBy("batch").agg(F.avg("loss").alias("m")).agg(F.avg("m").alias("sample_loss"))
    summary = M.robustness_summary(stats).withColumn("sample_loss", per_batch.scalar())
    names = spark.range(SPACE.n_groups).select(
        F.col("id").cast("int").alias("g"), G.group_name("id", SPACE, "quality", ["toxic"]).alias("group_name")
    )
    return M.report_lines(groups, summary, names)
