"""Scores per row, per group and per task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.sizing import broadcast_if_small
from cohortlab.operators.groups import GroupSpace, group_counts
from cohortlab.operators.ordering import average_ranks, running_sums
from cohortlab.scratch import materialize

Loss = Callable[[Column, Column], Column]


def predicted_class(logits: str | Column) -> Column:
    """Index of the largest logit; the first one wins a tie."""
    x = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def predict(df: DataFrame, logits: str = "logits", name: str = "pred") -> DataFrame:
    return df.withColumn(name, predicted_class(logits))


def cross_entropy(logits: Column, y: Column) -> Column:
    """Negative log-softmax at ``y``, shifted by the maximum so nothing overflows."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.log(total) - F.element_at(logits, y.cast("int") + 1)


def sample_loss(
    df: DataFrame, logits: str = "logits", y: str = "y", name: str = "loss", loss: Loss = cross_entropy
) -> DataFrame:
    """Per-row loss. ``loss`` maps two columns to one, so users can pass their own."""
    return df.withColumn(name, loss(F.col(logits), F.col(y)))


def score_rows(df: DataFrame, logits: str = "logits", y: str = "y", loss: Loss = cross_entropy) -> DataFrame:
    """Add ``pred``, ``loss`` and ``correct``."""
    scored = sample_loss(predict(df, logits), logits, y, loss=loss)
    return scored.withColumn("correct", F.col("pred").eqNullSafe(F.col(y)).cast("int"))


def group_metrics(df: DataFrame, space: GroupSpace, g: str = "g", by: Sequence[str] = ()) -> DataFrame:
    """Count, mean loss and mean accuracy of every group; an empty group gets zeros.

    The rows are read once. A zero-weight row per group rides along, so empty groups need
    no join. With ``by`` every slice that has a row reports all groups.
    """
    rows = df.select(*by, F.col(g).cast("int").alias("g"), "loss", "correct", F.lit(1).cast("long").alias("n"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by, "g").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("correct").alias("correct"))

    if by:
        rows = materialize(summed(rows), "slices")  # one row for each slice and group
    slices = rows.select(*by).distinct() if by else df.sparkSession.range(1)
    empty = slices.select(
        *by, F.explode(F.sequence(F.lit(0), F.lit(space.n_groups - 1))).alias("g"), F.lit(0.0).alias("loss"),
        F.lit(0).alias("correct"), F.lit(0).cast("long").alias("n"),
    )
    sums = summed(rows.unionByName(empty))
    denominator = F.greatest(F.col("n"), F.lit(1))
    return sums.select(
        *by, "g", "n", (F.col("loss") / denominator).alias("avg_loss"),
        (F.col("correct") / denominator).alias("avg_acc"),
    )


def robustness_summary(groups: DataFrame, by: Sequence[str] = (), ignore_empty: bool = False) -> DataFrame:
    """Average accuracy and loss over rows, and the accuracy of the worst group.

    An empty group counts as accuracy 0 unless ``ignore_empty`` is set.
    """
    worst = F.when(F.col("n") > 0, F.col("avg_acc")) if ignore_empty else F.col("avg_acc")
    n = F.greatest(F.sum("n"), F.lit(1))
    return groups.groupBy(*by).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("avg_acc")) / n).alias("average_acc"),
        F.min(worst).alias("worst_acc"),
        (F.sum(F.col("n") * F.col("avg_loss")) / n).alias("average_loss"),
    )


def batch_sums(df: DataFrame, batch: str = "batch", g: str = "g") -> DataFrame:
    return df.groupBy(g, batch).agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss_sum"), F.sum("correct").alias("correct_sum")
    )


def running_group_metrics(df: DataFrame, batch: str = "batch", g: str = "g") -> DataFrame:
    """State of each group after every batch that contains it; the rows are read once, their sums are stored."""
    sums = running_sums(
        materialize(batch_sums(df, batch, g), "batch-sums"), [g], batch,
        {"processed": F.col("n"), "batches": F.lit(1), "_loss": F.col("loss_sum"), "_correct": F.col("correct_sum")},
    )
    return sums.select(
        g, batch, F.col("processed").cast("long").alias("processed"), F.col("batches").cast("long").alias("batches"),
        (F.col("_loss") / F.col("processed")).alias("avg_loss"),
        (F.col("_correct") / F.col("processed")).alias("avg_acc"),
    )


def running_overall(df: DataFrame, batch: str = "batch") -> DataFrame:
    """Overall state after every batch: mean of batch means, and means over rows."""
    per_batch = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss_sum"), F.sum("correct").alias("correct_sum")
    )
    sums = running_sums(
        per_batch, [], batch,
        {
            "processed": F.col("n"), "batches": F.lit(1), "_loss": F.col("loss_sum"),
            "_correct": F.col("correct_sum"), "_means": F.col("loss_sum") / F.col("n"),
        },
    )
    return sums.select(
        batch, F.col("processed").cast("long").alias("processed"), F.col("batches").cast("long").alias("batches"),
        (F.col("_means") / F.col("batches")).alias("avg_actual_loss"),
        (F.col("_loss") / F.col("processed")).alias("avg_per_sample_loss"),
        (F.col("_correct") / F.col("processed")).alias("avg_acc"),
    )


def ema_group_loss(df: DataFrame, gamma: float = 0.1, batch: str = "batch", g: str = "g") -> DataFrame:
    """Exponential average of each group's batch losses, started by its first batch."""
    sums = materialize(batch_sums(df, batch, g), "batch-sums")
    return fold_batches(sums, gamma, batch, g).select(g, "batches", "exp_loss")


def fold_batches(sums: DataFrame, gamma: float, batch: str = "batch", g: str = "g", before: DataFrame | None = None) -> DataFrame:
    """Fold batch sums into each group's state: g, exp_loss, batches, n, loss_sum, correct_sum.

    The recurrence has a closed form: a batch counts with (1-gamma)^(later batches
    of the group), times gamma unless it is the group's first. So it is a weighted
    sum, and only the ordinal of each batch is needed. ``before`` is the state of
    earlier batches. ``sums`` has one row for each group and batch and should be a stored table.
    """
    # one row for each group
    totals = sums.groupBy(g).agg(F.count(F.lit(1)).alias("_last")).withColumnRenamed(g, "_g")
    ordinal = running_sums(sums.withColumn("_mean", F.col("loss_sum") / F.col("n")), [g], batch, {"_t": F.lit(1)})
    weighted = ordinal.join(totals, F.col(g).eqNullSafe(F.col("_g")))
    decay = lambda n: F.pow(F.lit(1.0 - gamma), n)
    # a group's first batch of all loses the factor gamma, see below
    new = weighted.groupBy(g).agg(
        F.count(F.lit(1)).alias("_batches"), F.sum(decay(F.col("_last") - F.col("_t")) * F.col("_mean") * gamma).alias("_exp"),
        F.max(F.when(F.col("_t") == 1, F.col("_mean"))).alias("_first"),
        F.sum("n").alias("_n"), F.sum("loss_sum").alias("_loss"), F.sum("correct_sum").alias("_correct"))
    if before is None:
        before = sums.sparkSession.createDataFrame([], FOLDED).withColumn("g", F.col("g").cast(sums.schema[g].dataType))
    old = before.select(F.col("g").alias("_g"), *[F.col(c).alias(f"_o_{c}") for c in ("exp_loss", "batches", "n", "loss_sum", "correct_sum")])
    both = new.join(old, F.col(g).eqNullSafe(F.col("_g")), "full_outer")
    # before the first batch the average is that batch's mean
    start = F.when(F.col("_o_batches").isNotNull(), F.col("_o_exp_loss")).otherwise(F.col("_first"))
    exp_loss = F.when(F.col("_batches").isNull(), F.col("_o_exp_loss")).otherwise(F.col("_exp") + decay(F.col("_batches")) * start)
    plus = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    return both.select(
        F.when(F.col("_batches").isNotNull(), F.col(g)).otherwise(F.col("_g")).alias(g), exp_loss.alias("exp_loss"),
        plus("_batches", "_o_batches").cast("long").alias("batches"), plus("_n", "_o_n").cast("long").alias("n"),
        plus("_loss", "_o_loss_sum").alias("loss_sum"), plus("_correct", "_o_correct_sum").cast("double").alias("correct_sum"))


#: The state of ``fold_batches``.
FOLDED = "g string, exp_loss double, batches long, n long, loss_sum double, correct_sum double"


def adjusted_loss(
    ema: DataFrame, counts: DataFrame, space: GroupSpace, adjustments: Sequence[float] | None = None, g: str = "g"
) -> DataFrame:
    """Exponential loss plus adj / sqrt(group size); also the constant 1/n_groups weight."""
    adj = list(adjustments) if adjustments is not None else [0.0] * space.n_groups
    if len(adj) != space.n_groups:
        raise ValueError(f"{len(adj)} adjustments for {space.n_groups} groups")
    term = F.element_at(F.array(*[F.lit(float(a)) for a in adj]), F.col(g) + 1)
    return counts.select(g, "n").join(ema, g, "left").select(
        g, "n", F.coalesce(F.col("exp_loss"), F.lit(0.0)).alias("exp_loss"),
        (F.coalesce(F.col("exp_loss"), F.lit(0.0)) + F.when(F.col("n") > 0, term / F.sqrt("n")).otherwise(F.lit(0.0)))
        .alias("adjusted_loss"),
        F.lit(1.0 / space.n_groups).alias("adv_prob"),
    )


def group_stats(df: DataFrame, space: GroupSpace, batch: str = "batch", gamma: float = 0.1) -> DataFrame:
    """All statistics in long form: one row per statistic name.

    ``df`` has ``g``, ``loss``, ``correct`` and the batch number.
    """
    counts = group_metrics(df, space)
    ema = ema_group_loss(df, gamma, batch)
    joined = counts.join(ema, "g", "left").na.fill({"batches": 0, "exp_loss": 0.0})
    # The statistic names.
    wide = joined.select(
        "g",
        F.col("avg_loss").alias("avg_loss_group"),
        F.col("exp_loss").alias("exp_avg_loss_group"),
        F.col("avg_acc").alias("avg_acc_group"),
        F.col("n").cast("double").alias("processed_data_count_group"),
        F.col("n").cast("double").alias("update_data_count_group"),
        F.col("batches").cast("double").alias("update_batch_count_group"),
    )
    per_group = wide.unpivot("g", wide.columns[1:], "name", "value").select(
        F.concat_ws(":", "name", F.col("g").cast("string")).alias("stat"), "value"
    )
    batches = df.groupBy(batch).agg(
        F.avg("loss").alias("_mean"), F.count(F.lit(1)).alias("_n"), F.sum("loss").alias("_loss"),
        F.sum("correct").alias("_correct"),
    )
    overall = batches.agg(
        F.avg("_mean").alias("avg_actual_loss"), (F.sum("_loss") / F.sum("_n")).alias("avg_per_sample_loss"),
        (F.sum("_correct") / F.sum("_n")).alias("avg_acc"),
    )
    totals = overall.unpivot([], overall.columns, "stat", "value")
    return per_group.unionByName(totals)


def confusion(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", y: str = "y") -> DataFrame:
    return df.groupBy(*by, F.col(pred).alias("pred"), F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One row per label (and group), one column per predicted class."""
    table = df.groupBy(*by, F.col("y").alias("label")).pivot("pred", list(classes)).agg(F.count(F.lit(1)))
    for k in classes:
        table = table.withColumnRenamed(str(k), f"pred_{k}")
    return table.na.fill(0)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def accuracy(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(pred).eqNullSafe(F.col(y)).cast("int")).alias("acc"))


def acc_and_f1(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", y: str = "y") -> DataFrame:
    """Accuracy, F1 of class 1 and their mean; F1 is 0 when it is undefined."""
    hit = (F.col(pred) == 1) & (F.col(y) == 1)
    f1 = _ratio(
        2.0 * F.sum(hit.cast("int")), F.sum((F.col(pred) == 1).cast("int")) + F.sum((F.col(y) == 1).cast("int"))
    )
    acc = F.avg(F.col(pred).eqNullSafe(F.col(y)).cast("int"))
    return df.groupBy(*by).agg(acc.alias("acc"), f1.alias("f1")).withColumn(
        "acc_and_f1", (F.col("acc") + F.col("f1")) / 2
    )


def mcc(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", y: str = "y") -> DataFrame:
    """Matthews correlation for any number of classes, from the confusion counts.

    Everything after the first aggregate has one row per (slice, class pair).
    """
    cells = confusion(df.withColumn("_all", F.lit(1)), [*by, "_all"], pred, y)
    return _mcc_of_cells(cells.drop("_all"), by)


def _mcc_of_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    keys, by = list(by), [*by, "_all"]
    cells = cells.withColumns({"_all": F.lit(1), "n": F.col("n").cast("double")})
    whole = cells.groupBy(*by).agg(
        F.sum("n").alias("s"), F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0.0)).alias("c")
    )
    # each cell counts once as its predicted class and once as its true class
    sides = cells.select(
        *by, F.explode(F.array(
            F.struct(F.col("pred").alias("k"), F.col("n").alias("p"), F.lit(0.0).alias("t")),
            F.struct(F.col("label").alias("k"), F.lit(0.0).alias("p"), F.col("n").alias("t")),
        )).alias("x"),
    )
    marginal = sides.groupBy(*by, "x.k").agg(F.sum("x.p").alias("p"), F.sum("x.t").alias("t"))
    products = marginal.groupBy(*by).agg(
        F.sum(F.col("p") * F.col("t")).alias("pt"), F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.sum(F.col("t") * F.col("t")).alias("tt"),
    )
    joined = whole.join(products, by)
    s2 = F.col("s") * F.col("s")
    value = _ratio(F.col("c") * F.col("s") - F.col("pt"), F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt"))))
    return joined.select(*keys, value.alias("mcc"))


def pearson_and_spearman(df: DataFrame, pred: str = "pred", y: str = "y") -> DataFrame:
    """Linear and rank correlation, and their mean; a pair with a null is an error.

    Equal pairs are counted first. Ranks are computed on the distinct values of
    each column by prefix sums over their counts, so no task sorts all rows.
    """
    return _correlations(materialize(
        df.groupBy(F.col(pred).cast("double").alias("a"), F.col(y).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("n")), "pairs"))


def _correlations(pairs: DataFrame) -> DataFrame:
    """The correlations of stored pairs a, b that occur n times."""
    missing = pairs.where(F.col("a").isNull() | F.col("b").isNull()).agg(F.sum("n")).first()[0]
    if missing:
        raise ValueError(f"{missing} pairs have no prediction or no label")
    ranks_a = materialize(average_ranks(pairs.groupBy("a").agg(F.sum("n").alias("w")), "a", "w", "ra"), "ranks")
    ranks_b = materialize(average_ranks(pairs.groupBy("b").agg(F.sum("n").alias("w")), "b", "w", "rb"), "ranks")
    ranked = pairs.join(broadcast_if_small(ranks_a), "a").join(broadcast_if_small(ranks_b), "b")
    # ranks are centred on their known mean (n+1)/2, which keeps the sums small
    count = pairs.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("a")) / F.sum("n")).alias("a"),
                      (F.sum(F.col("n") * F.col("b")) / F.sum("n")).alias("b")).first()
    middle = F.lit((count.n + 1) / 2)
    a, b = F.col("a") - F.lit(count.a), F.col("b") - F.lit(count.b)
    ra, rb, n = F.col("ra") - middle, F.col("rb") - middle, F.col("n")
    sums = ranked.agg(
        F.sum(n * a * b).alias("ab"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"),
        F.sum(n * ra * rb).alias("rab"), F.sum(n * ra * ra).alias("raa"), F.sum(n * rb * rb).alias("rbb"),
    )
    pearson = F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))
    spearman = F.col("rab") / F.sqrt(F.col("raa") * F.col("rbb"))
    return sums.select(
        pearson.alias("pearson"), spearman.alias("spearmanr"), ((pearson + spearman) / 2).alias("corr")
    )


# The metric set of each task.
TASK_METRICS = {
    "cola": "mcc",
    "sst-2": "acc",
    "mrpc": "acc_and_f1",
    "sts-b": "correlation",
    "qqp": "acc_and_f1",
    "mnli": "acc",
    "mnli-mm": "acc",
    "qnli": "acc",
    "rte": "acc",
    "wnli": "acc",
}


def join_predictions(preds: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Pair predictions with labels; a row missing on either side is an error."""
    p = preds.withColumn("_p", F.lit(True))
    q = labels.withColumn("_q", F.lit(True))
    joined = p.join(q, key, "full_outer")
    complete = F.col("_p").isNotNull() & F.col("_q").isNotNull()
    message = F.concat(F.lit("prediction and label do not pair for "), F.col(key).cast("string"))
    checked = F.when(complete, F.col(key)).otherwise(F.raise_error(message).cast(labels.schema[key].dataType))
    return joined.withColumn(key, checked).drop("_p", "_q")


def task_metrics(df: DataFrame, task: str, pred: str = "pred", y: str = "y") -> DataFrame:
    """Metrics of one task in long form: task, metric, value."""
    return all_task_metrics(df.withColumn("task", F.lit(task)), [task], pred, y)


def all_task_metrics(df: DataFrame, tasks: Sequence[str] = tuple(TASK_METRICS), pred: str = "pred", y: str = "y") -> DataFrame:
    """Metrics of all tasks in long form: task, metric, value. ``df`` has the name of the task in each row.

    The rows are read once, into counts of equal (task, prediction, label). These hold all that any metric
    needs: the confusion table of a classification, and the distinct pairs of a regression.
    """
    unknown = sorted(set(tasks) - set(TASK_METRICS))
    if unknown:
        raise KeyError(unknown[0])
    counts = materialize(
        df.where(F.col("task").isin(list(tasks))).groupBy("task", F.col(pred).cast("double").alias("pred"), F.col(y).cast("double").alias("label"))
        .agg(F.count(F.lit(1)).alias("n")), "task-counts")
    of = {kind: [t for t in tasks if TASK_METRICS[t] == kind] for kind in set(TASK_METRICS.values())}

    def long_form(wide: DataFrame) -> DataFrame:
        return wide.unpivot("task", [c for c in wide.columns if c != "task"], "metric", "value")

    n = F.col("n")
    total = lambda condition: F.sum(F.when(condition, n).otherwise(0))
    acc = total(F.col("pred").eqNullSafe(F.col("label"))) / F.sum(n)
    positive, true = F.col("pred") == 1, F.col("label") == 1
    f1 = _ratio(2.0 * total(positive & true), total(positive) + total(true))
    both = counts.where(F.col("task").isin(of["acc_and_f1"])).groupBy("task").agg(acc.alias("acc"), f1.alias("f1"))
    out = long_form(counts.where(F.col("task").isin(of["acc"])).groupBy("task").agg(acc.alias("acc")))
    out = out.unionByName(long_form(both.withColumn("acc_and_f1", (F.col("acc") + F.col("f1")) / 2)))
    out = out.unionByName(long_form(_mcc_of_cells(counts.where(F.col("task").isin(of["mcc"])), ["task"])))
    for task in of["correlation"]:
        pairs = counts.where(F.col("task") == task).select(F.col("pred").alias("a"), F.col("label").alias("b"), "n")
        out = out.unionByName(long_form(_correlations(pairs).select(F.lit(task).alias("task"), "*")))
    return out


def report_lines(
    groups: DataFrame, summary: DataFrame, names: DataFrame, size_mb: float | None = None
) -> DataFrame:
    """The text report: four overall lines, then one line per group.

    ``groups`` has g, n, avg_loss, exp_loss, adjusted_loss, adv_prob and avg_acc;
    ``names`` maps g to its name; ``summary`` is one row with average_loss,
    sample_loss, average_acc and worst_acc.
    """
    def f3(c: str) -> Column:
        return F.format_string("%.3f", F.col(c))

    head = [
        F.concat(F.lit("Average incurred loss: "), f3("average_loss")),
        F.concat(F.lit("Average sample loss: "), f3("sample_loss")),
        F.concat(F.lit("Average acc: "), f3("average_acc")),
        F.concat(F.lit("Worst acc: "), f3("worst_acc")),
    ]
    if size_mb is not None:
        head.append(F.lit(f"Model size: {size_mb:.2f}"))
    top = summary.select(F.posexplode(F.array(*head)).alias("line_no", "line"))
    body = groups.join(names, "g").select(
        (F.col("g") + len(head)).alias("line_no"),
        F.concat(
            F.col("group_name"), F.format_string(" [n = %d]: ", F.col("n")),
            F.lit("loss = "), f3("avg_loss"), F.lit(" exp loss = "), f3("exp_loss"),
            F.lit(" adjusted loss = "), f3("adjusted_loss"),
            F.lit(" adv prob = "), F.format_string("%.6f", F.col("adv_prob")), F.lit(" acc = "), f3("avg_acc"),
        ).alias("line"),
    )
    return top.unionByName(body).select(F.col("line_no").cast("int").alias("line_no"), "line")
