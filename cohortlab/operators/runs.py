"""Comparing runs: best epochs, early stopping, checkpoint retention, learning curves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.operators.ordering import running_sums

# Methods and the settings each one allows; the base method has none.
METHODS: dict[str, tuple[str, ...]] = {
    "base": (),
    "kd": (
        "bert_medium", "bert_small", "bert_mini", "bert_tiny", "distilbert", "tinybert_6", "tinybert_4",
        "tinybert_ahe", "tinybert_ah", "tinybert_ae", "tinybert_he", "tinybert_a", "tinybert_h", "tinybert_e",
    ),
    "up": ("20", "40", "60", "80"),
    "sp": ("20", "40", "60", "80"),
    "qn": ("dq", "sq", "qat"),
    "vt": ("100", "75", "50", "25"),
}
# Seeds of every setting.
SEEDS = (1, 2, 3, 4, 5)

# logs/<data>/base/seed_<i>/... or logs/<data>/<method>/<setting>/seed_<i>/...
_RUN = r"logs/([^/]+)/(base|kd|up|sp|qn|vt)(?:/([^/]+))?/seed_([0-9]+)/"


def run_path(data: str, method: str = "base", setting: str | None = None, seed: int = 1) -> str:
    """Folder of one run; a method other than base needs one of its settings."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "base":
        if setting is not None:
            raise ValueError("the base method has no setting")
        return f"logs/{data}/base/seed_{seed}"
    if setting not in METHODS[method]:
        raise ValueError(f"{setting!r} is not a setting of {method}")
    return f"logs/{data}/{method}/{setting}/seed_{seed}"


def run_keys(path: Column) -> dict[str, Column]:
    """Columns data, method, setting (null for base) and seed from a file path."""
    return {
        "data": F.regexp_extract(path, _RUN, 1),
        "method": F.regexp_extract(path, _RUN, 2),
        "setting": F.nullif(F.regexp_extract(path, _RUN, 3), F.lit("")),
        "seed": F.regexp_extract(path, _RUN, 4).cast("int"),
    }


#: A column, or what computes one from the columns of an epoch's row.
Metric = str | Callable[[], Column]


def _value(metric: Metric, larger_better: bool) -> Column:
    value = metric() if callable(metric) else F.col(metric)
    return value if larger_better else -value


def best_epoch(df: DataFrame, runs: Sequence[str], metric: Metric, epoch: str = "epoch",
               larger_better: bool = True) -> DataFrame:
    """Best epoch of each run, the earliest one on a tie; one aggregate, no sort."""
    valued = df.withColumns({"_value": _value(metric, True), "_v": _value(metric, larger_better)})
    best = F.max_by(F.struct(epoch, "_value"), F.struct("_v", (-F.col(epoch)).alias("e")))
    return valued.where(F.col("_v").isNotNull()).groupBy(*runs).agg(best.alias("_best")).select(
        *runs, F.col(f"_best.{epoch}").alias("best_epoch"), F.col("_best._value").alias("best_value")
    )


def early_stop(df: DataFrame, runs: Sequence[str], metric: Metric, patience: int = 3, epoch: str = "epoch",
               larger_better: bool = True) -> DataFrame:
    """First epoch after ``patience`` evaluations without improvement (null if none), and the last epoch."""
    value = _value(metric, larger_better)
    run = Window.partitionBy(*runs).orderBy(epoch)  # the epochs of one run are few
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best_before = F.max("_v").over(before)
    scored = df.withColumn("_v", value).withColumn("_n", F.row_number().over(run))
    scored = scored.withColumn("_better", best_before.isNull() | (F.col("_v") > best_before))
    scored = scored.withColumn("_since", F.col("_n") - F.max(F.when(F.col("_better"), F.col("_n"))).over(so_far))
    return scored.groupBy(*runs).agg(
        F.min(F.when(F.col("_since") >= patience, F.col(epoch))).alias("stop_epoch"),
        F.max(epoch).alias("last_epoch"),
    )


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers and letters ignore case.

    A number is preceded by how many digits it has, so numbers may have any length.
    """
    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def padded(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+(?=[0-9])", "")
        # no string has more characters than ten digits can count
        size = F.lpad(F.char_length(number).cast("string"), 10, "0")
        return F.when(part.rlike("^[0-9]"), F.concat(size, number))

    return F.array_join(F.transform(parts, lambda p: F.coalesce(padded(p), p)), "")


def natural_sort(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(column)), column)


def retain_latest(df: DataFrame, runs: Sequence[str], name: str = "file", keep: int = 2) -> DataFrame:
    """What happens to each checkpoint: final, keep or delete. Nothing is deleted here."""
    weights = df.where(F.col(name).contains(".bin")).withColumn("_key", natural_key(F.col(name)))
    newest = Window.partitionBy(*runs).orderBy(F.col("_key").desc(), F.col(name).desc())
    rank = F.row_number().over(newest)
    action = F.when(F.col("_rank") == 1, "final").when(F.col("_rank") <= keep, "keep").otherwise("delete")
    return weights.withColumn("_rank", rank).withColumn("action", action).drop("_key", "_rank")


def seed_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over the seeds of each setting."""
    aggregates = [F.count(F.lit(1)).alias("n_seeds")]
    for m in metrics:
        aggregates += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*by).agg(*aggregates)


def training_curve(df: DataFrame, keys: Sequence[str], step: str, losses: Sequence[str], every: int) -> DataFrame:
    """Mean of each loss so far, reported at every ``every``-th step (steps count from 0)."""
    sums = {"_steps": F.lit(1), **{f"_{c}": F.col(c) for c in losses}}
    running = running_sums(df, keys, step, sums)
    return running.where((F.col(step) + 1) % every == 0).select(
        *keys, step, *[(F.col(f"_{c}") / F.col("_steps")).alias(c) for c in losses]
    )
