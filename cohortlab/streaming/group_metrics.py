"""Group metrics that stay current while scored rows arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import metrics as M
from cohortlab.scratch import fresh_path


def windowed_metrics(stream: DataFrame, window: str = "1 day", delay: str = "1 hour", ts: str = "ts",
                     g: str = "g") -> DataFrame:
    """Mean loss and accuracy per time window and group; late rows count until the watermark passes."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), F.col(g).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("loss").alias("avg_loss"), F.avg("correct").alias("avg_acc")
    ).select(F.col("w.start").alias("window_start"), "g", "n", "avg_loss", "avg_acc")


def running_totals(stream: DataFrame, g: str = "g") -> DataFrame:
    """Mean loss and accuracy per group over everything seen; the state is one row per group."""
    return stream.groupBy(F.col(g).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("loss").alias("avg_loss"), F.avg("correct").alias("avg_acc")
    )


def run_available(result: DataFrame, keys: list[str], mode: str = "update", path: str | None = None) -> DataFrame:
    """Process everything available now and return the latest row of each key.

    Each micro-batch writes its changed rows to a folder of its own, which a
    replay of the batch overwrites. ``path`` keeps offsets, state and rows: a later call
    with the same one goes on where the earlier one ended, and only reads new files.
    """
    spark, path = result.sparkSession, path or fresh_path(result.sparkSession, "stream")

    def save(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = result.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{path}/offsets").trigger(
        availableNow=True
    ).start()
    query.awaitTermination()
    saved = spark.read.parquet(f"{path}/rows")
    columns = [c for c in saved.columns if c not in (*keys, "batch")]
    latest = saved.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_r"))
    return latest.select(*keys, "_r.*")


class GroupState:
    """Each group's exponential average and totals, folded in the order of a batch number that the rows carry.

    Files may come in any order: sums of batches that are still open are kept apart
    by (group, batch). A batch closes when one that is more than ``lateness`` higher has
    been seen; it is then folded into its group's state, and rows that come later for it
    are not taken in but counted. With ``lateness`` None no batch ever closes, and every
    row counts. So what is kept is one row for each group and one for each group and open batch.

    All of it lies below ``path``: a step reads the tables of the step before and
    writes folders of its own, so a replayed step writes the same again, and
    a state that is opened with the same path goes on with new files only.
    Rows without a batch number form the lowest batch; rows without a group form a group.
    """

    _OPEN = "g string, batch long, n long, loss_sum double, correct_sum double"
    _STEP = "horizon long, late long, step int"

    def __init__(self, spark: SparkSession, path: str | None = None, gamma: float = 0.1, lateness: int | None = None,
                 g: str = "g", batch: str = "batch") -> None:
        self.spark, self.path = spark, path or fresh_path(spark, "group-state")
        self.gamma, self.lateness, self.g, self.batch = gamma, lateness, g, batch

    def _read(self, kind: str, schema: str, step: int) -> DataFrame:
        if step < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/step={step}")

    def _steps(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._STEP).parquet(f"{self.path}/steps")
        except AnalysisException:  # nothing is written there yet
            return self.spark.createDataFrame([], self._STEP)

    def add(self, rows: DataFrame, step: int) -> None:
        """Take in one micro-batch of rows with a loss and whether they are correct."""
        before = self._steps().where(F.col("step") < step).agg(F.max("horizon")).first()[0]
        lowest = F.lit(-(1 << 63))
        keyed = rows.select(F.col(self.g).cast("string").alias("g"), F.coalesce(F.col(self.batch).cast("long"), lowest).alias("batch"),
                            F.col("loss").cast("double").alias("loss"), F.col("correct").cast("double").alias("correct"))
        path = f"{self.path}/new/step={step}"
        M.batch_sums(keyed).write.mode("overwrite").parquet(path)
        new = self.spark.read.parquet(path)
        closed = F.lit(False) if before is None else F.col("batch") <= before
        late, top = new.agg(F.sum(F.when(closed, F.col("n"))), F.max("batch")).first()
        horizon = before
        if self.lateness is not None and top is not None:
            horizon = max(x for x in (before, top - self.lateness - 1) if x is not None)
        sums = [F.sum(c).alias(c) for c in ("n", "loss_sum", "correct_sum")]
        held = self._read("open", self._OPEN, step - 1).unionByName(new.where(~closed)).groupBy("g", "batch").agg(*sums)
        path = f"{self.path}/held/step={step}"
        held.write.mode("overwrite").parquet(path)
        held = self.spark.read.schema(self._OPEN).parquet(path)
        closing = F.lit(False) if horizon is None else F.col("batch") <= horizon
        held.where(~closing).write.mode("overwrite").parquet(f"{self.path}/open/step={step}")
        folded = M.fold_batches(held.where(closing), self.gamma, before=self._read("folded", M.FOLDED, step - 1))
        folded.write.mode("overwrite").parquet(f"{self.path}/folded/step={step}")
        # last of all: a step without this row does not count
        done = self.spark.createDataFrame([(horizon, late or 0)], "horizon long, late long")
        done.write.mode("overwrite").parquet(f"{self.path}/steps/step={step}")

    def run(self, stream: DataFrame) -> DataFrame:
        """Process everything that is available now and return the state."""

        def add(rows: DataFrame, step: int) -> None:
            self.add(rows, step)

        query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{self.path}/offsets").trigger(
            availableNow=True).start()
        query.awaitTermination()
        return self.table()

    def table(self) -> DataFrame:
        """g, exp_loss, batches, n, avg_loss and avg_acc over everything taken in, open batches included."""
        last = self._steps().agg(F.max("step")).first()[0]
        step = -1 if last is None else last
        held = self._read("open", self._OPEN, step)
        state = M.fold_batches(held, self.gamma, before=self._read("folded", M.FOLDED, step))
        return state.select("g", "exp_loss", "batches", "n", (F.col("loss_sum") / F.col("n")).alias("avg_loss"),
                            (F.col("correct_sum") / F.col("n")).alias("avg_acc"))

    def late_rows(self) -> int:
        """Rows that came after their batch was closed."""
        return self._steps().agg(F.sum("late")).first()[0] or 0


def ema_totals(stream: DataFrame, gamma: float = 0.1, g: str = "g", batch: str = "batch", path: str | None = None,
               lateness: int | None = None) -> DataFrame:
    """Exponential average of each group's batch losses, in the order of the batch column; see ``GroupState``."""
    return GroupState(stream.sparkSession, path, gamma, lateness, g, batch).run(stream)
