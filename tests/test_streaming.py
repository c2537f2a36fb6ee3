"""Group state over several micro-batches: any order of files, restarts, replays and late rows."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import metrics as M
from cohortlab.streaming import group_metrics as S

SCHEMA = "g string, batch long, loss double, correct int"


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None, "c"]), rng.randrange(12), rng.random(), rng.randrange(2)) for _ in range(n)]


def write(spark, path, files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def values(df):
    return {r.g: (r.batches, round(r.exp_loss, 9)) for r in df.collect()}


def by_hand(rows, gamma=0.1):
    out = {}
    for g in {r[0] for r in rows}:
        means = {}
        for r in rows:
            if r[0] == g:
                means.setdefault(r[1], []).append(r[2])
        e = None
        for b in sorted(means):
            m = sum(means[b]) / len(means[b])
            e = m if e is None else (1 - gamma) * e + gamma * m
        out[g] = (len(means), round(e, 9))
    return out


def test_order_of_files_does_not_matter(spark, tmp_path):
    rows = rows_of(400)
    write(spark, str(tmp_path / "in"), [rows[i::4] for i in range(4)])
    got = S.ema_totals(stream(spark, str(tmp_path / "in")), path=str(tmp_path / "state"))
    want = values(M.ema_group_loss(spark.createDataFrame(rows, SCHEMA)))
    assert values(got) == want == by_hand(rows)
    assert spark.read.parquet(str(tmp_path / "state/steps")).count() == 4
    totals = {r.g: (r.n, round(r.avg_loss, 9), round(r.avg_acc, 9)) for r in got.collect()}
    for g, (n, loss, acc) in totals.items():
        own = [r for r in rows if r[0] == g]
        assert (n, loss, acc) == (len(own), round(sum(r[2] for r in own) / n, 9), round(sum(r[3] for r in own) / n, 9))


def test_restart_reads_new_files_only(spark, tmp_path):
    rows, source, state = rows_of(300), str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, source, [rows[:100]])
    first = S.GroupState(spark, state)
    assert values(first.run(stream(spark, source))) == by_hand(rows[:100])
    write(spark, source, [rows[100:200], rows[200:]])
    again = S.GroupState(spark, state)
    assert values(again.run(stream(spark, source))) == by_hand(rows)
    assert values(S.GroupState(spark, state).run(stream(spark, source))) == by_hand(rows)
    assert spark.read.parquet(f"{state}/steps").count() == 3


def test_replay_of_a_step(spark, tmp_path):
    rows = rows_of(200)
    state = S.GroupState(spark, str(tmp_path / "state"), lateness=20)
    state.add(spark.createDataFrame(rows[:100], SCHEMA), 0)
    for _ in range(2):  # the second time as after a failure behind the sink
        state.add(spark.createDataFrame(rows[100:], SCHEMA), 1)
    assert values(state.table()) == by_hand(rows) and state.late_rows() == 0


def test_late_rows_are_counted(spark, tmp_path):
    state = S.GroupState(spark, str(tmp_path / "state"), lateness=2)
    early = [("a", b, float(b), 1) for b in range(6)] + [("b", 1, 1.0, 0), (None, None, 5.0, 1)]
    state.add(spark.createDataFrame(early, SCHEMA), 0)
    # batches up to 2 are closed, and 3 is still open
    assert spark.read.parquet(str(tmp_path / "state/open/step=0")).agg(F.min("batch")).first()[0] == 3
    late = [("a", 2, 100.0, 1), ("b", 0, 100.0, 1), ("b", 3, 7.0, 1), ("a", 3, 9.0, 0), ("a", 9, 2.0, 1)]
    state.add(spark.createDataFrame(late, SCHEMA), 1)
    assert state.late_rows() == 2
    assert values(state.table()) == by_hand([r if r[1] is not None else (r[0], -1, *r[2:]) for r in early] + late[2:])


def test_empty_stream(spark, tmp_path):
    state = S.GroupState(spark, str(tmp_path / "state"))
    assert state.table().count() == 0
    state.add(spark.createDataFrame([], SCHEMA), 0)
    assert state.table().count() == 0 and state.late_rows() == 0


def test_windowed_metrics_resume(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "ts timestamp, g string, loss double, correct int"

    def put(day, losses):
        table = spark.createDataFrame([("a", x, 1) for x in losses], "g string, loss double, correct int")
        table = table.select(F.lit(f"2024-01-{day:02d} 10:00:00").cast("timestamp").alias("ts"), "g", "loss", "correct")
        table.coalesce(1).write.mode("append").parquet(source)

    def run():
        rows = S.windowed_metrics(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), delay="30 days")
        found = S.run_available(rows, ["window_start", "g"], path=state)
        return {r.window_start.day: (r.n, r.avg_loss) for r in found.collect()}

    put(1, [1.0, 2.0])
    assert run() == {1: (2, 1.5)}
    put(1, [6.0])
    put(2, [4.0])
    assert run() == {1: (3, 3.0), 2: (1, 4.0)}
    assert run() == {1: (3, 3.0), 2: (1, 4.0)}


@pytest.mark.parametrize("gamma", [0.0, 0.5, 1.0])
def test_fold_in_parts(spark, gamma):
    rows = rows_of(120, 4)
    sums = M.batch_sums(spark.createDataFrame(rows, SCHEMA))
    parts = [M.fold_batches(sums.where(F.col("batch") < 5), gamma)]
    parts.append(M.fold_batches(sums.where(F.col("batch") >= 5), gamma, before=parts[0]))
    assert values(parts[1]) == by_hand(rows, gamma)
