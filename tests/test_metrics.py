"""Task metrics from one scan, metric call-backs, and single texts with an empty second one."""

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import encode as E
from cohortlab.operators import metrics as M
from cohortlab.operators import runs as R


def test_all_tasks_from_one_scan(spark, tmp_path):
    rows = [(t, float((i * 7) % 3 if t == "mnli" else i % 2), float((i * 5) % 3 if t == "mnli" else (i // 2) % 2))
            for t in M.TASK_METRICS if t != "sts-b" for i in range(37)]
    rows += [("sts-b", float(i % 9), float((i * i) % 11)) for i in range(50)]
    table = spark.createDataFrame(rows, "task string, pred double, y double")
    table.write.parquet(str(tmp_path / "scores"))
    stored = spark.read.parquet(str(tmp_path / "scores"))
    out = M.all_task_metrics(stored)
    # the stored counts are all that the result reads
    assert not any("scores" in f for f in out.inputFiles())
    got = {(r.task, r.metric): r.value for r in out.collect()}
    for task, kind in M.TASK_METRICS.items():
        own = table.where(F.col("task") == task)
        if kind == "correlation":
            want = M.pearson_and_spearman(own).first().asDict()
        elif kind == "mcc":
            want = M.mcc(own).first().asDict()
        else:
            want = {**M.accuracy(own).first().asDict(), **(M.acc_and_f1(own).first().asDict() if kind == "acc_and_f1" else {})}
        assert {m: v for (t, m), v in got.items() if t == task} == pytest.approx(want)
    with pytest.raises(KeyError):
        M.all_task_metrics(table, ["no such task"])


def test_a_missing_label_is_an_error(spark):
    table = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 4.0)], "pred double, y double")
    with pytest.raises(ValueError, match="1 pairs"):
        M.pearson_and_spearman(table)


def test_metric_call_back(spark):
    rows = [("r", 0, 0.5, 0.9), ("r", 1, 0.7, 0.1), ("r", 2, 0.6, 0.8), ("r", 3, None, 0.2)]
    table = spark.createDataFrame(rows, "run string, epoch int, acc double, worst double")
    mean = lambda: (F.col("acc") + F.col("worst")) / 2
    best = R.best_epoch(table, ["run"], mean).first()
    assert (best.best_epoch, best.best_value) == (0, pytest.approx(0.7))
    assert R.best_epoch(table, ["run"], "acc").first().best_epoch == 1
    least = R.best_epoch(table, ["run"], "worst", larger_better=False).first()
    assert (least.best_epoch, least.best_value) == (1, pytest.approx(0.1))
    assert R.early_stop(table.where("acc IS NOT NULL"), ["run"], mean, patience=2).first().stop_epoch == 2


def test_an_empty_second_text_is_none(spark):
    table = spark.createDataFrame([(list(range(10, 30)), []), (list(range(10, 30)), None), ([7], [8])], "ids_a array<int>, ids_b array<int>")
    out = [r.input_ids for r in E.encode(table, 8, E.Layout(cls_id=1, sep_id=2)).collect()]
    assert out == [[1, 10, 11, 12, 13, 14, 15, 2]] * 2 + [[1, 7, 2, 8, 2, 0, 0, 0]]


def test_slices_report_all_groups_from_one_scan(spark, tmp_path):
    from cohortlab.operators.groups import GroupSpace

    rows = [("a", 0, 1.0, 1), ("a", 0, 3.0, 0), ("b", 2, 5.0, 1), (None, 3, 2.0, 0)]
    spark.createDataFrame(rows, "lang string, g int, loss double, correct int").write.parquet(str(tmp_path / "rows"))
    out = M.group_metrics(spark.read.parquet(str(tmp_path / "rows")), GroupSpace(2, 2), by=["lang"])
    assert not any("/rows/" in f for f in out.inputFiles())
    got = {(r.lang, r.g): (r.n, r.avg_loss, r.avg_acc) for r in out.collect()}
    want = {(s, g): (0, 0.0, 0.0) for s in ("a", "b", None) for g in range(4)}
    assert got == want | {("a", 0): (2, 2.0, 0.5), ("b", 2): (1, 5.0, 1.0), (None, 3): (1, 2.0, 0.0)}


def test_empty_tables_and_missing_terms(spark):
    from cohortlab.operators import vectors as V

    empty = spark.createDataFrame([], "id int, embedding array<double>")
    assert V.quantize_static(empty, V.calibrate(empty)).count() == 0
    errors = spark.createDataFrame([(0, 1.0)], "layer int, mse double")
    with pytest.raises(ValueError):
        V.distillation_loss(errors, None, use_attention=False)
