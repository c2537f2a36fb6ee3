import random

import pytest
from pyspark.sql import functions as F

from cohortlab.functions.rand import u
from cohortlab.operators import groups as G
from cohortlab.operators import metrics as M
from cohortlab.operators import ordering as O
from cohortlab.operators import runs as R
from cohortlab.operators import text as T


def test_dense_index_and_prefix_sums(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "k int, n int").repartition(5)
    got = {r.k: (r.i, r.before) for r in O.prefix_sums(O.dense_index(df, ["k"], "i"), ["k"], {"before": F.col("n")}).collect()}
    total = 0
    for k in range(1000):
        assert got[k] == (k, total)
        total += k % 7


def test_running_sums_do_not_depend_on_blocks(spark):
    rows = [(g, t, t * (g + 1)) for g in range(2) for t in range(50)]
    df = spark.createDataFrame(rows, "g int, t int, v int")
    results = [
        sorted((r.g, r.t, r.s) for r in O.running_sums(df, ["g"], "t", {"s": F.col("v")}, block=b).collect())
        for b in (1, 7, 4096)
    ]
    assert results[0] == results[1] == results[2]
    assert results[0][-1] == (1, 49, 2 * sum(range(50)))


@pytest.mark.parametrize("n", [1_000, 120_000])
def test_kth_smallest_of_any_type(spark, monkeypatch, n):
    """Ties, nulls and texts on both sides of any size; one scan for each digit."""
    scans = []
    histogram = O._histogram
    monkeypatch.setattr(O, "_histogram", lambda *a: scans.append(1) or histogram(*a))
    i = F.col("id")
    value = F.when(i % 7 == 0, None).when(i % 3 == 0, F.lit(0.0)).when(i % 5 == 0, F.lit(-0.0)).otherwise(F.sin(i) * F.pow(F.lit(10.0), i % 40 - 20))
    name = F.when(i % 11 == 0, None).otherwise(F.concat(F.lit("k"), F.substring(F.md5((i % 900).cast("string")), 1, (i % 5).cast("int"))))
    df = spark.range(n).select(value.alias("v"), name.alias("s"), i.alias("i"))
    df.write.mode("overwrite").parquet(path := f"/tmp/kth-{n}-{random.randrange(1 << 40)}")
    df = spark.read.parquet(path)
    rows = [(r.v, r.s, r.i) for r in df.collect()]
    for order in (["v", "s", "i"], ["s", "v", "i"]):
        places = ["vsi".index(c) for c in order]
        none_first = lambda r: [(r[p] is not None, r[p] if r[p] is not None else 0) for p in places]
        ordered = sorted(rows, key=lambda r: [(flag, x + 0 if isinstance(x, float) else x) for flag, x in none_first(r)])
        for k in (1, n // 9, n // 2, n - 1, n):
            scans.clear()
            key = O.kth_smallest(df, order, k)
            assert key == tuple(ordered[k - 1][p] for p in places)
            assert len(scans) <= 4 + 4 + 3  # a number, an id, and up to five letters, two to a digit
            assert k > 1000 or df.where(O.at_most(order, key)).count() == k
    with pytest.raises(ValueError):
        O.kth_smallest(df, ["i"], n + 1)


def test_kth_smallest_with_many_ties(spark):
    rows = [(0.0, i) for i in range(400)] + [(random.Random(i).random(), i) for i in range(600)]
    df = spark.createDataFrame(rows, "v double, i int")
    for k in (1, 399, 400, 401, 777, 1000):
        key = O.kth_smallest(df, ["v", "i"], k)
        assert key == sorted(rows)[k - 1]
        assert df.where(O.at_most(["v", "i"], key)).count() == k
    same = spark.createDataFrame([(2.5, "x")] * 50, "v float, s string")
    assert O.kth_smallest(same, ["v", "s"], 50) == (2.5, "x")
    days = spark.sql("SELECT date_add(DATE '1969-12-20', cast(id AS int)) AS d, cast(id - 5 AS decimal(10,2)) / 4 AS x FROM range(30)")
    for column in ("d", "x"):
        ordered = sorted(r[0] for r in days.select(column).collect())
        assert [O.kth_smallest(days.select(F.col(column).cast("decimal(12,3)") if column == "x" else column), [column], k)[0] for k in (1, 13, 30)] == [ordered[0], ordered[12], ordered[29]]


def test_sample_has_exact_size_and_ignores_partitioning(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, 0).otherwise(2).alias("split"))
    a = sorted(r.id for r in G.sample_split(df.repartition(1), 0.25, 3, "id").collect())
    b = sorted(r.id for r in G.sample_split(df.repartition(8), 0.25, 3, "id").collect())
    assert a == b and len(a) == 225 + 100


def test_random_number_is_fixed(spark):
    value = spark.range(1).select(u(1, 2).alias("u")).first().u
    assert value == 2992201373 / 2**32


def test_group_rules(spark):
    df = spark.createDataFrame([(0.5, None), (0.4, 0.9), (float("nan"), 0.5)], "a double, b double")
    coded = G.confounder_code(G.threshold_label(df, "a"), ["a", "b"])
    assert [(r.y, r.c) for r in coded.collect()] == [(1, 1), (0, 2), (0, 2)]
    import pytest
    with pytest.raises(ValueError):
        G.take_split(df, "dev")


def test_null_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), (None, 0, 5), (None, 1, 7)], "k string, o long, v long")
    got = {(r.k, r.o): r.s for r in O.running_sums(rows, ["k"], "o", {"s": F.col("v")}, block=1).collect()}
    assert got == {("a", 0): 1, ("a", 1): 3, (None, 0): 5, (None, 1): 12}


def test_natural_keys_of_any_length(spark):
    names = ["run-" + "1" * 30, "run-" + "2" * 29, "run-0009", "run-10", "run-9x"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in rows.orderBy(R.natural_key(F.col("n")), "n").collect()]
    assert got == ["run-0009", "run-9x", "run-10", "run-" + "2" * 29, "run-" + "1" * 30]


def test_null_tokens_keep_their_place(spark):
    vocab = spark.createDataFrame([("[UNK]", 0), ("a", 1)], "token string, id long")
    rows = spark.createDataFrame([(1, ["a", None, "a", "b"]), (2, []), (3, None)], "k long, tokens array<string>")
    got = {r.k: r.ids for r in T.tokens_to_ids(rows, ["k"], vocab).collect()}
    assert got == {1: [1, 0, 1, 0], 2: [], 3: []}


def test_a_slice_without_a_group_has_worst_accuracy_zero(spark):
    space = G.GroupSpace(2, 2)
    rows = spark.createDataFrame([("x", g, 0.5, 1) for g in range(4)] + [("y", g, 0.5, 1) for g in (0, 2, 3)],
                                 "run string, g int, loss double, correct int")
    groups = M.group_metrics(rows, space, by=["run"])
    assert groups.count() == 8
    assert {r.run: r.worst_acc for r in M.robustness_summary(groups, by=["run"]).collect()} == {"x": 1.0, "y": 0.0}
