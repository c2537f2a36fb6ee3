"""Segments by brute force, passages in made texts, and held-out documents."""

import numpy as np
from pyspark.sql import functions as F

from cohortlab.llm import toxicity

SF_DIR = "/root/testdata/sf0.01"


def _maximal(s):
    """The best segment, and the same on both sides of it."""
    best, at = 0, None
    for i in range(len(s)):
        total = 0
        for j in range(i, len(s)):
            total += s[j]
            if total > best:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return _maximal(s[:i]) + [(best, i, j)] + [(v, a + j, b + j) for v, a, b in _maximal(s[j:])]


def test_segments():
    rng = np.random.default_rng(0)
    rows = [rng.integers(-50_000, 50_000, rng.integers(0, 25)) for _ in range(1000)]
    for s in rows:
        assert toxicity.maximal_segments(s) == _maximal(s.tolist())
    row = np.repeat(np.arange(len(rows)), [len(s) for s in rows])
    best = toxicity.best_sums(np.concatenate(rows), row, len(rows))
    assert best.tolist() == [max((v for v, _, _ in _maximal(s.tolist())), default=0) for s in rows]
    # linear: a descending staircase keeps many open candidates
    steps = np.tile([5, -9], 100_000)
    assert len(toxicity.maximal_segments(steps)) == 100_000


def test_rate():
    # for steps of +1 and -1 the rate is the log of the odds
    assert abs(toxicity.growth_rate(np.array([1.0, -1.0]), np.array([0.25, 0.75])) - np.log(3)) < 1e-6


def test_passages_have_places(spark):
    rng = np.random.default_rng(5)
    words = [f"wört{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(400):
        text = rng.choice(words, 80).tolist()
        if i % 4 == 0:
            text[30:33] = ["vile", "awful", "nasty"]
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(i % 4 == 0)))
    documents = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.train(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
    text = dict((i, t) for i, t, _ in rows)
    for r in toxicity.find_passages(documents, model).collect():
        assert [text[r.doc_id][p.start : p.end] for p in r.passages] == (["vile awful nasty"] if r.doc_id % 4 == 0 else [])
        assert (r.score > 0.9) == (r.doc_id % 4 == 0)


def test_held_out(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = [r for r in toxicity.op12_toxicity(spark, SF_DIR).collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.9  # some labels of the table are wrong


def test_odd_tables(odd, empty, spark):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (7, 1), (9, 0), (9, 0), (None, 1), (6, None), (6, 3)], "doc_id long, toxic int")
    for table in (odd, empty):
        for given in (labels, labels.where("toxic = 1"), labels.where("false")):
            rows = toxicity.find_passages(table, toxicity.train(table, given))
            assert rows.count() == table.count() and rows.where(~F.col("score").between(0, 1)).count() == 0
