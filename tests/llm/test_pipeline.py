"""The stages one after the other, each against a brute-force version of its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlab.llm import mixing, quality

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, by name."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    for name in list(stages)[:-1]:
        assert stages[name].columns == COLUMNS


def test_quality(spark, stages):
    model = quality.train(stages["documents"], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    good = {r.doc_id for r in quality.score(stages["documents"], model).collect() if r.score >= quality.THRESHOLD}
    before = texts(stages["documents"])
    assert texts(stages["quality"]) == {i: before[i] for i in good} and 0 < len(good) < len(before)


def test_lines(stages):
    before = texts(stages["quality"])

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))

    holders = {}
    for i, t in before.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    want = {i: "\n".join(line for line in t.split("\n") if key(line) not in gone or gone[key(line)] == i) for i, t in before.items()}
    rows = stages["line_dedup"].collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_near_duplicates(stages):
    before = texts(stages["line_dedup"])

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in sorted(before.items()) if t.strip()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i for i in before if i not in sets or find(i) == i}
    assert texts(stages["near_dedup"]) == {i: before[i] for i in want}


def test_mixing(stages):
    before = texts(stages["near_dedup"])
    drawn = {r.doc_id for r in mixing.sampled(stages["near_dedup"]).where("drawn").collect()}
    assert texts(stages["mixing"]) == {i: before[i] for i in drawn} and 0 < len(drawn) < len(before)


def test_tokens(stages):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    from cohortlab.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, rows = texts(stages["mixing"]), stages["tokens"].collect()
    assert sorted(r.doc_id for r in rows) == sorted(before)
    for r in rows:
        assert r.text == before[r.doc_id] and r.n_tokens == len(known.encode_ordinary(r.text))


def test_odd_tables(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (5, 1), (7, 1), (8, 1), (9, 0), (10, 1)], "doc_id long, quality int")
    for name, table in (("odd", odd), ("empty", empty)):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        labels.withColumn("toxic", F.lit(0)).write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, fn in corpus_pipeline.STAGES[:-1]:
            found = fn(spark, docs, folder)
            assert found.columns == table.columns, stage
            assert found.count() <= docs.count()
        assert corpus_pipeline.run(spark, folder).count() <= table.count()
