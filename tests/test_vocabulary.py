"""Transferred vocabularies are complete, look-ups bear hot keys, and masking takes any vocabulary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions import sizing
from cohortlab.operators import instances as I
from cohortlab.operators import text as T
from cohortlab.operators import vectors as V

OLD = [("[UNK]", 0, [8.0, 8.0]), ("a", 1, [1.0, 0.0]), ("##b", 2, [0.0, 1.0]), ("##cc", 3, [2.0, 4.0]), ("d", 4, [6.0, 0.0])]
NEW = [("a", 0), ("abcc", 1), ("##acc", 2), ("xyz", 3), ("##", 4), ("d_ab", 5), ("_", 6)]


def transfer(spark, old, init, **options):
    table = spark.createDataFrame(old, "token string, id int, embedding array<double>")
    out = V.vocab_transfer(table, spark.createDataFrame(NEW, "token string, id int"), init, **options)
    return {r.token: r.embedding for r in out.collect()}


def test_every_new_token_gets_a_vector(spark):
    got = transfer(spark, OLD, "FVT", ngrams=True)
    assert got == {"a": [1, 0], "abcc": [1, 5 / 3], "##acc": [1.5, 2], "xyz": [8, 8], "##": [8, 8],
                   "d_ab": [pytest.approx(7 / 3), pytest.approx(1 / 3)], "_": [8, 8]}
    got = transfer(spark, OLD, "WVT", ngrams=True)
    assert got["abcc"] == [1 / 4 + 2 * 2 / 4, 1 / 4 + 4 * 2 / 4] and len(got) == len(NEW)
    # [UNK] is longer than the token: its weight follows from the formula
    assert got["xyz"] == [8 * 5 / 3, 8 * 5 / 3] and got["##"] == [8, 8]


def test_without_an_unknown_vector_zeros_count(spark):
    got = transfer(spark, OLD[1:], "FVT")
    assert len(got) == len(NEW) and got["xyz"] == [0, 0] and got["##"] == [0, 0] and got["abcc"] == [1, 5 / 3]
    assert transfer(spark, [], "FVT")["a"] == []


def test_hot_piece(spark, monkeypatch):
    """A piece that nearly all tokens share, with a dictionary too large to broadcast."""
    monkeypatch.setattr(T, "fits", lambda *a: False)
    monkeypatch.setattr(T, "HOT_KEYS", 50)
    rows = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).when(F.col("id") % 10 < 9, "hot").alias("token"), "id")
    dictionary = spark.range(3000).select(F.when(F.col("id") == 1, "hot").otherwise(F.col("id").cast("string")).alias("token"), F.col("id").alias("v"))
    found = T.lookup(rows, "token", dictionary)
    got = {r.id: r.v for r in found.collect()}
    assert got == {i: i if i % 10 == 0 else 1 if i % 10 < 9 else None for i in range(2000)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" in plan


def test_ids_and_back(spark, monkeypatch):
    vocab = spark.createDataFrame([("[UNK]", 0), ("x", 1), ("y", 2)], "token string, id int")
    rows = spark.createDataFrame([(1, ["x", None, "z"]), (2, ["x"] * 500), (3, [])], "k int, tokens array<string>")
    wanted = {1: [1, 0, 0], 2: [1] * 500, 3: []}
    for small in (True, False):
        monkeypatch.setattr(T, "fits", lambda *a, small=small: small)
        ids = T.tokens_to_ids(rows, ["k"], vocab)
        assert {r.k: r.ids for r in ids.collect()} == wanted
        back = T.ids_to_tokens(ids, ["k"], vocab)
        assert {r.k: r.tokens for r in back.collect()} == {1: ["x", "[UNK]", "[UNK]"], 2: ["x"] * 500, 3: []}
        assert T.ids_to_tokens(ids, ["k"], vocab).where("k = 3").first().decoded == ""


def test_broadcasts_are_bounded_by_bytes(spark):
    rows = spark.range(100).select(F.array_repeat(F.lit(1.0), 1000).alias("v"), F.lit("é" * 10).alias("s"))
    assert rows.select(sizing.row_bytes(rows)).first()[0] == 16 + 8016 + 36
    assert sizing.fits(rows) and not sizing.fits(rows, max_bytes=800_000) and not sizing.fits(rows, max_rows=99)
    nested = spark.createDataFrame([(["ab", None], (1, None))], "a array<string>, s struct<x:int,y:string>")
    assert nested.select(sizing.row_bytes(nested)).first()[0] == 16 + (16 + 18 + 16) + (16 + 8 + 16)


def test_masking_with_a_large_vocabulary(spark):
    n = 300_000
    vocab = spark.range(n).select(F.concat(F.lit("word"), F.col("id")).alias("token"), (F.col("id") * 3 + 5).cast("int").alias("id"))
    rows = spark.range(300).select(F.col("id").alias("k"), F.concat(
        F.array(F.lit("[CLS]")), F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(F.lit("t"), i.cast("string"))),
        F.array(F.lit("[SEP]"))).alias("tokens"))
    out = I.mask_tokens(rows, ["k"], vocab, 7, 0.3, max_predictions=19).collect()
    assert len(out) == 300
    whole = ["[CLS]", *[f"t{i}" for i in range(61)], "[SEP]"]
    swapped = []
    for r in out:
        assert len(r.masked_lm_positions) == 19 and r.masked_lm_labels == [whole[i] for i in r.masked_lm_positions]
        assert all(t == whole[i] for i, t in enumerate(r.tokens) if i not in r.masked_lm_positions)
        swapped += [t for i in r.masked_lm_positions if (t := r.tokens[i]) not in ("[MASK]", whole[i])]
    assert 0.07 < len(swapped) / (300 * 19) < 0.13
    places = np.array([int(t.removeprefix("word")) for t in swapped])
    assert places.max() > 0.95 * n and places.min() < 0.05 * n and len(set(swapped)) > 0.95 * len(swapped)
