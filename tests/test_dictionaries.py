"""Arrays of words that are looked up where they are, or go through a shuffle as one text."""

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import dictionaries
from cohortlab.operators import text as T

ARRAYS = [[], [""], ["", ""], ["a"], ["a", "b c", ""], None, [None], ["a", None, ""], ["\x1f"], ["\x1e", "\x1ea", "\x1eb"], ["\x1f\x1e", "n"],
          ["\x1en", None, "\x1e\x1f\x1e"], ["é中", "\U00020000", "x|y\\E.*"]]


def test_packed_arrays_come_back(spark):
    rows = spark.createDataFrame(list(enumerate(ARRAYS)), "k int, a array<string>").withColumn("p", dictionaries.pack(F.col("a")))
    back = {r.k: r.b for r in rows.select("k", dictionaries.unpack(F.col("p")).alias("b")).collect()}
    assert back == dict(enumerate(ARRAYS))
    pairs = rows.alias("x").crossJoin(rows.alias("y")).where("x.a IS NOT NULL AND y.a IS NOT NULL")
    joined = pairs.select(F.col("x.k").alias("i"), F.col("y.k").alias("j"), dictionaries.unpack(F.concat("x.p", "y.p")).alias("b"))
    assert all(r.b == ARRAYS[r.i] + ARRAYS[r.j] for r in joined.collect())


def test_values_stand_in_the_places_of_their_keys(spark):
    rows = spark.createDataFrame([(1, ["x", None, "z", "x"]), (2, None), (3, []), (4, ["y"])], "k int, w array<string>")
    table = spark.createDataFrame([("x", ["p", "q"]), ("y", [])], "word string, v array<string>")
    find = dictionaries.finder(table, "word", "v")
    wanted = {1: [["p", "q"], None, None, ["p", "q"]], 2: None, 3: [], 4: [[]]}
    assert {r.k: r.v for r in rows.select("k", find("w").alias("v")).collect()} == wanted
    # tasks need not know the package
    used = [find.func.__globals__.get(n) for n in find.func.__code__.co_names]
    assert not any((getattr(v, "__module__", None) or "").startswith("cohortlab") for v in used)
    none = dictionaries.finder(table.where("false"), "word", "v")
    assert {r.k: r.v for r in rows.select("k", none("w").alias("v")).collect()} == {1: [None] * 4, 2: None, 3: [], 4: [None]}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_vocabularies_need_no_shuffle(spark):
    vocab = spark.createDataFrame([("[UNK]", 0), ("x", 1), ("y", 2)], "token string, id int")
    rows = spark.createDataFrame([(1, ["x", None, "z"]), (2, ["y"])], "k int, tokens array<string>")
    ids = T.tokens_to_ids(rows, ["k"], vocab)
    back = T.ids_to_tokens(ids, ["k"], vocab)
    assert "Exchange" not in plan_of(ids) and "Exchange" not in plan_of(back)
    with pytest.raises(Exception, match="no token has id 7"):
        T.ids_to_tokens(spark.createDataFrame([(1, [1, 7])], "k int, ids array<int>"), ["k"], vocab).collect()


@pytest.mark.parametrize("limit", [10**6, 30, 0])
def test_only_rare_words_are_shuffled(spark, monkeypatch, limit):
    """The dictionary fits, only frequent words of it do, or none; a repeated key keeps its rows apart."""
    vocab = spark.createDataFrame([("[UNK]", 0), ("a", 1), ("b", 2), ("##a", 3), ("##b", 4), ("ab", 5)], "token string, id int")
    words = ["a", "ab", "abb", "b", *[f"a{'b' * i}a" for i in range(60)], "x"]
    rows = [(i % 50, [words[min((i * 7 + j * j) % (3 + i % 90), len(words) - 1)] for j in range(i % 23)] + [""] * (i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, words array<string>")
    whole = sorted((r.k, r.tokens) for r in T.tokenize_words(df, ["k"], vocab).collect())
    monkeypatch.setattr(T, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(T, "fits", lambda d, *a: limit > 30)
    assert sorted((r.k, r.tokens) for r in T.tokenize_words(df, ["k"], vocab).collect()) == whole
    pieces = {"": [], "x": ["[UNK]"]}
    for w in words[:-1]:
        pieces[w] = [w[:2], *["##" + c for c in w[2:]]] if w.startswith("ab") else [w[:1], *["##" + c for c in w[1:]]]
    assert whole == sorted((k, [p for w in ws for p in pieces[w]]) for k, ws in rows)
