import sys
import unicodedata

from pyspark.sql import functions as F

from cohortlab.functions import sizing
from cohortlab.operators import text as T


def test_accents_match_unicode_decomposition_for_every_character(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    rows = [(c, chr(c)) for c in codes if unicodedata.normalize("NFD", chr(c)) != chr(c) or c < 0x3000]
    df = spark.createDataFrame(rows, "code int, text string")
    got = {r.code: r.text for r in T.lower_strip_accents(df).collect()}
    lowered = {r.code: r.l for r in df.select("code", F.lower("text").alias("l")).collect()}
    for code, _ in rows:
        plain = "".join(c for c in unicodedata.normalize("NFD", lowered[code]) if unicodedata.category(c) != "Mn")
        assert got[code] == plain, hex(code)


def test_basic_words(spark):
    texts = {
        "Don't  stop\t[MASK] it[SEP]": ["don", "'", "t", "stop", "[MASK]", "it", "[", "sep", "]"],
        "a\x01b�c": ["abc"],
        "été 中文x": ["ete", "中", "文", "x"],
        "x y z": ["x", "y", "z"],
        "\ud55c": [unicodedata.normalize("NFD", "\ud55c")],
        "": [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.words for r in T.basic_tokenize(df).select("i", "words").collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def greedy(word, vocab):
    pieces, start = [], 0
    if len(word) > 100:
        return ["[UNK]"]
    while start < len(word):
        for end in range(len(word), start, -1):
            piece = ("##" if start else "") + word[start:end]
            if piece in vocab:
                break
        else:
            return ["[UNK]"]
        pieces.append(piece)
        start = end
    return pieces


def test_wordpiece_equals_greedy_loop(spark):
    vocab = ["[UNK]", "un", "##aff", "##able", "a", "##a", "##b", "ab", "aba", "##ab", "c"]
    import itertools
    words = ["unaffable", "x", "a" * 101, "a" * 100, "cc"] + ["".join(p) for n in (1, 2, 3, 4, 5) for p in itertools.product("ab", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    table = spark.createDataFrame([(t, i) for i, t in enumerate(vocab)], "token string, id int")
    got = {r.word: r.pieces for r in T.wordpiece(df, table).collect()}
    # Fixed value: the usual example of the definition.
    assert got["unaffable"] == ["un", "##aff", "##able"]
    assert got == {w: greedy(w, set(vocab)) for w in words}


def test_few_candidate_spans(spark):
    """The parts looked up are few against all substrings, and none that matches is left out."""
    import random

    rng = random.Random(3)
    vocab = {"[UNK]", "##x", "é", "##ss"} | {"##" * (i % 2) + "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(1, 9))) for i in range(400)}
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(1, 25))) for _ in range(300)] + ["##xss", "éss", "##x"]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    table = spark.createDataFrame([(t, i) for i, t in enumerate(sorted(vocab))], "token string, id int")
    spans = T.candidate_spans(df, table).collect()
    longest = max(len(t.removeprefix("##")) for t in vocab)
    everything = sum(min(longest, len(w) - i) for w in set(words) for i in range(len(w)))
    assert 5 * len(spans) <= everything
    found = {(r.word, r.start, r.len) for r in spans}
    assert len(found) == len(spans)
    for w in set(words):
        for i in range(len(w)):
            for n in range(1, len(w) - i + 1):
                if ("##" if i else "") + w[i : i + n] in vocab:
                    assert (w, i + 1, n) in found
    got = {r.word: r.pieces for r in T.wordpiece(df, table).collect()}
    assert got == {w: greedy(w, vocab) for w in words}


def test_lookup_is_the_same_with_hot_and_cold_keys(spark, monkeypatch):
    rows = [("hot", i) for i in range(300)] + [(f"w{i % 40}", i) for i in range(200)] + [(None, 1)]
    df = spark.createDataFrame(rows, "word string, n int")
    dictionary = spark.createDataFrame([("hot", "H")] + [(f"w{i}", f"W{i}") for i in range(40)], "word string, v string")
    small = sorted(map(tuple, T.lookup(df, "word", dictionary).select("word", "n", "v").collect()), key=str)
    monkeypatch.setattr(T, "HOT_KEYS", 4)
    monkeypatch.setattr(T, "fits", lambda d, m=4: sizing.fits(d, 4))
    large = sorted(map(tuple, T.lookup(df, "word", dictionary).select("word", "n", "v").collect()), key=str)
    assert small == large and len(small) == len(rows)


def test_empty_texts_keep_their_rows(spark):
    vocab = spark.createDataFrame([("[UNK]", 0), ("a", 1)], "token string, id int")
    df = spark.createDataFrame([(1, "a a"), (2, "")], "k int, text string")
    tokens = T.tokenize(df, ["k"], vocab)
    ids = {r.k: r.ids for r in T.tokens_to_ids(tokens, ["k"], vocab).collect()}
    assert ids == {1: [1, 1], 2: []}


def test_texts_to_ids_in_one_go(spark):
    vocab = spark.createDataFrame([("[UNK]", 0), ("a", 1), ("##b", 2), ("c", 3), (".", 4)], "token string, id int")
    df = spark.createDataFrame([(1, "A ab. abb"), (2, ""), (3, None), (4, "zz c c")], "k int, text string")
    for basic in (True, False):
        pieces = T.tokenize(df, ["k"], vocab, basic=basic)
        want = {r.k: r.ids for r in T.tokens_to_ids(pieces, ["k"], vocab).collect()}
        assert {r.k: r.ids for r in T.text_to_ids(df, ["k"], vocab, basic=basic).collect()} == want
    assert want[4] == [0, 3, 3] and want[2] == want[3] == []


def test_texts_are_normalized_once(spark, monkeypatch, tmp_path):
    """Only the stored words read the texts; everything behind them reads what is stored."""
    vocab = spark.createDataFrame([("[UNK]", 0), ("a", 1)], "token string, id int")
    spark.createDataFrame([(1, "a b"), (2, "b")], "k int, text string").write.parquet(str(tmp_path / "texts"))
    stored, read = [], spark.read.parquet(str(tmp_path / "texts"))
    materialize = T.materialize

    def noted(df, name="table"):
        stored.append((name, any("texts" in f for f in df.inputFiles())))
        return materialize(df, name)

    monkeypatch.setattr(T, "materialize", noted)
    out = T.text_to_ids(read, ["k"], vocab)
    assert [name for name, texts in stored if texts] == ["worded"] and not any("texts" in f for f in out.inputFiles())
