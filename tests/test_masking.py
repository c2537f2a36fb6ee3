import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.functions import arrays, masking
from cohortlab.functions.rand import u
from cohortlab.operators import instances as I


def number(*keys):
    text = "|".join(str(k) for k in keys if k is not None)
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


def masked_by_hand(keys, tokens, words, seed, prob, most, whole):
    """One row, token by token."""
    n = min(most, max(1, round(len(tokens) * prob)))
    usable = [i for i, t in enumerate(tokens) if t is not None and t not in (I.CLS, I.SEP)]
    groups = []
    for i in usable:
        if whole and groups and tokens[i].startswith("##"):
            groups[-1].append(i)
        else:
            groups.append([i])
    chosen = []
    for g in sorted(groups, key=lambda g: (number(seed, "mask", *keys, g[0]), g[0])):
        if len(chosen) + len(g) <= n:
            chosen += g
    out = list(tokens)
    for i in chosen:
        if number(seed, "hide", *keys, i) < 0.8:
            out[i] = I.MASK
        elif number(seed, "keep", *keys, i) >= 0.5 and words:
            out[i] = words[int(number(seed, "word", *keys, i) * len(words))]
    chosen.sort()
    return out, chosen, [tokens[i] for i in chosen]


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("large", [False, True])
def test_masking_equals_the_definition(spark, monkeypatch, whole, large):
    """Short and long keys, a null one, other alphabets, null tokens, empty rows, pieces at both ends, long rows."""
    rng = np.random.default_rng(3)
    pieces = ["a", "##b", "##c", "wörter", "犬", "", None, I.CLS, I.SEP, "##", "x#"]
    keys = [(7, "short"), (-3, None), (12, "é" * 24), (5, "k" * 60), (6, "")]
    rows = []
    for i in range(120):
        size = int(rng.choice([0, 1, 2, 30, 64, 1200]))
        rows.append((keys[i % 5][0] + 100 * i, keys[i % 5][1], [pieces[j] for j in rng.integers(0, len(pieces), size)]))
    rows.append((1, "none", []))
    words = [f"w{i}" for i in range(37)]
    vocab = spark.createDataFrame([(w, 5 * i) for i, w in enumerate(words)], "token string, id int")
    df = spark.createDataFrame(rows, "k long, name string, tokens array<string>").repartition(3)
    if large:
        df = df.where("name is not null")  # a larger vocabulary is joined by the keys
        monkeypatch.setattr(I, "fits", lambda *a: False)
    out = I.mask_tokens(df, ["k", "name"], vocab, 7, 0.15, 40, whole)
    if not large:
        # draws of all tokens are made together, not one by one in an expression
        assert "md5(" not in out._jdf.queryExecution().executedPlan().toString()
    found = {(r.k, r.name): (r.tokens, r.masked_lm_positions, r.masked_lm_labels) for r in out.collect()}
    wanted = {(k, name): masked_by_hand((k, name), tokens, words, 7, 0.15, 40, whole) for k, name, tokens in rows if not large or name is not None}
    assert found == wanted and any(t != w for (t, _, _), (_, _, w) in zip(found.values(), rows))


def test_an_empty_vocabulary_swaps_nothing(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), F.array_repeat(F.lit("t"), 9).alias("tokens"))
    out = I.mask_tokens(rows, ["k"], spark.createDataFrame([], "token string, id int"), 7, 0.5).collect()
    assert {t for r in out for t in r.tokens} == {"t", I.MASK} and {len(r.masked_lm_positions) for r in out} == {4}


def test_draws_of_a_batch_are_those_of_the_expression(spark):
    draw = masking.drawer()
    texts = [b"", b"|1", b"|" + b"x" * 45, b"|" + b"y" * 70, "|\u00e9\u72ac".encode()]
    rows, numbers = np.repeat(np.arange(5), 9), np.tile([0, 9, 10, 99, 100, 12345, 999_999, 10**9, 10**12], 5)
    found = draw("3|mask", texts, rows, numbers)
    wanted = [int(hashlib.md5(b"3|mask" + texts[r] + b"|%d" % n).hexdigest()[:8], 16) for r, n in zip(rows, numbers)]
    assert found.tolist() == wanted


def test_truncation_draws_as_before(spark):
    """One token is lost at a time, at the front or the back."""
    rows = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i.cast("string")).alias("a"))
    out = rows.select("id", arrays.truncate_random(F.col("a"), (F.col("id") - 5).cast("int"), 3, "a", F.col("id")).alias("a")).where("id >= 5")
    for r in out.collect():
        left = min(40, r.id - 5)
        fronts = sum(number(3, "a", r.id, i) < 0.5 for i in range(1, 40 - left + 1))
        assert r.a == [str(i) for i in range(1, 41)][fronts:fronts + left]
    assert spark.range(50).where((u(3, F.col("id")) < 0.5) != (F.md5(F.concat_ws("|", F.lit("3"), F.col("id").cast("string"))) < "8")).count() == 0


def test_texts_are_sent_once_for_all_epochs(spark, monkeypatch):
    """No text is stored, and the text of a segment is repeated for the epochs' chunks behind the last shuffle."""
    stored, materialize = [], I.materialize

    def noted(df, name="table"):
        stored.append([t for _, t in df.dtypes])
        return materialize(df, name)

    monkeypatch.setattr(I, "materialize", noted)
    rows = [(d, s, [f"t{d}", f"s{s}", "x"] * (1 + s % 4)) for d in range(9) for s in range(1 + 4 * d)]
    segments = spark.createDataFrame(rows, "doc_id long, seg_no long, tokens array<string>")
    many = I.make_pairs(segments, 5, 3, 24)
    assert not any("string" in kind for kinds in stored for kind in kinds)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("explode(chunks")] and "Join" not in plan[:plan.index("explode(chunks")]
    # small blocks deal a document out in parts and change nothing
    parts = I.make_pairs(segments, 5, 3, 24, block=24)
    assert parts.select(F.col("epoch")).distinct().count() == 3
    assert sorted(map(repr, many.collect())) == sorted(map(repr, parts.collect()))


def test_pieces_are_cut_where_a_word_is(spark, monkeypatch):
    """A small vocabulary needs no row for each part of a word, and gives the pieces of the join."""
    from cohortlab.operators import text as T

    tokens = ["a", "ab", "abc", "##c", "##cd", "##d", "##", "##x", "é", "##é", "犬", "\U00020000", "##\U00020000", None]
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id int")
    rng = np.random.default_rng(5)
    words = ["", "abcd", "##x", "##", "a" + "c" * 99, "a" + "c" * 100, None, "abq"]
    words += ["".join(rng.choice(list("abcdxé犬\U00020000"), rng.integers(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in words + words[:50]], "word string")
    near = T.wordpiece(df, vocab)
    assert "Generate" not in near._jdf.queryExecution().executedPlan().toString()
    found = {r.word: r.pieces for r in near.collect()}
    assert near.count() == len(set(words)) == len(found)
    monkeypatch.setattr(T, "fits", lambda *a: False)
    assert {r.word: r.pieces for r in T.wordpiece(df, vocab).collect()} == found
    assert found["abcd"] == ["abc", "##d"] and found["a" + "c" * 100] == [T.UNK] and found[""] == []


def test_labels_of_a_row_are_one_map(spark):
    from cohortlab.operators import encode as E

    vocab = spark.createDataFrame([("[UNK]", 1), ("a", 2), ("b", 3)], "token string, id int")
    rows = [(1, ["a", "b", "z"], [0, 0, 1], True, [1, 2], ["a", "z"]), (2, ["a"], [0], False, [], [])]
    made = spark.createDataFrame(rows, "k int, tokens array<string>, segment_ids array<int>, is_random_next boolean, "
                                 "masked_lm_positions array<int>, masked_lm_labels array<string>")
    out = E.pack_lm_features(made, ["k"], vocab, 5)
    assert "array(map_from_arrays(" in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r.k: (r.input_ids, r.input_mask, r.segment_ids, r.lm_label_ids, r.is_next) for r in out.collect()}
    assert found == {1: ([2, 3, 1, 0, 0], [1, 1, 1, 0, 0], [0, 0, 1, 0, 0], [-1, 2, 1, -1, -1], True),
                     2: ([2, 0, 0, 0, 0], [1, 0, 0, 0, 0], [0, 0, 0, 0, 0], [-1, -1, -1, -1, -1], False)}
