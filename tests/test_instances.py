import random
import time

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import arrays
from cohortlab.operators import instances as I
from cohortlab.operators.vectors import layer_map
from cohortlab.sources import files


def loop_lengths(a, b, m):
    while a + b > m:
        a, b = (a - 1, b) if a > b else (a, b - 1)
    return a, b


def test_pair_lengths_equal_the_loop(spark):
    rows = [(a, b) for a in range(12) for b in range(12)]
    df = spark.createDataFrame(rows, "a int, b int")
    for m in range(1, 16):
        la, lb = arrays.pair_lengths(F.col("a"), F.col("b"), m)
        for r in df.select("a", "b", la.alias("la"), lb.alias("lb")).collect():
            assert (r.la, r.lb) == loop_lengths(r.a, r.b, m)


def corpus(spark, docs=12, seed=5):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        n = rng.choice([1, 2, 5, 40]) if d else 300  # one document holds most segments
        for s in range(n):
            rows.append((d, s, [f"t{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 3, 9, 30]))]))
    return spark.createDataFrame(rows, "doc_id long, seg_no long, tokens array<string>"), rows


def test_chunks_do_not_depend_on_blocks_and_cover_each_document(spark):
    segments, rows = corpus(spark)
    positions = I.segment_positions(segments)
    plans = [
        sorted(tuple(r) for r in I.chunk_plan(positions, 3, 2, 32, 0.3, block=b).select(
            "epoch", "doc_id", "seg_no", "a_end", "seg_end", "random_next", "target").collect())
        for b in (32, 100, I.BLOCK_TOKENS)
    ]
    assert plans[0] == plans[1] == plans[2]
    last = {d: max(s for e, s, _ in rows if e == d) for d in range(12)}
    for epoch in (0, 1):
        for doc in range(12):
            expected = 0
            for e, d, start, a_end, end, foreign, _ in plans[0]:
                if (e, d) == (epoch, doc):
                    assert start == expected and start < a_end <= end + 1
                    expected = a_end if foreign else end + 1
            assert expected == last[doc] + 1


def test_pieces_do_not_change_the_plan(spark, monkeypatch):
    """Pieces of few segments, long segments at their borders, and runs of empty ones."""
    rng = random.Random(11)
    sizes = [rng.choice([0, 0, 0, 1, 2, 40, 90]) for _ in range(700)]
    rows = [(d, s, ["t"] * n) for d in (0, 1) for s, n in enumerate(sizes if d else sizes[:30] + [0] * 200 + [300] + sizes[:50])]
    positions = I.segment_positions(spark.createDataFrame(rows, "doc_id long, seg_no long, tokens array<string>"))
    plans = []
    for pieces, block in ((1 << 14, I.BLOCK_TOKENS), (8, 40), (37, 1000), (64, I.BLOCK_TOKENS)):
        monkeypatch.setattr(I, "PIECE_SEGMENTS", pieces)
        plan = I.chunk_plan(positions, 3, 2, 32, 0.3, block=block)
        plans.append(sorted(tuple(r) for r in plan.select("epoch", "doc_id", "seg_no", "a_end", "seg_end", "random_next").collect()))
    assert plans[0] == plans[1] == plans[2] == plans[3] and len(plans[0]) > 200


@pytest.mark.parametrize("tokens", [1, 0])
def test_many_short_lines_in_one_document(spark, tokens):
    """200,000 lines of one token, or of none, take linear time."""
    lines = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("seg_no"), F.array_repeat(F.lit("t"), tokens).alias("tokens"))
    other = spark.createDataFrame([(2, 0, ["x"]), (2, 1, ["y"])], "doc_id int, seg_no long, tokens array<string>")
    started = time.time()
    plan = I.chunk_plan(I.segment_positions(lines.unionByName(other)), 5, 1).where("doc_id = 1").collect()
    assert time.time() - started < 90
    starts = {r.seg_no: r.a_end if r.random_next else r.seg_end + 1 for r in plan}
    at = 0
    while at < 200_000:  # the chain visits every planned chunk, from the first segment to the last
        at = starts.pop(at)
    assert at == 200_000 and not starts


def test_draws_of_one_huge_document_spread(spark, monkeypatch):
    """Without any broadcast table, a document that makes nine tenths of the draws is not one task's key."""
    from cohortlab.operators import text as T

    docs = I.doc_lengths(spark.range(200).select((F.col("id") % 40).alias("doc_id")))
    draws = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 > 0, F.lit(7)).otherwise(F.col("id") % 40).cast("long").alias("doc_id"))
    for weighted in (True, False):
        wanted = {r.k: r.doc_b for r in I.sample_other_doc(draws, docs, [3, F.col("k")], weighted).collect()}
        assert len(wanted) == 20_000 and all(b != 7 for k, b in wanted.items() if k % 10)
        with monkeypatch.context() as patch:
            patch.setattr(T, "fits", lambda *a: False)
            patch.setattr(T, "HOT_KEYS", 20)
            patch.setattr(I, "broadcast_if_small", lambda df, *a: df.hint("merge"))
            out = I.sample_other_doc(draws, docs, [3, F.col("k")], weighted)
            assert {r.k: r.doc_b for r in out.collect()} == wanted
            assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_instances_keep_their_promises(spark):
    segments, rows = corpus(spark)
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(50)], "token string, id int")
    made = I.generate_epochs(segments, vocab, 1, epochs=2, max_seq_len=32, prob=0.15).collect()
    assert made
    for r in made:
        assert len(r.tokens) == len(r.segment_ids) <= 32
        assert r.tokens[0] == "[CLS]" and r.tokens[-1] == "[SEP]"
        n = min(20, max(1, round(len(r.tokens) * 0.15)))
        assert len(r.masked_lm_positions) == n == len(r.masked_lm_labels)
        assert r.masked_lm_positions == sorted(set(r.masked_lm_positions))
        assert all(0 < p < len(r.tokens) - 1 for p in r.masked_lm_positions)


def test_another_document_is_never_the_same_one(spark):
    segments, _ = corpus(spark)
    docs = I.doc_lengths(segments)
    for weighted in (True, False):
        drawn = I.sample_other_doc(segments.select("doc_id", "seg_no"), docs, [9, F.col("doc_id"), F.col("seg_no")], weighted)
        found = drawn.collect()
        assert len(found) == segments.count() and all(r.doc_id != r.doc_b for r in found)


def test_lines_and_documents_across_splits(spark, tmp_path):
    rng = random.Random(2)
    lines = [rng.choice(["", "  ", f"line {i} " + "x" * rng.randrange(30)]) for i in range(3000)]
    path = tmp_path / "corpus.txt"
    path.write_text("\n".join(lines) + "\n")
    expected, doc = [], []
    for line in [*lines, ""]:
        if line.strip():
            doc.append(line.strip())
        elif doc:
            expected += [(len({e[0] for e in expected[-1:]}) and expected[-1][0] + 1 or 0, i, t) for i, t in enumerate(doc)]
            doc = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        numbered = files.numbered_lines(spark, str(path)).collect()
        assert len({r.split_no for r in numbered}) > 3
        assert [r.line for r in sorted(numbered, key=lambda r: r.line_no)] == lines
        got = sorted(tuple(r) for r in files.read_corpus(spark, str(path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert got == expected


def test_corpus_of_one_document_is_refused(spark, tmp_path):
    (tmp_path / "one.txt").write_text("a\nb\n")
    with pytest.raises(ValueError):
        files.read_corpus(spark, str(tmp_path / "one.txt"), min_docs=2)
    assert files.read_corpus(spark, str(tmp_path / "one.txt")).count() == 2


def test_layers_have_to_divide():
    assert layer_map(12, 6)["attention"][0] == (1, 0)
    with pytest.raises(ValueError):
        layer_map(12, 5)


def test_epoch_metrics_are_read_without_instances(spark, tmp_path):
    rows = [(e, ["[CLS]", str(i), "[SEP]"], [0, 0, 0], False, [1], [str(i)]) for e, n in ((0, 3), (1, 5)) for i in range(n)]
    made = spark.createDataFrame(rows, files.INSTANCE.replace("epoch int", "epoch int"))
    path = str(tmp_path / "made")
    files.write_instances(made, path, 32, 4)
    found = files.read_instance_metrics(spark, path)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 3, 32), (1, 5, 32)]
    assert all("/metrics/" in f for f in found.inputFiles())
    # the instances may be gone: only the metrics are counted
    for f in (tmp_path / "made" / "instances" / "epoch=0").glob("*"):
        f.rename(tmp_path / f.name)
    with pytest.warns(UserWarning, match="2 generated epochs serve 3"):
        assert files.count_epochs(spark, path, requested=3) == 2
    assert files.read_instances(spark, path, 3, 2).count() == 5 and files.read_instances(spark, path, 3, 2).first().epoch == 1
    files.write_instances(made.where("false"), str(tmp_path / "none"), 32, 4)
    with pytest.raises(ValueError):
        files.count_epochs(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        files.write_instances(made, str(tmp_path / "few"), 32, 1)


def test_tokens_travel_as_texts_and_come_back(spark, monkeypatch):
    """No array of tokens is stored or shuffled before its side is complete, and any token comes back, nulls included."""
    segments, _ = corpus(spark)
    odd = F.when(F.col("t") == "t7", F.lit(None)).when(F.col("t") == "t8", F.lit("")).otherwise(F.concat(F.lit("\x1f"), "t", F.lit(" \x1e")))
    odd_segments = segments.select("doc_id", "seg_no", F.posexplode_outer("tokens").alias("i", "t")).groupBy("doc_id", "seg_no").agg(
        F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", odd.alias("t"))))).alias("s")).select(
        "doc_id", "seg_no", F.transform("s", lambda x: x["t"]).alias("tokens"))
    stored, materialize = [], I.materialize

    def noted(df, name="table"):
        stored.append((name, [t for _, t in df.dtypes]))
        return materialize(df, name)

    monkeypatch.setattr(I, "materialize", noted)
    plain = I.make_pairs(segments, 1, 2, 32)
    assert not any("array<string>" in kinds for _, kinds in stored)
    key = lambda r: (r.epoch, r.doc_id, r.seg_no)
    wanted = {key(r): r for r in plain.collect()}
    change = lambda t: {"t7": None, "t8": "", ".": "."}.get(t, f"\x1f{t} \x1e")
    found = I.make_pairs(odd_segments, 1, 2, 32).collect()
    assert len(found) == len(wanted)
    for r in found:
        w = wanted[key(r)]
        assert (r.doc_b, r.tokens_a, r.tokens_b) == (w.doc_b, [change(t) for t in w.tokens_a], [change(t) for t in w.tokens_b])


def test_masking_with_a_small_vocabulary_needs_no_shuffle(spark, monkeypatch):
    vocab = spark.createDataFrame([(f"t{i}", 3 * i) for i in range(50)], "token string, id int")
    rows = spark.range(200).select(F.col("id").alias("k"), F.concat(F.array(F.lit("[CLS]")), F.array_repeat(F.lit("w"), 40)).alias("tokens"))
    out = I.mask_tokens(rows, ["k"], vocab, 7, 0.3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    small = {r.k: r for r in out.collect()}
    monkeypatch.setattr(I, "fits", lambda *a: False)
    assert {r.k: r for r in I.mask_tokens(rows, ["k"], vocab, 7, 0.3).collect()} == small and len(small) == 200


def test_instances_are_stored_compressed(spark, tmp_path):
    made = spark.createDataFrame([(0, ["a", "b"] * 50, [0] * 100, False, [1], ["b"])] * 20, files.INSTANCE)
    files.write_instances(made, str(tmp_path / "made"), 128, 1)
    parts = list((tmp_path / "made" / "instances").glob("*/part-*"))
    assert parts and all(p.name.endswith(".json.gz") for p in parts)
    back = files.read_instances(spark, str(tmp_path / "made"), 0)
    assert [r.asDict() for r in back.collect()] == [r.asDict() for r in made.collect()]
