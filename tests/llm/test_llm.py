"""The corpus operators against brute force, and on odd tables."""

import hashlib
import re
import string
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import ann, bpe, buffers, fingerprints, langid, lines, minhash, mixing, pii, quality, registry, repeats

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_lines(odd, empty):
    got = {(r.doc_id, r.text) for r in lines.drop_shared_lines(odd).collect()}
    assert (None, "x") in got and (7, "y") in got and (9, "a line of at least twenty characters") in got and (1, None) in got
    assert lines.drop_shared_lines(odd).count() == odd.count() and lines.drop_shared_lines(odd).columns == odd.columns
    assert lines.drop_shared_lines(empty).count() == 0


def test_unseen_lines(spark):
    runs = lines.LineRuns(spark, fanout=2)
    table = lambda ids: lines.line_rows(spark.createDataFrame([(i, f"a line with the number {i // 2} in it") for i in ids], "doc_id long, text string"))
    assert [runs.add(table(range(a, a + 3))).count() for a in (0, 3, 6)] == [2, 1, 2]
    assert [len(level) for level in runs.levels] == [1, 1]


def test_each_line_is_in_one_run_and_the_rest_are_updates(spark):
    runs, n = lines.LineRuns(spark, fanout=2), lambda i: i % 7 if i % 3 else i
    texts = {i: f"a line with the number {n(i)} in it" for i in range(60)}
    for at in range(0, 60, 12):
        rows = [(i, texts[i]) for i in range(at, at + 12)]
        runs.add(lines.line_rows(spark.createDataFrame(rows, "doc_id long, text string")))
    kept = [tuple(r) for run in runs.runs() for r in run.select("h1", "h2").collect()]
    assert len(kept) == len(set(kept)) == len(set(texts.values())) and sum(u.count() for u in runs.updates) > 0
    wanted = sorted((list(texts.values()).count(t), max(i for i in texts if texts[i] == t)) for t in set(texts.values()))
    assert sorted((r.docs, r["last"]) for r in runs.shared(3).collect()) == [w for w in wanted if w[0] >= 3]
    # the counts rest on the anti-join: a run that knows no earlier line counts too few
    blind = lines.LineRuns(spark, fanout=2)
    blind.unseen = lambda rows: rows
    for at in range(0, 60, 12):
        blind.add(lines.line_rows(spark.createDataFrame([(i, texts[i]) for i in range(at, at + 12)], "doc_id long, text string")))
    assert len(blind.shared(3).collect()) != len(runs.shared(3).collect())


def test_bpe(odd, empty):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(ranks, public_tokenizers.PATTERN), np.random.default_rng(1)
    letters = list("aeinorstlhd 'sé你😀\x1c\x85\n\t019")
    for n in range(1500):
        text = "".join(rng.choice(letters[: 11 if n % 2 else None], rng.integers(0, 120)))
        ids = codec.encode(text).tolist()
        assert ids == known.encode_ordinary(text) and "".join(codec.decode_stream(ids, 3)) == text
    got = bpe.encode(odd, ranks, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count() and {r.text for r in got if r.doc_id == 1} == {""}
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def _brute_repeats(texts, length=100):
    seen, out = set(), {}
    for doc in sorted(texts):
        data = texts[doc].encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out[doc] = (len(data), int(gone.sum()), spans, kept)
    return out


def test_repeats(spark, documents, odd, empty):
    passage = "".join(f"{i * 7919 % 1000:03d}" for i in range(60))
    made = {10_000_001: "ab" * 200, 10_000_002: "x" + passage + "y" + passage, 10_000_003: passage[:99], 10_000_004: passage[5:105] + "é",
            10_000_005: "x" + passage + "y" + passage, 10_000_006: ""}
    # texts made of the same pieces, so that repeats begin and end anywhere and overlap
    rng = np.random.default_rng(9)
    pool = ["".join(rng.choice(list("abé ") if k % 3 else list("ab"), rng.integers(5, 260))) for k in range(30)]
    made |= {20_000_000 + k: "".join(rng.choice(pool, rng.integers(1, 9))) for k in range(300)}
    texts = {r.doc_id: r.text for r in documents.collect()} | made
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(table).collect()}
    assert got == _brute_repeats(texts)
    assert repeats.remove_repeats(odd).count() == odd.count() and repeats.remove_repeats(empty).count() == 0


def test_repeated_strings_are_written_once(spark, monkeypatch):
    """No table after the rank pairs holds all of their repeated rows again; also where one id has several texts."""
    rng = np.random.default_rng(3)
    pool = ["".join(rng.choice(list("abcdefgh "), 150)) for _ in range(8)]
    rows = [(k // 2 if k < 40 else k, "".join(rng.choice(pool, 4)) + f"-{k}") for k in range(80)]
    written, materialize = [], repeats.materialize

    def note(df, name="table"):
        table = materialize(df, name)
        written.append((name, table.count()))
        return table

    monkeypatch.setattr(repeats, "materialize", note)
    for table in (rows, rows[40:]):
        written.clear()
        got = {r.kept.decode() for r in repeats.remove_repeats(spark.createDataFrame(table, "doc_id long, text string")).collect()}
        at = [name for name, _ in written].index("rank-pairs")
        assert all(n <= written[at][1] / 2 for name, n in written[at + 1 :] if name != "later")
        first = {}
        for doc, text in table:
            for i in range(len(text) - 99):
                s = text[i : i + 100]
                first[s] = min(first.get(s, (doc, i)), (doc, i))
        want = set()
        for doc, text in table:
            gone = np.zeros(len(text), bool)
            for i in range(len(text) - 99):
                gone[i : i + 100] |= first[text[i : i + 100]] < (doc, i)
            want.add("".join(c for c, x in zip(text, gone, strict=True) if not x))
        assert got == want


def test_fingerprints(spark, documents):
    rows = {r.doc_id: r for r in fingerprints.op7_syncmer_fingerprints(spark, SF_DIR).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    order = sorted(texts, reverse=True)
    for doc, after in zip(order, order[1:] + order[:1], strict=True):
        text, n = texts[doc], len(texts[doc])
        edited = text[: n - n // 3] + texts[after][: n // 3]
        assert rows[doc].n_chars == n and rows[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if edited == text:
            assert rows[doc].fingerprint == rows[doc].edited_fingerprint and rows[doc].near_edited == 1.0
    long = [r for r in rows.values() if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > 0.4 > np.mean([r.near_next for r in long])


def _anchors(names, hashes, pair):
    """Positions of closed syncmers, and the k-mer at the smallest run, by definition."""
    k, s = fingerprints.K, fingerprints.S
    if len(names) < k:
        return None
    chosen = [i for i in range(len(names) - k + 1)
              if min(hashes[i : i + k - s + 1]) in (hashes[i], hashes[i + k - s])]
    return sorted({pair(hashes[i], hashes[i + k - s]) for i in [*chosen, min(hashes.index(min(hashes)), len(names) - k)]})


def test_anchors_by_brute_force(spark, documents):
    import regex

    texts = [r.text for r in documents.limit(60).collect()] + ["漢字かな交じり文です" * 7, "aGVsbG8gd29ybGQ" * 9, "a b c d e f g h", "a b c d e f g h i", "a b", "", "Ab1 " * 5]
    piece = regex.compile(fingerprints.PIECE)
    rows = [(i, t, piece.findall(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "id long, text string, pieces array<string>")
    size = fingerprints.S
    # the hashes come from Spark, all choices are made here
    hashed = table.withColumn("w", F.transform("pieces", lambda x: F.xxhash64(x))).withColumn("h", F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(size)])))
    known = {r.id: r for r in hashed.withColumn("short", F.hash("w")).collect()}
    pairs = {(a, b) for r in known.values() if len(r.pieces) >= fingerprints.K for a, b in zip(r.h, r.h[size:])}
    named = {(r.a, r.b): r.x for r in spark.createDataFrame(list(pairs), "a long, b long").withColumn("x", F.hash("a", "b")).collect()}
    for r in fingerprints.with_anchors(table, "text", "own").collect():
        want = _anchors(r.pieces, known[r.id].h, lambda a, b: named[a, b])
        assert r.own == (want if want is not None else [known[r.id].short]), r.text


def test_scripts_without_blanks(spark):
    rng = np.random.default_rng(8)
    for letters in ("漢字仮名交文書語日本人大小中", "abcdefghijABCDEFGHIJ0123456789+/"):
        text = "".join(rng.choice(list(letters), 900))
        table = spark.createDataFrame([(1, text), (2, "x" * 400 + "".join(rng.choice(list(letters), 500)))], "doc_id long, text string")
        near = {r.doc_id: r.near_edited for r in fingerprints.fingerprints(table).collect()}
        assert 0.3 < near[1] < 0.8
        moved = spark.createDataFrame([("Zz9 " + text[50:],), (text,)], "text string")
        a, b = (set(r.own) for r in fingerprints.with_anchors(moved, "text", "own").collect())
        assert len(a & b) > 0.85 * len(a)


def test_odd_fingerprints(spark, odd, empty):
    for table in (odd, empty):
        rows = fingerprints.fingerprints(table).collect()
        assert len(rows) == table.count() and all(r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    # one id holds most rows, with texts of their own and as copies
    rows = [(None, f"text number {i % 40} of one id") for i in range(300)] + [(i, "the same words here for all") for i in range(60)]
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() == 360
    last = spark.createDataFrame([(3, "abc def ghi"), (2, "uvw"), (1, "123456789")], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprints(last).collect()}
    want = {3: "abc def uvw", 2: "uv1", 1: "123456abc"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def _shingles(text):
    w = re.split(r"[ \t\n\x0b\x0c\r]+", text.lower().strip(" \t\n\x0b\x0c\r"))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_duplicates(spark, documents):
    texts = {r.doc_id: _shingles(r.text) for r in documents.collect() if r.text.strip()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a < b and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.class_id for r in minhash.op3_near_duplicates(spark, SF_DIR).collect()}
    assert {d: got[d] for d in texts} == {d: find(d) for d in texts}


def test_equal_sets_with_other_counts_share_a_band():
    from cohortlab.llm import buffers

    names = buffers.mix(np.arange(2, dtype=np.uint64))
    hashes = np.concatenate((np.repeat(names, [1000, 10]), np.repeat(names, [10, 1000])))
    value, row = minhash.bands_of(hashes, np.repeat([0, 1], 1010), 2)
    assert len(set(value[row == 0]) & set(value[row == 1])) >= minhash.BANDS
    # a band is proposed once for each text
    assert len(set(zip(value.tolist(), row.tolist()))) == len(value)


@pytest.fixture()
def one_bucket(monkeypatch):
    """All texts in one bucket, so that every pair is a candidate."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            node = batch.column("node")
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(node), pa.int64()), node], ["bucket", "node"])

    monkeypatch.setattr(minhash, "_band_rows", rows)


def _class_ids(table):
    rows = minhash._keyed(table).join(minhash.classes(table), ["w1", "w2"], "left")
    return {(r.doc, r.text): r["head"].doc for r in rows.collect()}


def test_edit_chain_in_one_bucket(spark, one_bucket):
    words = [f"w{i}" for i in range(160)]
    # 1 ~ 2 ~ 3 only; 9 is the other end of the bucket
    rows = [(k, " ".join(words[8 * (k - 1) : 8 * (k - 1) + 104])) for k in (1, 2, 3)]
    rows.append((9, " ".join(f"z{i}" for i in range(104))))
    found = _class_ids(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {k: v for (k, _), v in found.items()} == {1: 1, 2: 1, 3: 1, 9: 9}


def test_no_link_lost_in_a_large_bucket(spark, one_bucket):
    """Families of edits around shared text against all pairs."""
    rng = np.random.default_rng(6)
    shared, rows = [f"s{i}" for i in range(20)], []
    for family in range(12):
        words = shared + [f"f{family}x{i}" for i in range(int(rng.integers(10, 40)))]
        for _ in range(12):
            if rng.random() < 0.5:  # the edits add up, so that members at the ends are not alike
                words = list(words)
                words[int(rng.integers(20, len(words)))] = f"e{rng.integers(1 << 30)}"
            rows.append(" ".join(words + [f"t{rng.integers(3)}"] * int(rng.integers(0, 3))))
    table = [(i, t) for i, t in enumerate(rows)]
    texts, root = {i: _shingles(t) for i, t in table}, {i: i for i, _ in table}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a < b and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = _class_ids(spark.createDataFrame(table, "doc_id long, text string"))
    assert {i: v for (i, _), v in got.items()} == {i: find(i) for i in texts}


def test_edits_of_one_text_do_not_meet_in_pairs(spark, one_bucket, monkeypatch):
    """Copies with one to six edits lie around the threshold; they are joined by the least edited one, not pair by pair."""
    rng, words = np.random.default_rng(4), [f"w{i}" for i in range(150)]
    texts = {0: words}
    for k in range(1, 160):
        texts[k] = list(words)
        for place in rng.choice(np.arange(5, 145), int(rng.integers(1, 7)), replace=False):
            texts[k][place] = f"e{k}x{place}"
    met, meeting = [], minhash._meeting
    monkeypatch.setattr(minhash, "_meeting", lambda *a: met.append(meeting(*a)) or met[0])
    monkeypatch.setattr(minhash, "release", lambda *a: None)
    table = [(k, " ".join(t)) for k, t in texts.items()]
    got = _class_ids(spark.createDataFrame(table, "doc_id long, text string"))
    sets, root = {i: _shingles(t) for i, t in table}, {i: i for i, _ in table}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: v for (i, _), v in got.items()} == {i: find(i) for i in sets}
    assert 20 < sum(find(i) == i for i in sets) < 140
    assert met[0].count() < len(sets)


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, a.upper()), (None, "c d e"), (None, b + " other"), (4, "c  d e")]
    found = _class_ids(spark.createDataFrame(rows, "doc_id long, text string"))
    least = -(1 << 63)
    assert {k: v for (k, _), v in found.items() if k in (7, 8, 9, 4)} == {7: 5, 9: 5, 8: least, 4: least}
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(5, a), (0, "c d e"), (0, b + " other")])


def test_odd_near_duplicates(odd, empty):
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    # 3 stays twice (a repeated row of the same id), 4 and 5 are its copies
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 3, 6, 7, 8, 9, 10]
    assert minhash.keep_one(empty).count() == 0


def test_registers_estimate_similarity():
    a, b = np.arange(1, 401, dtype=np.uint64), np.arange(101, 501, dtype=np.uint64)
    from cohortlab.llm.buffers import mix

    both = np.concatenate((mix(a), mix(b)))
    names = minhash.signatures(both, np.repeat([0, 1], 400), 2, 4096)
    assert abs((names[0] == names[1]).mean() - 300 / 500) < 0.04


def test_mixing(odd, empty):
    assert mixing.sampled(odd).count() == odd.count() and mixing.sampled(empty).count() == 0
    assert set(mixing.keep_drawn(odd).columns) == set(odd.columns)


def test_texts_are_measured_run_by_run(spark):
    """Words, signs and line breaks of odd texts by hand; a pass over the text replaces runs, not single characters."""
    texts = ["", " \t\r\n ", "  two words\n", "a\x0bb\x0cc d", "\u00a0x \U0001f600\U0001f600 \u00e9", "!!..!! a", "a" * 19 + "!", "a" * 20 + "!", "x\n" * 3, "x" * 199 + "\n", "x" * 200 + "\n", "\n"]
    rows = mixing.described(spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string"))
    signs = [sum(c in string.punctuation for c in t) for t in texts]
    want = {i: ("symbols" if t and 20 * n >= len(t) else "lines" if t and 200 * t.count("\n") >= len(t) else "prose", len(re.findall(r"[^ \t\n\r]+", t)))
            for i, (t, n) in enumerate(zip(texts, signs))}
    assert {r.doc_id: (r.topic, r.n_tokens) for r in rows.collect()} == want
    plan = rows._jdf.queryExecution().analyzed().toString()
    patterns = re.findall(r"(\[\^[^,]*), (?:w|), 1\)", plan)
    assert len(patterns) == 2 and all(p.endswith(("+", "*")) for p in patterns) and "translate(" not in plan


def test_raked_margins(spark):
    """The drawn tokens have the target margins, though two cells are drawn whole."""
    cells = spark.createDataFrame([("a", "x", "p", 1000), ("a", "y", "p", 60), ("b", "x", "q", 50), ("b", "y", "p", 40), ("a", "x", "q", 300),
                                   ("b", "x", "p", 200), ("a", "y", "q", 90)], "src string, lng string, topic string, tokens long")
    targets = mixing.default_targets(cells)
    got = mixing.rake(cells, targets, rounds=60).toPandas()
    got["drawn"] = got.tokens * got.factor.clip(upper=1.0)
    assert (got.factor > 1).sum() >= 1
    for margin, target in targets.items():
        want = {r[margin]: r["target"] for r in target.collect()}
        assert sum(want.values()) == pytest.approx(mixing.PART * got.tokens.sum())
        assert got.groupby(margin).drawn.sum().to_dict() == pytest.approx(want, rel=2e-3)


def test_few_cells_are_raked_without_shuffles(spark, documents, monkeypatch):
    """Few cells take a stage for each round, and get the factors that many cells get."""
    cells = mixing.described(documents).groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("tokens")).localCheckpoint()
    stages, found = spark.sparkContext._jsc.sc().dagScheduler().nextStageId, []
    for few in (mixing.FEW_CELLS, 0):
        monkeypatch.setattr(mixing, "FEW_CELLS", few)
        targets, before = mixing.default_targets(cells), stages()
        rows = mixing.rake(cells, targets).collect()
        found.append(({(r.src, r.lng, r.topic): r.factor for r in rows}, stages() - before))
    assert found[0][0] == pytest.approx(found[1][0]) and len(found[0][0]) == len(rows) == cells.count()
    assert found[0][1] <= mixing.ROUNDS + 8 and found[1][1] > 4 * mixing.ROUNDS


def test_workers_keep_tables_of_one_step_only():
    """The encoder's tables go when other tasks of the process begin."""
    made = buffers.kept("a", list)
    assert buffers.kept("a", list) is made and buffers.kept("b", list) is not made and buffers.kept("a", list) is not made
    list(minhash.shingles(pa.array(["a b c"])))
    assert not buffers._kept
    buffers.kept("a", list)
    list(quality._indicator_rows(iter([])))
    assert not buffers._kept


def test_components_end_when_no_edge_joins_two_labels(spark, monkeypatch):
    """Stars are seen to be whole by one pass over the edges."""
    written, materialize = [], minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, name: (written.append(name), materialize(df, name))[1])
    star = spark.createDataFrame([(i, i % 3) for i in range(3, 60)], "node long, lead long")
    assert {(r.node, r.root) for r in minhash.components(star).collect()} == {(i, i % 3) for i in range(60)}
    assert written == ["edges", "labels", "step"]


def test_drawn_margins(spark, documents):
    """On the small table the expected tokens of every margin are within 2 percent of all drawn ones from the target."""
    rows = mixing.described(documents)
    cells = rows.groupBy(*mixing.MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    targets = mixing.default_targets(cells)
    drawn = mixing.sampled(documents).withColumnsRenamed({"source_name": "src", "language": "lng"}).toPandas()
    drawn["mass"] = drawn.n_tokens * drawn.prob
    for margin, target in targets.items():
        has = drawn.groupby(margin).mass.sum()
        for r in target.collect():
            assert abs(has[r[margin]] - r["target"]) < 0.02 * drawn.mass.sum(), (margin, r)


def test_language(spark, documents, odd, empty):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    rows = [r for r in langid.op1_language_id(spark, SF_DIR).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.9
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, langid.train(odd)).collect()}
    assert len(got) == 11 and got[1] == got[2] == got[10] == "und"
    assert langid.predict(empty, langid.train(empty)).count() == 0


def test_language_of_other_scripts(spark):
    """Three scripts of few characters; an id that occurs very often is learned from once."""
    rng = np.random.default_rng(3)
    scripts = {"zh": "的一是不了人我在有他这中大来上国", "ru": "абвгдежзиклмнопрст", "en": "abcdefghiklmnoprstu"}
    rows = [(i, "".join(rng.choice(list(scripts[k]), 30)), k) for i in range(300) for k in [list(scripts)[i % 3]]]
    table = spark.createDataFrame(rows + [rows[0]] * 2000, "doc_id long, text string, lang string")
    model = langid.train(table, rows=200)
    got = {r.doc_id: r.lang_pred for r in langid.predict(table, model).collect()}
    assert got == {i: k for i, _, k in rows}
    points = langid.code_points(np.frombuffer("é你😀".encode(), np.uint8))
    assert points.tolist() == [0xE9, 0x4F60, 0x1F600] and len(langid.gram_buckets(points)) == 3 + 2 + 1


def test_personal_data(odd, empty):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(4)
    for _ in range(20_000):
        text = "".join(rng.choice(list("a@.12 %"), 40))
        want = [("email", *m.span()) for m in email.finditer(text)]
        want += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [s for s in pii.base_spans(text) if s[0] in ("email", "ip")] == want
    assert pii.base_spans("card 4111 1111 1111 1111, +1 (541) 555-3219") == [("card", 5, 24), ("phone", 26, 43)]
    segments, score = [(0, 1), (1, 1), (2, 3)], np.array([[1.0, 0], [2.0, 0], [-1, 3.0]])
    assert pii.best_segments(4, segments, score) == [(1, 0), (2, 1)]
    for table in (odd, empty):
        assert pii.find(table, pii.train(table)).count() == table.count()


def test_neighbours(spark):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    got = ann.op9_nearest_neighbours(spark, SF_DIR).toPandas()
    ids, points = np.array(list(rows)), np.stack(list(rows.values()))
    hits = 0
    for query, part in got.groupby("query_id"):
        far = np.sqrt(((points - rows[query]) ** 2).sum(axis=1))
        want = [i for i in ids[np.lexsort((ids, far))] if i != query][:10]
        hits += len(set(want) & set(part.vec_id))
        assert list(part.sort_values("rank").score) == sorted(part.score)
    assert hits >= 0.9 * len(got)


def test_neighbours_among_copies_and_shards(spark, monkeypatch):
    """200 copies of every vector, several shards, and queries that repeat an id."""
    monkeypatch.setattr(ann, "SHARD", 30)
    rng = np.random.default_rng(12)
    kinds = rng.integers(-4, 5, (60, 8))
    kinds[:, 0] = np.where(np.abs(kinds).sum(axis=1) == 0, 1, kinds[:, 0])
    rows = [(i, kinds[i % 60].astype(float).tolist()) for i in rng.permutation(12_000).tolist()]
    rows += [(400, rows[0][1]), *[r for r in rows if r[0] == 500]]
    table = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.search(table, table.where("vec_id % 100 = 0")).toPandas()
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = total = 0
    for query in range(0, 12_000, 100):
        part = got[got.query_id == query]
        if query == 400 and len(part) == 20:  # two vectors, two queries
            assert sorted(part["rank"]) == sorted([*range(1, 11)] * 2)
            continue
        assert sorted(part["rank"]) == list(range(1, 11))
        far = np.sqrt(((points - points[ids == query][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != query][:10]
        # the id 500 is two candidates
        want = Counter(zip(far[order].tolist(), ids[order].tolist()))
        hits += (want & Counter(zip(part.score.tolist(), part.vec_id.tolist()))).total()
        total += 10
    assert hits >= 0.99 * total


def test_every_vector_can_be_reached():
    points = np.random.default_rng(2).normal(size=(40, 3))
    edges = ann.reachable(points, np.full((40, 2), -1), np.array([7]))
    met, _ = ann.beam_search(points, edges, points, np.array([7]), 40)
    assert all(sorted(row) == list(range(40)) for row in met.tolist())


def test_odd_vectors(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (100, [1.0, 2.0]), (200, [1.0, 2.0]), (200, [1.0, 2.0])]
    table = spark.createDataFrame(bad, "vec_id long, embedding array<double>")
    good = ann.usable(table)
    got = ann.search(good, good.where("vec_id = 100")).collect()
    assert [(r.vec_id, r.score) for r in got] == [(200, 0.0), (200, 0.0)]
    assert ann.usable(table.where("false")).count() == 0


def test_quality(odd, empty):
    labels = pd.DataFrame({"doc_id": [1, 3, 7, 9], "quality": [0, 1, 1, 0]})
    spark = odd.sparkSession
    for table in (odd, empty):
        model = quality.train(table, spark.createDataFrame(labels))
        rows = quality.score(table, model)
        assert rows.count() == table.count() and rows.where(~F.col("score").between(0, 1)).count() == 0


def test_indicators_are_a_set():
    """Scoring sees the same buckets as fitting, each once."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefgh ABC,.01"), 4000)) for _ in range(3)] + ["", "x"]
    from cohortlab.llm import buffers
    import pyarrow as pa

    data, offsets = buffers.utf8(pa.array(texts))
    row, bucket = quality.Indicators().of(data, offsets)
    assert len(set(zip(row.tolist(), bucket.tolist()))) == len(row)
    model = quality.Model(rng.normal(size=quality._SIZE), 0.1, 1.0, 0.0)
    model.scale = rng.normal(size=quality._SIZE)
    alone = quality.margins([bucket[row == i] for i in range(5)], model.scale, model.weight / model.scale, 0.1)
    assert quality.Scorer(model)(pa.array(texts)) == pytest.approx(model.score(alone))


def test_quality_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in quality.op10_quality(spark, sf_dir).collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.95


def test_registry():
    names = registry.queries()
    assert len(names) == 14 and set(registry.oracle_sql()) <= set(names)
