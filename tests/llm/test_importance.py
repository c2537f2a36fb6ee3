"""Features and order of the importance resampling against brute force."""

import re
import zlib

import numpy as np
import pyarrow as pa

from cohortlab.llm import buffers, importance


def test_features():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abAZ09 é你😀-_"), rng.integers(0, 300))) for _ in range(300)]
    texts += ["x" * 100 + " " + "é" * 1000 + " b", "", None, "a", "a b", "b" * 31 + " " + "c" * 32 + " " + "d" * 33]
    bucket, row, words = importance.feature_buckets(*buffers.utf8(pa.array(texts)))
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        want = sorted(zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
        assert sorted(bucket[row == i].tolist()) == want and words[i] == len(w)


def test_radix_order(spark):
    rng = np.random.default_rng(2)
    ids = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 5, 5, *rng.integers(-(1 << 40), 1 << 40, 700).tolist()]
    rows = [(int(rng.integers(-3, 4)), int(i)) for i in ids]
    table = spark.createDataFrame(rows, "a long, b long")
    got = {r._at: (r.a, r.b) for r in importance.radix_sorted(table.repartition(7), ["a", "b"]).collect()}
    assert [got[i] for i in range(len(rows))] == sorted(rows)
    # equal rows, one row and no row
    same = spark.createDataFrame([(4, 4)] * 50, "a long, b long")
    assert sorted(r._at for r in importance.radix_sorted(same, ["a", "b"]).collect()) == list(range(50))
    assert [r._at for r in importance.radix_sorted(same.limit(1), ["a", "b"]).collect()] == [0]
    assert importance.radix_sorted(table.where("false"), ["a", "b"]).count() == 0


def test_draw_moves_towards_the_target(spark):
    rng = np.random.default_rng(3)
    near = [(int(i), " ".join(rng.choice(["red", "green", "blue"], 30)), "x") for i in range(200)]
    far = [(int(i) + 200, " ".join(rng.choice(["one", "two", "three"], 30)), "x") for i in range(200)]
    documents = spark.createDataFrame(near + far, "doc_id long, text string, rank string")
    target = spark.createDataFrame([(" ".join(rng.choice(["red", "green", "blue"], 30)),) for _ in range(500)], "text string")
    ranked = importance.resample(documents, target)
    drawn = [r.doc_id for r in ranked.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and sum(i < 200 for i in drawn) >= 95
    kept = importance.keep_drawn(documents, ranked)
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.collect()) == sorted(drawn)


def test_odd_tables(odd, empty):
    for table in (odd, empty):
        rows = importance.resample(table, table.select("text")).collect()
        assert len(rows) == table.count()
        ranks = sorted(r["rank"] for r in rows if r["rank"])
        assert ranks == list(range(1, 25 * sum(r.n_words >= 20 for r in rows) // 100 + 1))
    rows = {r.doc_id: r for r in importance.resample(odd, empty).collect()}
    assert rows[1].n_features == 0 and rows[1].weight == 0 and rows[8].n_features == 1 and len(rows) == 11
