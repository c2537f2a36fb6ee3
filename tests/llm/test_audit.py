"""The filter audit against a count by hand, with files in any order."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from cohortlab.llm import audit

FULL = " ".join(f"w{i}" for i in range(200))
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, 1), (7, None, 1), (None, 1, 1)]


def mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        (len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words))
        + 4 * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + 8 * bool(re.search("[#$%&*|]", text))
    )


def by_hand(rows, labels):
    """(part, order, step) -> the eight counts, document by document."""
    ids, least = lambda i: float("-inf") if i is None else i, {}
    for i, text, _ in rows:
        least[text or ""] = min(least.get(text or "", float("inf")), ids(i))
    good, bad = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out = defaultdict(Counter)
    for i, text, source in rows:
        text, part = text or "", source or ""
        m = mask(text) + 16 * (ids(i) > least[text])
        for order in permutations(range(5)):
            alive = True
            for step, f in enumerate(order):
                key, fails = (part, "".join("ABCDE"[g] for g in order), step + 1), bool(m >> f & 1)
                out[key].update(kept=alive and not fails, removed=alive and fails, redundant=fails and not alive, unique_fails=m == 1 << f,
                                good_lost=alive and fails and i in good, toxic_lost=alive and fails and i in bad, shapley=0)
                if alive and fails:
                    for other in permutations(range(5)):
                        out[part, "".join("ABCDE"[g] for g in other), other.index(f) + 1]["shapley"] += 1
                alive = alive and not fails
    return {k: dict(v) for k, v in out.items()}


ROWS = [
    # the smallest id of each text comes late, in another file and in another part
    [(9, FULL, "b"), (8, "short #", "a"), (6, FULL, "b"), (7, "SHORT", None)],
    [(4, FULL, "a"), (4, FULL, "b"), (8, "short #", "a"), (3, "short #", "b"), (10, "", "a")],
    [(1, FULL, "a"), (2, "x " * 400, "b"), (5, "x " * 400, "b"), (None, "SHORT", "a"), (None, "SHORT", "a"), (11, None, "a")],
    [(1, FULL, "b"), (12, "short #", "b"), (2, "é " * 300 + FULL, "a"), (None, None, None)],
]


@pytest.fixture()
def folder(spark, tmp_path):
    def write(files):
        for i in files:
            table = spark.createDataFrame([(*r, "x", 1) for r in ROWS[i]], "doc_id long, text string, source string, part string, mask long")
            table.coalesce(1).write.mode("append").parquet(str(tmp_path / "table"))
        return str(tmp_path / "table")

    return write


def rows_of(counters):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): {n: r[n] for n in names} for r in audit.report(counters).collect()}


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 0, 3, 1)])
def test_retractions(spark, folder, order):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = audit.run_stream(audit.document_stream(spark, folder(order)), labels)
    assert found.batches == 4
    assert rows_of(found.counters()) == by_hand([r for f in ROWS for r in f], LABELS)


def test_resume_and_replay(spark, folder, tmp_path):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    kept = str(tmp_path / "kept")
    assert audit.run_stream(audit.document_stream(spark, folder((0, 1))), labels, kept).batches == 2
    table = folder((2, 3))
    resumed = audit.run_stream(audit.document_stream(spark, table, batches=2), labels, kept)
    want = by_hand([r for f in ROWS for r in f], LABELS)
    assert resumed.batches == 3 and rows_of(resumed.counters()) == want
    # the last batch once more, as after a lost driver
    schema = spark.read.parquet(table).schema
    resumed.add(spark.createDataFrame([(*r, "x", 1) for f in ROWS[2:] for r in f], schema), 2)
    assert rows_of(resumed.counters()) == want
    again = audit.run_stream(audit.document_stream(spark, table), labels, kept)
    assert again.batches == 3 and rows_of(again.counters()) == want


def test_odd_tables(odd, empty, tmp_path):
    labels = odd.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    for table, parts in ((odd, 3), (empty, 0)):
        found = audit.Audit(odd.sparkSession, labels)
        found.add(table, 0)
        rows = audit.report(found.counters()).collect()
        assert len(rows) == 600 * parts
        assert sum(r.kept + r.removed for r in rows if r.step == 1) == 120 * table.count()
