"""How document filters interact: which filter removes what, in every order, kept up to date by a stream.

All files of the table are processed as micro-batches that are available now. A
document is counted by its part and its mask, the set of filters it fails. Four
filters look at the text alone. The fifth, a copy of a text with a smaller id,
depends on what else arrives: every text has a keyed state, its smallest id so
far and how many rows hold it. A row counts as a copy when it arrives. The rows
with the smallest id are then moved to the mask without the copy flag; when a
smaller id arrives later, they are moved back (their earlier mask is retracted),
and its rows are moved instead. So the counters are right after every batch, whatever
the order of the files.

State and changes of a batch are written to a folder of the batch. A replayed batch
reads the states before it and writes the same folder again, and a lost
executor loses nothing. Rows are reduced to the smallest id of each text before
they are shuffled by text, so a text that most rows share sends one row for each task.
The counters have a row for each part, mask and label; the orders are applied to them at the end.

Defined cases: a null text counts as empty, a null source as the empty part; a
null id is smaller than any other and has no label; rows that repeat an id and text are not
copies of each other; of several labels of an id the highest counts; an empty
table gives no rows. Only the named columns are read, so further ones may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import buffers
from cohortlab.scratch import fresh_path, materialize

FILTERS = "ABCDE"
COPY = 16  # the bit of E
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
SIGNS = b"#$%&*|"
#: Into about so many micro-batches the files are dealt.
BATCHES = 4
_LEAST = -(1 << 63)
_COUNTER = ["part", "mask", "quality", "toxic"]
_SIGN = np.zeros(256, bool)
_SIGN[list(SIGNS)] = True


def text_masks(column: pa.Array) -> np.ndarray:
    """The failed filters A to D of each text, as bits 1, 2, 4 and 8."""
    data, offsets = buffers.utf8(column)
    out = []
    for first, last in buffers.row_chunks(offsets):
        o = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        rows = last - first
        start, end, row = buffers.words(part, o)
        words = np.bincount(row, minlength=rows)
        names = buffers.span_hash(buffers.prefix_hash(part), start, end)
        # equal words of a row follow each other once sorted
        order = np.lexsort((names, row))
        new = np.ones(len(order), bool)
        new[1:] = (names[order][1:] != names[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][new], minlength=rows)
        of = np.repeat(np.arange(rows), np.diff(o))
        capitals = np.bincount(of[(part >= 65) & (part <= 90)], minlength=rows)
        points = np.bincount(of[(part & 0xC0) != 0x80], minlength=rows)
        signs = np.bincount(of[_SIGN[part]], minlength=rows)
        out.append(
            (words < MIN_WORDS) + 2 * (100 * distinct < DISTINCT_PERCENT * words)
            + 4 * (100 * capitals > CAPITAL_PERCENT * points) + 8 * (signs > 0))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _mask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mask = pa.array(text_masks(batch.column("text")).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("k1", "k2", "id", "known", "part")] + [mask], ["k1", "k2", "id", "known", "part", "mask"])


def masked(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """k1, k2 (the text), id, part, mask without E, quality and toxic (1 or 0) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    rows = documents.select(
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(11), text).alias("k2"), F.coalesce(id_, F.lit(_LEAST)).alias("id"),
        id_.isNotNull().alias("known"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.mapInArrow(_mask_rows, "k1 long, k2 long, id long, known boolean, part string, mask int")
    given = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("at")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("quality"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    # rows without an id are spread by their text; they match no label
    rows = rows.withColumn("at", F.when(F.col("known"), F.col("id")).otherwise(F.col("k1")))
    joined = rows.join(given.withColumn("known", F.lit(True)).hint("merge"), ["at", "known"], "left")
    return joined.select("k1", "k2", "id", "part", "mask", F.coalesce("quality", F.lit(0)).alias("quality"),
                         F.coalesce("toxic", F.lit(0)).alias("toxic"))


_HELD = "array<struct<part:string,mask:int,quality:int,toxic:int,n:bigint>>"
_STATE = f"k1 long, k2 long, id long, version long, held {_HELD}, batch int"


def _smallest(rows: DataFrame) -> DataFrame:
    """k1, k2, the smallest id of each text and the counts ``held`` of its rows."""
    same = rows.groupBy("k1", "k2", "id", *_COUNTER).agg(F.count("*").alias("n"))
    # the rows of one id and text: one for each part
    held = same.groupBy("k1", "k2", "id").agg(F.collect_list(F.struct(*_COUNTER, "n")).alias("held"))
    least = held.groupBy("k1", "k2").agg(F.min(F.struct("id", "held")).alias("least"))
    return least.select("k1", "k2", "least.id", "least.held")


class Audit:
    """Counters and keyed states of the batches processed so far."""

    def __init__(self, spark: SparkSession, labels: DataFrame, path: str | None = None) -> None:
        self.spark, self.labels = spark, labels
        self.path = path or fresh_path(spark, "audit")
        self.batches = 0
        if path:
            try:
                last = spark.read.parquet(f"{path}/counters").agg(F.max("batch")).first()[0]
            except AnalysisException:  # nothing is written there yet
                last = None
            self.batches = 0 if last is None else last + 1

    def _earlier(self, kind: str, schema: str, before: int) -> DataFrame:
        """The rows that batches before the given one have written."""
        rows = self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/{kind}/batch={b}" for b in range(before)]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*folders) if folders else rows

    def add(self, documents: DataFrame, batch: int) -> None:
        """Process one micro-batch: change the states of its texts and write the changes of the counters."""
        rows = materialize(masked(documents, self.labels), "masked")
        new = _smallest(rows).select("k1", "k2", F.struct("id", "held").alias("new"), F.lit(None).cast(f"struct<id:bigint,version:bigint,held:{_HELD}>").alias("old"))
        old = self._earlier("state", _STATE, batch).select(
            "k1", "k2", F.lit(None).cast(f"struct<id:bigint,held:{_HELD}>").alias("new"),
            F.struct("id", (-F.col("version")).alias("version"), "held").alias("old"))
        # ids only fall, and of one id the last version counts: it is the smallest of (id, -version)
        both = new.unionByName(old).groupBy("k1", "k2").agg(F.min("new").alias("new"), F.min("old").alias("old"))
        changed = both.where("new IS NOT NULL AND (old IS NULL OR new.id <= old.id)")
        nothing = F.array().cast(_HELD)
        states = changed.select(
            "k1", "k2", "new.id", F.lit(batch).cast("long").alias("version"),
            F.when(F.col("old.id") == F.col("new.id"), F.concat("new.held", "old.held")).otherwise(F.col("new.held")).alias("held"),
            F.col("new.held").alias("moved"),
            F.when(F.col("old.id") > F.col("new.id"), F.col("old.held")).otherwise(nothing).alias("retracted"))
        path = f"{self.path}/state/batch={batch}"
        states.write.mode("overwrite").parquet(path)
        states = self.spark.read.parquet(path)
        moves = states.select(F.explode(F.concat(
            F.transform("moved", lambda x: F.struct(x.alias("x"), F.lit(1).alias("sign"))),
            F.transform("retracted", lambda x: F.struct(x.alias("x"), F.lit(-1).alias("sign"))))).alias("m")).select("m.x.*", "m.sign")
        copied = F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask")
        n = F.col("n") * F.col("sign")
        changes = (
            rows.select("part", copied, "quality", "toxic", F.lit(1).cast("long").alias("n"))
            .unionByName(moves.select(*_COUNTER, n.alias("n")))
            .unionByName(moves.select("part", copied, "quality", "toxic", (-n).alias("n"))))
        changes.groupBy(*_COUNTER).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{self.path}/counters/batch={batch}")
        self.batches = max(self.batches, batch + 1)

    def counters(self) -> DataFrame:
        """part, mask, quality, toxic and the number of documents."""
        rows = self._earlier("counters", "part string, mask int, quality int, toxic int, n long, batch int", self.batches)
        return rows.groupBy(*_COUNTER).agg(F.sum("n").alias("n")).where("n > 0")


def run_stream(stream: DataFrame, labels: DataFrame, path: str | None = None) -> Audit:
    """Process all files that are available now. With the ``path`` of an earlier run only new files are read."""
    audit = Audit(stream.sparkSession, labels, path)

    def add(rows: DataFrame, batch: int) -> None:
        audit.add(rows, batch)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{audit.path}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return audit


def report(counters: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The table of the module: one row for each part, order of the filters and step."""
    by_mask = counters.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("bad"))
    plan, orders = [], math.factorial(len(filters))
    for order in permutations(range(len(filters))):
        for step, f in enumerate(order):
            earlier = sum(1 << g for g in order[:step])
            plan.append(F.struct(F.lit("".join(filters[g] for g in order)).alias("filter_order"), F.lit(step + 1).alias("step"),
                                 F.lit(1 << f).alias("own"), F.lit(earlier).alias("earlier")))
    # one short list for each of the few masks of a part
    steps = by_mask.select("*", F.explode(F.array(*plan)).alias("s")).select("part", "mask", "n", "good", "bad", "s.*")
    mask, own, earlier = F.col("mask"), F.col("own"), F.col("earlier")
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(earlier) != 0
    total = lambda column, where: F.sum(F.when(where, column).otherwise(F.lit(0))).cast("long")
    n = F.col("n")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(n, ~fails & ~gone).alias("kept"),
        total(n, fails & ~gone).alias("removed"),
        total(n, fails & gone).alias("redundant"),
        total(n, mask == own).alias("unique_fails"),
        total(F.col("good"), fails & ~gone).alias("good_lost"),
        total(F.col("bad"), fails & ~gone).alias("toxic_lost"),
        # of the failed filters each one stands first in the same number of orders
        total(n * F.floor(F.lit(orders) / F.greatest(F.bit_count(mask), F.lit(1))), fails).alias("shapley"),
    )


def document_stream(spark: SparkSession, path: str, batches: int = BATCHES) -> DataFrame:
    """The Parquet files at ``path`` as a stream of about ``batches`` micro-batches."""
    table, (folder, _, name) = spark.read.parquet(path), path.rstrip("/").rpartition("/")
    files = [f.rpartition("/")[2] for f in table.inputFiles()]
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches)))
    # a stream reads folders, and a table may be a single file
    return stream.option("pathGlobFilter", name).parquet(folder) if files == [name] else stream.parquet(path)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = document_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return report(run_stream(stream, spark.read.parquet(f"{sf_dir}/labels.parquet")).counters())


def _oracle() -> str:
    orders = ["".join(o) for o in permutations(FILTERS)]
    values = ", ".join(f"('{o}')" for o in orders)
    return f"""
WITH x AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM x GROUP BY text
), masks AS MATERIALIZED (
  SELECT x.part, coalesce(l.quality, 0) AS good, coalesce(l.toxic, 0) AS bad,
         (len(w) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w))::INT
         + 4 * (100 * len(regexp_extract_all(x.text, '[A-Z]')) > {CAPITAL_PERCENT} * length(x.text))::INT
         + 8 * regexp_matches(x.text, '[#$%&*|]')::INT + 16 * (x.doc_id > f.least)::INT AS mask
  FROM x JOIN firsts f USING (text)
  LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS quality, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
), counted AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM masks GROUP BY ALL
), steps AS (
  SELECT o AS filter_order, s::INT AS step, 1 << (ascii(substr(o, s, 1)) - 65) AS own,
         coalesce((SELECT sum(1 << (ascii(substr(o, e, 1)) - 65)) FROM range(1, 6) q(e) WHERE e < s), 0)::BIGINT AS earlier
  FROM (VALUES {values}) v(o), range(1, 6) r(s)
)
SELECT part, filter_order, step,
       sum(CASE WHEN mask & own = 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN mask & own <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM counted, steps GROUP BY ALL
"""


ORACLE_SQL = _oracle()
