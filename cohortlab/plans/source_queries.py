"""Queries that write a table in some file format and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.plans.instance_queries import SEGS, segments
from cohortlab.plans.metric_queries import scored
from cohortlab.plans.registry import query
from cohortlab.plans.run_queries import EPOCHS, epochs
from cohortlab.plans.tables import LAB, SCORED, labelled, table
from cohortlab.plans.text_queries import VOCAB, document_vocab, documents
from cohortlab.scratch import fresh_path
from cohortlab.sources import files


@query("SELECT doc_id, lang, text, n_chars / 33047.0::DOUBLE AS toxicity FROM documents")
def read_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, with their line breaks and quotes, through CSV."""
    path = fresh_path(spark, "metadata")
    docs = table(spark, sf, "documents").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text", (F.col("n_chars") / 33047.0).alias("toxicity")
    )
    docs.write.options(header=True, quoteAll=True, escape='"').csv(path)
    return files.read_metadata(spark, path, "row long, doc_id long, lang string, text string, toxicity double", index="row")


@query(f"WITH {LAB} SELECT doc_id, y, c, split::INTEGER AS split FROM lab")
def union_splits(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf).select("doc_id", "y", "c", "split")
    parts = {n: df.where(F.col("split") == i).drop("split") for i, n in enumerate(("train", "validation", "test"))}
    return files.union_splits(parts)


@query("SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def read_feature_shards(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "embeddings")
    paths = [fresh_path(spark, f"shard{k}") for k in range(3)]
    for k, path in enumerate(paths):
        df.where(F.pmod("vec_id", F.lit(3)) == k).write.parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return files.read_feature_shards(spark, *paths).select("vec_id", "label", F.round(total, 6).alias("total"))


def written_lines(df: DataFrame, order: list[str], name: str, file: str = "") -> str:
    """Write the column ``value`` as text lines in the given order."""
    folder = fresh_path(df.sparkSession, name)
    df.orderBy(*order).select("value").write.text(folder + file)
    return folder


def task_rows(spark: SparkSession, sf: str, *columns: str, header: bool = True) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat_ws("\t", *columns).alias("value"))
    if not header:
        return rows
    return rows.unionByName(spark.createDataFrame([(-1, "a\tb\tc")], "k long, value string"))


@query("""
SELECT 'train-' || row_number() OVER (ORDER BY p_partkey) AS guid, p_name AS text_a, p_type AS text_b, p_size::VARCHAR AS label
FROM part""")
def read_task_mrpc(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers as identifiers, label first."""
    rows = task_rows(spark, sf, F.col("p_size").cast("string"), F.lit("x"), F.lit('"y'), "p_name", "p_type")
    return files.read_task_tsv(spark, written_lines(rows, ["k"], "mrpc", "/train.tsv"), "mrpc")


@query("""
SELECT 'dev-' || p_partkey AS guid, p_name AS text_a, p_type AS text_b, (p_size % 2)::VARCHAR AS label
FROM part WHERE p_size > 10""")
def read_task_qqp(spark: SparkSession, sf: str) -> DataFrame:
    """Small parts are written with too few columns, which this task skips."""
    key = F.col("p_partkey").cast("string")
    full = F.concat_ws("\t", key, F.lit("a"), F.lit("b"), "p_name", "p_type", F.pmod("p_size", F.lit(2)).cast("string"))
    short = F.concat_ws("\t", key, F.lit("a"), F.lit("b"), "p_name")
    rows = task_rows(spark, sf, F.when(F.col("p_size") > 10, full).otherwise(short))
    return files.read_task_tsv(spark, written_lines(rows, ["k"], "qqp", "/dev.tsv"), "qqp", "dev")


@query("""
SELECT 'train-' || (row_number() OVER (ORDER BY p_partkey) - 1) AS guid, p_name || ' "quoted' AS text_a, NULL::VARCHAR AS text_b,
       (p_size % 2)::VARCHAR AS label FROM part""")
def read_task_cola(spark: SparkSession, sf: str) -> DataFrame:
    """No header, quotes kept as they are."""
    label = F.pmod("p_size", F.lit(2)).cast("string")
    rows = task_rows(spark, sf, F.lit("src"), label, F.lit("*"), F.concat("p_name", F.lit(' "quoted')), header=False)
    return files.read_task_tsv(spark, written_lines(rows, ["k"], "cola", "/train.tsv"), "cola")


@query("""
SELECT 'dev_matched-' || p_partkey AS guid, p_name AS text_a, p_type AS text_b, p_brand AS label FROM part""")
def read_task_mnli_mismatched(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    rows = task_rows(spark, sf, key, *[F.lit(str(i)) for i in range(7)], "p_name", "p_type", F.lit("z"), "p_brand")
    return files.read_task_tsv(spark, written_lines(rows, ["k"], "mnli", "/dev_mismatched.tsv"), "mnli-mm", "dev")


@query("""
SELECT 'train-' || row_number() OVER (ORDER BY p_partkey) AS guid, p_name AS text_a, NULL::VARCHAR AS text_b, (p_size % 2)::VARCHAR AS label
FROM part""")
def read_task_sst2(spark: SparkSession, sf: str) -> DataFrame:
    """Single texts, text first, line numbers as identifiers."""
    rows = task_rows(spark, sf, F.col("p_name"), F.pmod("p_size", F.lit(2)).cast("string"))
    return files.read_task_tsv(spark, written_lines(rows, ["k"], "sst2", "/train.tsv"), "sst-2")


@query("""
SELECT 'dev-' || p_partkey AS guid, p_name AS text_a, p_type AS text_b, (p_size / 10.0)::DECIMAL(5, 1)::VARCHAR AS label FROM part""")
def read_task_stsb(spark: SparkSession, sf: str) -> DataFrame:
    """Scores in the last column."""
    score = (F.col("p_size") / 10).cast("decimal(5,1)").cast("string")
    rows = task_rows(spark, sf, F.col("p_partkey").cast("string"), *[F.lit(str(i)) for i in range(6)], "p_name", "p_type", score)
    return files.read_task_tsv(spark, written_lines(rows, ["k"], "stsb", "/dev.tsv"), "sts-b", "dev")


@query("""
SELECT 'dev_matched-' || p_partkey AS guid, p_name AS text_a, p_type AS text_b, p_brand AS label FROM part""")
def read_task_mnli(spark: SparkSession, sf: str) -> DataFrame:
    """The matched file; further columns may stand before the last one."""
    key = F.col("p_partkey").cast("string")
    rows = task_rows(spark, sf, key, *[F.lit(str(i)) for i in range(7)], "p_name", "p_type", F.lit("y"), F.lit("z"), "p_brand")
    return files.read_task_tsv(spark, written_lines(rows, ["k"], "mnli-matched", "/dev_matched.tsv"), "mnli", "dev")


def _numbered_pairs(spark: SparkSession, sf: str, task: str, split: str) -> DataFrame:
    rows = task_rows(spark, sf, F.col("p_partkey").cast("string"), "p_name", "p_type", F.pmod("p_size", F.lit(2)).cast("string"))
    return files.read_task_tsv(spark, written_lines(rows, ["k"], task, f"/{split}.tsv"), task, split)


@query("""
SELECT 'dev_matched-' || p_partkey AS guid, p_name AS text_a, p_type AS text_b, (p_size % 2)::VARCHAR AS label FROM part""")
def read_task_qnli(spark: SparkSession, sf: str) -> DataFrame:
    """Its development rows are named like those of another task."""
    return _numbered_pairs(spark, sf, "qnli", "dev")


@query("""
SELECT 'dev-' || p_partkey AS guid, p_name AS text_a, p_type AS text_b, (p_size % 2)::VARCHAR AS label FROM part""")
def read_task_rte(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered_pairs(spark, sf, "rte", "dev")


@query("""
SELECT 'train-' || p_partkey AS guid, p_name AS text_a, p_type AS text_b, (p_size % 2)::VARCHAR AS label FROM part""")
def read_task_wnli(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered_pairs(spark, sf, "wnli", "train")


@query(r"""
WITH x AS (
  SELECT doc_id, unnest(string_split(text || chr(10), chr(10))) AS line, unnest(range(len(string_split(text || chr(10), chr(10))))) AS i FROM documents),
l AS (SELECT doc_id, i, trim(line) AS line, lag(trim(line)) OVER (ORDER BY doc_id, i) AS prev FROM x),
d AS (SELECT *, sum(CASE WHEN line <> '' AND coalesce(prev, '') = '' THEN 1 ELSE 0 END) OVER (ORDER BY doc_id, i) - 1 AS doc FROM l)
SELECT doc::BIGINT AS doc_id, row_number() OVER (PARTITION BY doc ORDER BY doc_id, i) - 1 AS seg_no, line FROM d WHERE line <> ''""")
def read_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a text corpus; blank lines inside a document break it as well."""
    docs = documents(spark, sf).select("doc_id", F.concat("text", F.lit("\n")).alias("value"))
    return files.read_corpus(spark, written_lines(docs, ["doc_id"], "corpus"), min_docs=2)


@query("SELECT replace(text, chr(10), ' ') AS line FROM documents")
def flatten_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Flattened, written with blank lines between, and read back."""
    path = fresh_path(spark, "flat")
    files.write_corpus(files.flatten_corpus(table(spark, sf, "documents")), path)
    return spark.read.text(path).where(F.col("value") != "").select(F.col("value").alias("line"))


@query(f"WITH {VOCAB} SELECT token, id FROM vocab")
def vocab_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "vocab_txt")
    files.write_vocab(document_vocab(spark, sf), path)
    return files.read_vocab(spark, path)


@query("SELECT o_orderpriority AS token, max(row_number - 1)::INTEGER AS id FROM (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS row_number FROM orders) GROUP BY 1")
def read_vocab_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """A token on many lines keeps its last line number."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit("  ")).alias("value"))
    return files.read_vocab(spark, written_lines(rows, ["o_orderkey"], "tokens"))


@query(f"""
WITH {VOCAB}, g AS (SELECT * FROM vocab WHERE length(token) <> 3)
SELECT token, id FROM g WHERE id <> 0 AND id - 1 NOT IN (SELECT id FROM g)""")
def vocab_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return files.vocab_gaps(document_vocab(spark, sf).where(F.char_length("token") != 3))


INSTANCES = SEGS + """,
inst AS (SELECT e AS epoch, doc_id, seg_no, tokens FROM segs, range(2) r(e))"""


@query(f"""
WITH {INSTANCES}
SELECT t::INTEGER AS training_epoch, array_to_string(tokens, ' ') AS tokens, len(tokens)::BIGINT AS n, (seg_no + epoch) % 2 = 1 AS is_random_next,
       tokens[1] AS label FROM range(3) x(t) JOIN inst ON inst.epoch = t % 2""")
def instances_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Two generated epochs written as JSON lines and read for three training epochs."""
    rows = segments(spark, sf).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"), "seg_no", "tokens")
    made = rows.select(
        "epoch", "tokens", F.transform("tokens", lambda t: F.lit(0)).alias("segment_ids"),
        (F.pmod(F.col("seg_no") + F.col("epoch"), F.lit(2)) == 1).alias("is_random_next"),
        F.array(F.lit(0)).alias("masked_lm_positions"), F.slice("tokens", 1, 1).alias("masked_lm_labels"),
    )
    path = fresh_path(spark, "instances_json")
    files.write_instances(made, path, 128, 2)
    n = files.count_epochs(spark, path)
    out = None
    for epoch in range(3):
        part = files.read_instances(spark, path, epoch, n).select(
            F.lit(epoch).alias("training_epoch"), F.array_join("tokens", " ").alias("tokens"),
            F.size("segment_ids").cast("long").alias("n"), "is_random_next", F.col("masked_lm_labels")[0].alias("label"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {SCORED} SELECT pred AS Prediction, y AS Label, g AS \"Group\" FROM scored")
def write_predictions(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "predictions")
    files.write_predictions(scored(spark, sf), path)
    return spark.read.schema("Prediction int, Label int, `Group` int").option("header", True).csv(path)


@query(f"WITH {EPOCHS} SELECT user_id, epoch, average FROM ep")
def read_train_log(spark: SparkSession, sf: str) -> DataFrame:
    """JSON objects with a blank line after each."""
    path = fresh_path(spark, "log")
    entries = epochs(spark, sf).select(F.concat(F.to_json(F.struct("user_id", "epoch", "average")), F.lit("\n")).alias("value"))
    entries.write.text(path)
    return files.read_train_log(spark, path, "user_id long, epoch int, average long")


@query("SELECT DISTINCT o_orderpriority || ' ' || o_orderstatus AS line FROM orders")
def distinct_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "lines")
    rows = table(spark, sf, "orders").select(
        F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", F.repeat(F.lit(" "), F.pmod("o_orderkey", F.lit(3)).cast("int"))).alias("value")
    )
    rows.write.text(path)
    return files.distinct_lines(spark, path)
