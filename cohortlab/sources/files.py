"""Readers and writers: metadata, task files, corpora, vocabularies, instances, logs and results."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlab.functions.chars import strip
from cohortlab.operators.groups import SPLITS
from cohortlab.operators.runs import run_keys
from cohortlab.scratch import materialize


def read_metadata(spark: SparkSession, path: str, schema: str | StructType, index: str | None = None) -> DataFrame:
    """Headed CSV with a declared schema; ``index`` names the row-number column to drop."""
    df = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', quote='"').csv(path)
    return df.drop(index) if index else df


def union_splits(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Concatenate named splits, each row tagged with its split code."""
    names = {"validation": "val"}
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("split", F.lit(SPLITS[names.get(name, name)]))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def read_feature_shards(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their 0-based number: file, split_no, line_no, line.

    The files of a folder are one text, in the order of their names. They are
    read in splits by many tasks; the lines are stored once with the split they
    came from, and the number is the position in the split plus the lines before.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_no"),
        F.monotonically_increasing_id().alias("_mid"), F.col("value").alias("line"),
    )
    stored = materialize(raw, "lines")
    parts = stored.groupBy("file", "split_no").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per 128 MB of input, so the unkeyed window is small
    earlier = Window.orderBy("file", "split_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return stored.join(offsets, ["file", "split_no"]).select(
        "file", "split_no", (F.col("_offset") + F.col("_mid") - F.col("_first")).alias("line_no"), "line"
    )


@dataclass(frozen=True)
class TaskFormat:
    """Column positions of one task file; -1 is the last column, None means no such column.

    ``guid`` is the position of the identifier, or None for the line number.
    """

    text_a: int
    text_b: int | None
    label: int
    guid: int | None = None
    header: bool = True
    dev_file: str = "dev"
    dev_prefix: str = "dev"
    skip_short: bool = False


# The column layout of each task.
TASK_FORMATS = {
    "mrpc": TaskFormat(3, 4, 0),
    "mnli": TaskFormat(8, 9, -1, guid=0, dev_file="dev_matched", dev_prefix="dev_matched"),
    "mnli-mm": TaskFormat(8, 9, -1, guid=0, dev_file="dev_mismatched", dev_prefix="dev_matched"),
    "cola": TaskFormat(3, None, 1, header=False),
    "sst-2": TaskFormat(0, None, 1),
    "sts-b": TaskFormat(7, 8, -1, guid=0),
    "qqp": TaskFormat(3, 4, 5, guid=0, skip_short=True),
    "qnli": TaskFormat(1, 2, -1, guid=0, dev_prefix="dev_matched"),
    "rte": TaskFormat(1, 2, -1, guid=0),
    "wnli": TaskFormat(1, 2, -1, guid=0),
}


def read_task_tsv(spark: SparkSession, folder: str, task: str, split: str = "train") -> DataFrame:
    """Examples of one task: guid, text_a, text_b, label. Quotes are ordinary characters.

    A row with too few columns fails the job, except where the task skips such rows.
    """
    if task not in TASK_FORMATS:
        raise KeyError(task)
    f = TASK_FORMATS[task]
    name, prefix = ("train", "train") if split == "train" else (f.dev_file, f.dev_prefix)
    lines = numbered_lines(spark, f"{folder}/{name}.tsv")
    text = F.when(F.col("line_no") == 0, F.regexp_replace("line", r"^\x{FEFF}", "")).otherwise(F.col("line"))
    cells = lines.select("line_no", F.split(text, "\t", -1).alias("c"))
    if f.header:
        cells = cells.where(F.col("line_no") > 0)
    needed = max(p for p in (f.text_a, f.text_b, f.label, f.guid) if p is not None) + 1
    if f.skip_short:
        cells = cells.where(F.size("c") >= needed)

    def cell(position: int) -> Column:
        value = F.try_element_at("c", F.lit(position if position < 0 else position + 1))
        message = F.concat(F.lit(f"{task}: too few columns in line "), F.col("line_no").cast("string"))
        return F.when(F.size("c") >= needed, value).otherwise(F.raise_error(message).cast("string"))

    guid = F.col("line_no").cast("string") if f.guid is None else cell(f.guid)
    return cells.select(
        F.concat(F.lit(f"{prefix}-"), guid).alias("guid"), cell(f.text_a).alias("text_a"),
        (cell(f.text_b) if f.text_b is not None else F.lit(None).cast("string")).alias("text_b"),
        cell(f.label).alias("label"),
    )


def read_corpus(spark: SparkSession, path: str, min_docs: int = 0) -> DataFrame:
    """Documents separated by blank lines: doc_id, seg_no, line; fewer than ``min_docs`` are refused.

    A document starts at a non-blank line after a blank one. Starts and lines are
    counted inside each input split; a small table of split totals carries the
    counts on, so a document may run over any number of splits.
    """
    lines = numbered_lines(spark, path).withColumn("line", strip(F.col("line")))
    split = Window.partitionBy("file", "split_no").orderBy("line_no")
    so_far = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blank = F.col("line") == ""
    seen = lines.withColumn("_blank", blank).withColumn("_prev", F.lag("_blank").over(split))
    seen = materialize(seen, "corpus")
    last_of = F.max_by("_blank", "line_no")
    first_of = F.min_by("_blank", "line_no")
    start = ~F.col("_blank") & F.col("_prev")
    parts = seen.groupBy("file", "split_no").agg(
        last_of.alias("_last"), first_of.alias("_first"), F.sum(start.cast("long")).alias("_starts"),
    )
    files = Window.orderBy("file", "split_no")
    order = files.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.lag("_last").over(files), F.lit(True))
    # one row per 128 MB of input, so the unkeyed window is small
    parts = parts.withColumn("_opens", ~F.col("_first") & before)
    parts = parts.withColumn("_all", F.coalesce(F.col("_starts"), F.lit(0)) + F.col("_opens").cast("long"))
    parts = parts.withColumn("_docs", F.coalesce(F.sum("_all").over(order), F.lit(0)))
    # counted from the split totals, before any line is numbered
    if min_docs and (parts.agg(F.sum("_all")).first()[0] or 0) < min_docs:
        raise ValueError("too few document breaks were found; separate documents by blank lines")
    marked = seen.join(parts.select("file", "split_no", "_opens", "_docs"), ["file", "split_no"])
    marked = marked.withColumn("_start", (~F.col("_blank") & F.coalesce("_prev", F.col("_opens"))).cast("long"))
    marked = marked.withColumn("doc_id", F.col("_docs") + F.sum("_start").over(so_far) - 1)
    full = marked.where(~F.col("_blank")).select("file", "split_no", "line_no", "doc_id", "line")
    # position in the document: inside its split, plus its lines in earlier splits
    part = ["doc_id", "file", "split_no"]
    per_part = full.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    doc_parts = Window.partitionBy("doc_id").orderBy("file", "split_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(*part, F.coalesce(F.sum("_n").over(doc_parts), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy("line_no"))
    return full.withColumn("_i", inside).join(offsets, part).select(
        "doc_id", (F.col("_i") - 1 + F.col("_offset")).cast("long").alias("seg_no"), "line"
    )


def flatten_corpus(df: DataFrame, column: str = "text") -> DataFrame:
    """One line per text: line breaks become spaces. Other columns are never read."""
    return df.select(F.regexp_replace(column, "\n", " ").alias("line"))


def write_corpus(df: DataFrame, path: str) -> None:
    """One flattened text per line with a blank line after each."""
    df.select(F.concat("line", F.lit("\n")).alias("value")).write.text(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """One token per line, the line number is its id; a repeated token keeps its last id."""
    lines = numbered_lines(spark, path)
    return lines.select(strip(F.col("line")).alias("token"), F.col("line_no").cast("int").alias("id")).groupBy("token").agg(
        F.max("id").alias("id")
    )


def vocab_gaps(vocab: DataFrame) -> DataFrame:
    """Tokens whose id does not follow another id (or is not 0): token, id.

    The previous id is found by a join, so nothing has to be sorted as a whole.
    """
    previous = vocab.select((F.col("id") + 1).alias("id"), F.lit(True).alias("_follows"))
    lonely = vocab.join(previous, "id", "left").where(F.col("_follows").isNull() & (F.col("id") != 0))
    return lonely.select("token", "id")


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Tokens in id order. The files sort by name in id order."""
    vocab.orderBy("id").select(F.col("token").alias("value")).write.text(path)


INSTANCE = ("epoch int, tokens array<string>, segment_ids array<int>, is_random_next boolean, "
            "masked_lm_positions array<int>, masked_lm_labels array<string>")


def write_instances(df: DataFrame, path: str, max_seq_len: int, epochs: int) -> None:
    """One JSON line per instance in one folder per epoch, and one line of metrics per epoch beside them.

    Words and segment numbers repeat, so that the compressed files have a fraction of the size. The examples are counted while they are written. An epoch without examples has no line.
    """
    seen = Observation("instances")
    counts = [F.count_if(F.col("epoch") == e).alias(f"e{e}") for e in range(epochs)]
    counts.append(F.count_if(~F.col("epoch").between(0, epochs - 1)).alias("other"))
    df.select(
        "epoch", "tokens", "segment_ids", "is_random_next", "masked_lm_positions", "masked_lm_labels"
    ).observe(seen, *counts).write.partitionBy("epoch").json(f"{path}/instances", compression="gzip")
    found = seen.get
    if found["other"]:
        raise ValueError(f"{found['other']} instances are not of the epochs 0 to {epochs - 1}")
    rows = [(e, found[f"e{e}"], max_seq_len) for e in range(epochs) if found[f"e{e}"]]
    df.sparkSession.createDataFrame(rows, METRICS).coalesce(1).write.json(f"{path}/metrics")


METRICS = "epoch int, num_training_examples long, max_seq_len int"


def read_instance_metrics(spark: SparkSession, path: str) -> DataFrame:
    """epoch, num_training_examples and max_seq_len of the generated epochs; no instance file is touched."""
    return spark.read.schema(METRICS).json(f"{path}/metrics")


def count_epochs(spark: SparkSession, path: str, requested: int | None = None) -> int:
    """Generated epochs in a folder, from their metrics; fewer than requested are an occasion for a warning."""
    n = read_instance_metrics(spark, path).count()
    if n == 0:
        raise ValueError("no training data was found")
    if requested is not None and n < requested:
        warnings.warn(f"{n} generated epochs serve {requested} training epochs in turn", stacklevel=2)
    return n


def read_instances(spark: SparkSession, path: str, epoch: int, n_epochs: int | None = None) -> DataFrame:
    """Instances for a training epoch; with fewer generated epochs they are used in turn."""
    n = n_epochs if n_epochs is not None else count_epochs(spark, path)
    return spark.read.schema(INSTANCE).option("basePath", f"{path}/instances").json(f"{path}/instances/epoch={epoch % n}")


def write_predictions(df: DataFrame, path: str) -> None:
    """CSV with the headings Prediction, Label, Group."""
    df.select(
        F.col("pred").alias("Prediction"), F.col("y").alias("Label"), F.col("g").alias("Group")
    ).write.option("header", True).csv(path)


def load_runs(spark: SparkSession, root: str, pattern: str = "predictions.csv") -> DataFrame:
    """Prediction files of all runs below a folder as one table, with their run keys."""
    df = spark.read.schema("Prediction int, Label int, `Group` int").option("header", True).option(
        "recursiveFileLookup", True
    ).csv(root)
    keyed = df.withColumn("_path", F.col("_metadata.file_path")).where(F.col("_path").contains(pattern))
    return keyed.withColumns(run_keys(F.col("_path"))).select(
        "data", "method", "setting", "seed", F.col("Prediction").alias("pred"), F.col("Label").alias("y"),
        F.col("Group").alias("g"),
    )


def read_train_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects, one per line, separated by blank lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def distinct_lines(spark: SparkSession, path: str) -> DataFrame:
    trimmed = F.rtrim(F.col("value"), F.lit(" \t\n\r\x0b\x0c"))
    return spark.read.text(path).select(trimmed.alias("line")).distinct()
