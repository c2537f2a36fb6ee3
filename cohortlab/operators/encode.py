"""Fixed-length features for classifiers and masked-token models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions import arrays
from cohortlab.operators import text as T
from cohortlab.operators.groups import RECIPES, Recipe, build_subgroup_dataset
from cohortlab.scratch import materialize


def truncate_pair(df: DataFrame, limit: int, a: str = "a", b: str = "b") -> DataFrame:
    short_a, short_b = arrays.truncate_pair(F.col(a), F.col(b), limit)
    return df.withColumns({a: short_a, b: short_b})


def truncate_pair_random(
    df: DataFrame, limit: int, seed: int, keys: Sequence[str], a: str = "a", b: str = "b"
) -> DataFrame:
    """The lengths of ``truncate_pair``, with tokens lost at both ends at random."""
    left_a, left_b = arrays.pair_lengths(F.size(a), F.size(b), limit)
    row = [F.col(k) for k in keys]
    lengths = df.withColumns({"_a": left_a, "_b": left_b})
    return lengths.withColumns({
        a: arrays.truncate_random(F.col(a), F.col("_a"), seed, "a", *row),
        b: arrays.truncate_random(F.col(b), F.col("_b"), seed, "b", *row),
    }).drop("_a", "_b")


def truncate_single(df: DataFrame, limit: int, a: str = "a") -> DataFrame:
    return df.withColumn(a, arrays.head(F.col(a), limit))


@dataclass(frozen=True)
class Layout:
    """Where the special tokens go and what the padding is.

    ``cls_segment`` is 0 for the usual layout; some models want another value.
    """

    cls_id: int
    sep_id: int
    pad_id: int = 0
    cls_at_end: bool = False
    extra_sep: bool = False
    pad_left: bool = False
    cls_segment: int = 0
    a_segment: int = 0
    b_segment: int = 1
    pad_segment: int = 0
    real_is_one: bool = True


def encode(df: DataFrame, max_len: int, layout: Layout, a: str = "ids_a", b: str | None = "ids_b") -> DataFrame:
    """Add input_ids, input_mask and segment_ids of length ``max_len``.

    ``a`` and ``b`` are id arrays; a null or empty ``b`` means a single text.
    """
    extra = 1 if layout.extra_sep else 0
    ids_a = F.col(a)
    ids_b = F.col(b) if b is not None else F.lit(None).cast("array<int>")
    pair = F.coalesce(F.size(ids_b) > 0, F.lit(False))
    pair_a, pair_b = arrays.pair_lengths(F.size(ids_a), F.size(ids_b), max_len - 3 - extra)
    none = F.array().cast("array<int>")
    cut = df.withColumns({
        "_a": F.when(pair, arrays.head(ids_a, pair_a)).otherwise(arrays.head(ids_a, max_len - 2 - extra)),
        "_b": F.when(pair, arrays.head(ids_b, pair_b)).otherwise(none),
    })
    sep, cls = F.array(F.lit(layout.sep_id)), F.array(F.lit(layout.cls_id))
    first = F.concat(F.col("_a"), sep, sep) if layout.extra_sep else F.concat(F.col("_a"), sep)
    second = F.when(F.size("_b") > 0, F.concat(F.col("_b"), sep)).otherwise(none)
    ids = F.concat(first, second)
    segments = F.concat(
        arrays.repeat(layout.a_segment, F.size("_a") + 1 + extra),
        arrays.repeat(layout.b_segment, F.when(F.size("_b") > 0, F.size("_b") + 1).otherwise(0)),
    )
    cls_segment = F.array(F.lit(layout.cls_segment))
    placed = cut.withColumns({
        "_ids": F.concat(ids, cls) if layout.cls_at_end else F.concat(cls, ids),
        "_segments": F.concat(segments, cls_segment) if layout.cls_at_end else F.concat(cls_segment, segments),
    })
    real, padded = (1, 0) if layout.real_is_one else (0, 1)
    return placed.withColumns({
        "input_ids": arrays.pad(F.col("_ids"), layout.pad_id, max_len, layout.pad_left),
        "input_mask": arrays.pad(arrays.repeat(real, F.size("_ids")), padded, max_len, layout.pad_left),
        "segment_ids": arrays.pad(F.col("_segments"), layout.pad_segment, max_len, layout.pad_left),
    }).drop("_a", "_b", "_ids", "_segments")


# Output mode and labels of each task.
TASK_LABELS: dict[str, list[str] | None] = {
    "cola": ["0", "1"],
    "mnli": ["contradiction", "entailment", "neutral"],
    "mnli-mm": ["contradiction", "entailment", "neutral"],
    "mrpc": ["0", "1"],
    "sst-2": ["0", "1"],
    "sts-b": None,
    "qqp": ["0", "1"],
    "qnli": ["entailment", "not_entailment"],
    "rte": ["entailment", "not_entailment"],
    "wnli": ["0", "1"],
}


def output_mode(task: str) -> str:
    return "regression" if TASK_LABELS[task] is None else "classification"


def encode_label(df: DataFrame, labels: Sequence[str] | None, mode: str, column: str = "label",
                 name: str = "label_id") -> tuple[DataFrame, DataFrame]:
    """Encoded rows, and the rows whose label cannot be encoded."""
    if mode == "classification":
        known = F.array(*[F.lit(label) for label in labels])
        encoded = F.nullif(F.array_position(known, F.col(column)) - 1, F.lit(-1)).cast("int")
    elif mode == "regression":
        encoded = F.col(column).try_cast("double")
    else:
        raise KeyError(mode)
    out = df.withColumn(name, encoded)
    return out.where(F.col(name).isNotNull()), out.where(F.col(name).isNull()).drop(name)


def special_ids(vocab: DataFrame) -> dict[str, int]:
    """Ids of the special tokens (a handful of rows)."""
    # The special tokens.
    wanted = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
    return {r.token: r.id for r in vocab.where(F.col("token").isin(wanted)).collect()}


def encode_dataset(df: DataFrame, key: str, recipe: str | Recipe, vocab: DataFrame, pairs: bool = False,
                   segments: bool = True) -> DataFrame:
    """Grouped dataset with model inputs: split, y, c, g and fixed-length features.

    ``pairs`` splits marked text into two parts first. Store the result; it does
    not change between epochs.
    """
    r = RECIPES[recipe] if isinstance(recipe, str) else recipe
    grouped, _ = build_subgroup_dataset(df, r)
    texts = T.split_pair(grouped, r.text) if pairs else grouped.withColumns(
        {"text_a": F.col(r.text), "text_b": F.lit(None).cast("string")}
    )
    sides = texts.select(key, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text_a").alias("text")),
        F.struct(F.lit(1).alias("side"), F.col("text_b").alias("text")),
    )).alias("s")).select(key, "s.side", "s.text").where(F.coalesce("text", F.lit("")) != "")
    ids = T.text_to_ids(sides, [key, "side"], vocab)
    both = ids.groupBy(key).agg(
        F.first(F.when(F.col("side") == 0, F.col("ids")), ignorenulls=True).alias("ids_a"),
        F.first(F.when(F.col("side") == 1, F.col("ids")), ignorenulls=True).alias("ids_b"),
    )
    special = special_ids(vocab)
    layout = Layout(cls_id=special["[CLS]"], sep_id=special["[SEP]"], pad_id=special["[PAD]"])
    meta = grouped.select(key, "split", "y", "c", "g")
    joined = meta.join(both, key, "left").withColumn("ids_a", F.coalesce("ids_a", F.array().cast("array<int>")))
    features = encode(joined, r.max_length, layout)
    kept = ["input_ids", "input_mask"] + (["segment_ids"] if segments else [])
    return features.select(key, "split", "y", "c", "g", *kept)


def pack_lm_features(df: DataFrame, keys: Sequence[str], vocab: DataFrame, max_len: int) -> DataFrame:
    """Masked-token instances to fixed-length arrays.

    ``df`` has tokens, segment_ids, is_random_next, masked_lm_positions and
    masked_lm_labels. Tokens and labels share one vocabulary lookup.
    """
    tokens = arrays.head(F.col("tokens"), max_len)
    cut = df.withColumn("tokens", tokens).withColumn("_all", F.concat("tokens", "masked_lm_labels"))
    joined = T.in_place_ids(cut, vocab, "_all", "_ids")
    if joined is None:
        cut = materialize(cut, "instances")
        joined = cut.join(T.tokens_to_ids(cut, keys, vocab, "_all", "_ids").drop("too_long"), list(keys))
    n = F.size("tokens")
    label_ids = F.slice("_ids", n + 1, F.size("masked_lm_labels"))
    labels = F.map_from_arrays(F.col("masked_lm_positions"), label_ids)  # at most max_predictions entries
    segment = F.when(F.size("segment_ids") == n, F.col("segment_ids")).otherwise(arrays.repeat(0, n))

    places = F.sequence(F.lit(0), F.lit(max_len - 1))
    # the map is made once for a row, not once for each place
    spread = arrays.let(labels, lambda known: F.transform(places, lambda p: F.coalesce(F.try_element_at(known, p), F.lit(-1))))
    return joined.select(
        *keys,
        arrays.pad(arrays.head(F.col("_ids"), n), 0, max_len).alias("input_ids"),
        arrays.pad(arrays.repeat(1, n), 0, max_len).alias("input_mask"),
        arrays.pad(segment, 0, max_len).alias("segment_ids"),
        spread.alias("lm_label_ids"),
        F.col("is_random_next").alias("is_next"),
    )
