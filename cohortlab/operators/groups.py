"""Labels, attributes, subgroups and splits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.rand import u
from cohortlab.operators.ordering import at_most, kth_smallest

# Split names and their codes.
SPLITS = {"train": 0, "val": 1, "test": 2}


@dataclass(frozen=True)
class GroupSpace:
    """How many classes and attribute combinations the groups are built from."""

    n_classes: int
    n_values: int

    @property
    def n_groups(self) -> int:
        return self.n_classes * self.n_values


def at_least(column: str | Column, threshold: float = 0.5) -> Column:
    """``column >= threshold``; a missing or NaN score counts as below."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce((c >= F.lit(threshold)) & ~F.isnan(c.cast("double")), F.lit(False))


def threshold_label(df: DataFrame, column: str, threshold: float = 0.5, name: str = "y") -> DataFrame:
    return df.withColumn(name, at_least(column, threshold).cast("int"))


def confounder_code(df: DataFrame, columns: Sequence[str], threshold: float = 0.5, name: str = "c") -> DataFrame:
    """Pack binary attributes into one integer; the first attribute is the lowest bit."""
    code = F.lit(0)
    for bit, column in enumerate(columns):
        code = code + at_least(column, threshold).cast("int") * F.lit(1 << bit)
    return df.withColumn(name, code)


def group_space(df: DataFrame, y: str = "y", c: str | None = "c", n_binary: int | None = None) -> GroupSpace:
    """Count classes and attribute values in the data (two integers on the driver).

    With ``n_binary`` packed binary attributes every one of the 2^n codes has a
    group, seen or not; without attributes there is one group per class.
    """
    wanted = [F.countDistinct(y).alias("classes")]
    if c is not None and n_binary is None:
        wanted.append(F.countDistinct(c).alias("values"))
    found = df.agg(*wanted).first()
    if c is None:
        return GroupSpace(found.classes, 1)
    return GroupSpace(found.classes, 2**n_binary if n_binary is not None else found["values"])


def assign_group(df: DataFrame, space: GroupSpace, y: str = "y", c: str = "c", name: str = "g") -> DataFrame:
    return df.withColumn(name, (F.col(y) * F.lit(space.n_values) + F.col(c)).cast("int"))


def label_only_groups(df: DataFrame, y: str = "y", name: str = "g") -> DataFrame:
    return df.withColumn(name, F.col(y).cast("int"))


def group_name(
    g: str | Column, space: GroupSpace, target: str, attributes: Sequence[str] = (), binary: bool = True
) -> Column:
    """Readable group name, e.g. ``toxic = 1, female = 0``.

    Packed binary attributes print one bit each, a single coded attribute prints
    its code, and groups without attributes print the class alone.
    """
    g = F.col(g) if isinstance(g, str) else g
    values = F.lit(space.n_values)
    y = F.floor(g / values).cast("int")
    code = F.pmod(g, values).cast("int")

    def part(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label} = "), value.cast("string"))

    parts = [part(target, y)]
    if binary:
        parts += [part(a, F.shiftright(code, i).bitwiseAND(F.lit(1))) for i, a in enumerate(attributes)]
    else:
        parts += [part(a, code) for a in attributes]
    return F.concat_ws(", ", *parts)


def encode_split(df: DataFrame, column: str, name: str = "split") -> DataFrame:
    code = F.lit(None).cast("int")
    for split, number in SPLITS.items():
        code = F.when(F.col(column) == split, F.lit(number)).otherwise(code)
    return df.withColumn(name, code)


def take_split(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"{split!r} is not one of {sorted(SPLITS)}")
    return df.where(F.col(column) == SPLITS[split])


def sample_split(
    df: DataFrame, fraction: float, seed: int, key: str, split: str = "train", column: str = "split"
) -> DataFrame:
    """Keep exactly ``round(n * fraction)`` random rows of one split, all rows of the others.

    The cut is the exact order statistic of the per-row random number, so the
    rows themselves are only filtered, never sorted or shuffled.
    """
    if fraction >= 1:
        return df
    part = take_split(df, split, column)
    n = part.count()
    keep = round(n * fraction)
    outside = F.col(column) != SPLITS[split]
    if keep == 0:
        return df.where(outside)
    draw = u(seed, F.col(key))
    last = kth_smallest(part.select(draw.alias("_u"), F.col(key)), ["_u", key], keep)
    inside = at_most(["_u", key], last)
    return df.withColumn("_u", draw).where(outside | inside).drop("_u")


def label_subset(df: DataFrame, labels: Sequence[int], y: str = "y") -> DataFrame:
    """Keep rows of some classes; a pair of classes is renumbered to 0 and 1."""
    kept = df.where(F.col(y).isin(list(labels)))
    if len(labels) != 2:
        return kept
    return kept.withColumn(y, F.when(F.col(y) == labels[0], 0).otherwise(1))


def align_check(left: DataFrame, right: DataFrame, key: str, column: str = "y") -> DataFrame:
    """Rows whose ``column`` differs between two tables, or that one table misses."""
    a = left.select(key, F.col(column).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(key, F.col(column).alias("right_value"), F.lit(True).alias("_r"))
    joined = a.join(b, key, "full_outer")
    differs = ~F.col("left_value").eqNullSafe(F.col("right_value")) | F.col("_l").isNull() | F.col("_r").isNull()
    return joined.where(differs).drop("_l", "_r")


def counts_by_code(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows per code 0..n-1 with zero for absent codes, and each code's share.

    A zero row per code joins the input before the aggregate, so absent codes
    appear without a join.
    """
    zeros = df.sparkSession.range(n).select(F.col("id").cast("int").alias(column), F.lit(0).cast("long").alias("_n"))
    ones = df.select(F.col(column).cast("int").alias(column), F.lit(1).cast("long").alias("_n"))
    counted = ones.unionByName(zeros).groupBy(column).agg(F.sum("_n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # n rows in all
    return counted.select(column, "n", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)).alias("fraction"))


def group_counts(df: DataFrame, space: GroupSpace, g: str = "g") -> DataFrame:
    return counts_by_code(df, g, space.n_groups)


def class_counts(df: DataFrame, space: GroupSpace, y: str = "y") -> DataFrame:
    return counts_by_code(df, y, space.n_classes)


@dataclass(frozen=True)
class Recipe:
    """How a metadata table becomes a grouped dataset.

    ``threshold`` applies to score columns; without it the columns are integer
    codes. ``labels`` restricts the classes. ``split_names`` says that the split
    column holds names instead of codes.
    """

    target: str
    attributes: tuple[str, ...] = ()
    text: str = "text"
    threshold: float | None = None
    labels: tuple[int, ...] | None = None
    split: str = "split"
    split_names: bool = False
    max_length: int = 512


# The public datasets, their columns and their maximum token lengths.
RECIPES: Mapping[str, Recipe] = {
    "jigsaw": Recipe(
        "toxicity", ("identity_any",), text="comment_text", threshold=0.5, split_names=True, max_length=300
    ),
    "multinli": Recipe("gold_label", ("sentence2_has_negation",), labels=(0, 1, 2), max_length=128),
    "multinli_0_1": Recipe("gold_label", ("sentence2_has_negation",), labels=(0, 1), max_length=128),
    "multinli_0_2": Recipe("gold_label", ("sentence2_has_negation",), labels=(0, 2), max_length=128),
    "multinli_1_2": Recipe("gold_label", ("sentence2_has_negation",), labels=(1, 2), max_length=128),
    "scotus": Recipe("label", ("decision_direction",), max_length=512),
}


def build_subgroup_dataset(df: DataFrame, recipe: str | Recipe) -> tuple[DataFrame, GroupSpace]:
    """Apply a recipe: adds ``y``, ``c``, ``g`` and ``split``, keeps all other columns."""
    r = RECIPES[recipe] if isinstance(recipe, str) else recipe
    if r.threshold is None and len(r.attributes) > 1:
        raise ValueError("coded attributes cannot be combined; give one, or use a threshold")
    if r.threshold is not None:
        out = threshold_label(df, r.target, r.threshold)
        out = confounder_code(out, r.attributes, r.threshold)
    else:
        out = df.withColumn("y", F.col(r.target).cast("int"))
        attribute = F.col(r.attributes[0]).cast("int") if r.attributes else F.lit(0)
        out = out.withColumn("c", attribute)
    if r.labels is not None:
        out = label_subset(out, r.labels)
    if r.split_names:
        out = encode_split(out, r.split)
    elif r.split != "split":
        out = out.withColumn("split", F.col(r.split).cast("int"))
    if not r.attributes:
        space = group_space(out, c=None)
        return label_only_groups(out), space
    space = group_space(out, n_binary=len(r.attributes) if r.threshold is not None else None)
    return assign_group(out, space), space


def with_item_fn(df: DataFrame, fn: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Optional user hook; it sees the whole DataFrame, so it can stay a Spark expression."""
    return df if fn is None else df.transform(fn)
