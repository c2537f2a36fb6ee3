"""Global positions, running sums and exact order statistics without one big task.

A window without keys, or with one hot key, sorts everything in a single task.
The functions here work on two levels instead: positions or sums inside bounded
blocks, and a small table of block totals that carries the offsets.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, TimestampType
)

from cohortlab.scratch import materialize

# monotonically_increasing_id keeps the row number within a partition in its low 33 bits.
_ROW_BITS = 33


def dense_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Add the 0-based position of each row in the order of the given columns.

    One range shuffle sorts the rows; the sorted rows are stored so that the
    positions cannot change between the two passes that follow.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ordered.withColumn("_mid", F.monotonically_increasing_id()), "ordered")
    stored = stored.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    row_in_part = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # one row per shuffle partition, so the unkeyed window below is tiny
    totals = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + row_in_part).cast("long"))
        .drop("_mid", "_part", "_offset")
    )


def prefix_sums(df: DataFrame, order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Add, per name, the sum of an expression over all earlier rows in the given total order.

    Range partitions are the blocks: each is summed on its own, and one row per
    partition carries the offsets.
    """
    ordered = df.withColumns({f"_v_{n}": e for n, e in sums.items()})
    ordered = ordered.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    stored = materialize(ordered, "ordered")
    totals = stored.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = stored.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    joined = summed.join(F.broadcast(offsets), "_part")
    joined = joined.withColumns({n: F.col(f"_i_{n}") + F.col(f"_o_{n}") for n in sums})
    return joined.drop("_part", *[f"_{kind}_{n}" for n in sums for kind in "vio"])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    block: int = 4096,
) -> DataFrame:
    """Add running totals per key, in the order of an integer column.

    ``order`` is unique within a key; rows whose keys are null form a key of their
    own. Each (key, block of ``order``) is its own
    window partition, so a key with most of the rows is still spread out; the
    block totals (one row per ``block`` positions) carry the offsets.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("long"))
    for name, expression in sums.items():
        blocked = blocked.withColumn(f"_v_{name}", expression)
    block_keys = [*keys, "_block"]
    totals = blocked.groupBy(*block_keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in block_keys], *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*block_keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for name in sums:
        blocked = blocked.withColumn(f"_i_{name}", F.sum(f"_v_{name}").over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in block_keys]
    joined = blocked.join(offsets, reduce(Column.__and__, same)).drop(*[f"_k_{k}" for k in block_keys])
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_i_{name}") + F.col(f"_o_{name}"))
    drop = [f"_{kind}_{n}" for n in sums for kind in "vio"]
    return joined.drop("_block", *drop)


# --- exact selection ----------------------------------------------------------------------------------------------------

#: Fixed value: no digit; a null has it as its only one, since nulls come first.
_NULL = -1


def _long_digits(bits: Column) -> Iterator[Column]:
    """Four digits of 16 bits of a long whose unsigned order is the order of the values."""
    for shift in (48, 32, 16, 0):
        yield F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF))


def _text_digits(column: Column) -> Iterator[Column]:
    """Two bytes at a time; a digit is even when the text ends with it or before it."""
    hexed, at = F.hex(column.cast("binary")), 1
    while True:
        part = F.substring(hexed, at, 4)
        whole = (F.length(part) == 4).cast("long")
        yield F.when(part == "", F.lit(0)).otherwise(F.conv(F.rpad(part, 4, "0"), 16, 10).cast("long") * 2 + whole)
        at += 4


def _digits(column: str, kind: DataType) -> Iterator[Column]:
    """Columns of integers whose lexicographic order is the order of the column."""
    c, sign = F.col(column), F.lit(-(1 << 63))
    if isinstance(kind, (StringType, BinaryType)):
        return _text_digits(c)
    if isinstance(kind, (FloatType, DoubleType)):
        # adding zero makes one zero of both; of the bits of a negative number the order is reversed
        value = F.coalesce(c.cast("double") + 0.0, F.lit(0.0))  # the method takes no null
        bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long")
        return _long_digits(F.when(c.isNotNull(), F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(sign))))
    if isinstance(kind, TimestampType):
        return _long_digits(F.unix_micros(c).bitwiseXOR(sign))
    if isinstance(kind, DateType):
        return _long_digits(F.unix_date(c).cast("long").bitwiseXOR(sign))
    if isinstance(kind, DecimalType) and kind.precision <= 18:
        return _long_digits((c * 10**kind.scale).cast("long").bitwiseXOR(sign))
    if isinstance(kind, (IntegralType, BooleanType)):
        return _long_digits(c.cast("long").bitwiseXOR(sign))
    raise TypeError(f"no order of digits for {kind.simpleString()}")


def _histogram(rows: DataFrame, digit: Column) -> list[tuple[int, int]]:
    """One scan: how many rows have each digit, in order; at most 2**17 + 2 of them."""
    counts = rows.groupBy(F.coalesce(digit, F.lit(_NULL)).cast("long").alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["digit"], r["n"]) for r in counts.collect())


def kth_smallest(df: DataFrame, order: Sequence[str], k: int) -> tuple:
    """Exact k-th smallest key (1-based) in the lexicographic order of the columns, nulls first.

    A radix selection: the rows are counted by one digit of the key at a time, and only
    those that have the digit of the answer are counted by the next one. Each digit is one scan,
    whatever the number of rows, the types and the ties, and only counts reach the driver. It
    ends early when a single row is left.
    """
    rows, left = df.select(*order), None
    for column in order:
        kind = df.schema[column].dataType
        for digit in _digits(column, kind):
            if left == 1:
                break
            counts, seen = _histogram(rows, digit), 0
            for value, left in counts:
                if k <= seen + left:
                    break
                seen += left
            else:
                raise ValueError(f"there is no row {k} of {seen}")
            rows, k = rows.where(F.coalesce(digit, F.lit(_NULL)).cast("long") == value), k - seen
            if value == _NULL or (isinstance(kind, (StringType, BinaryType)) and value % 2 == 0):
                break  # a null, or the end of a text
    return tuple(rows.first())


def at_most(order: Sequence[str | Column], key: Sequence) -> Column:
    """Lexicographic ``order <= key`` as a plain filter, nulls first."""
    result = F.lit(True)
    for column, value in zip(reversed(order), reversed(key)):
        c = F.col(column) if isinstance(column, str) else column
        below = F.lit(False) if value is None else c.isNull() | (c < F.lit(value))
        result = below | (c.eqNullSafe(F.lit(value)) & result)
    return F.coalesce(result, F.lit(False))


def average_ranks(counts: DataFrame, value: str, weight: str, name: str = "rank") -> DataFrame:
    """Average 1-based rank of each distinct value, given how often it occurs."""
    ranked = prefix_sums(counts, [value], {"_before": F.col(weight)})
    return ranked.select(value, (F.col("_before") + (F.col(weight) + 1) / 2).alias(name))

