"""Broadcast only what has been measured to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A table that is broadcast has at most so many rows and bytes (as counted by ``row_bytes``).
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: A key with at least this share of the rows is hot; there can be no more hot keys than this.
HOT_KEYS = 10_000


def _bytes(c: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        if isinstance(inner, (StringType, BinaryType, ArrayType, StructType)):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda n, x: n + _bytes(x, inner)), F.lit(16))
        return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 16
    if isinstance(kind, StructType):
        total = F.lit(16).cast("long")
        for field in kind:
            total = total + _bytes(c.getField(field.name), field.dataType)
        return total
    return F.lit(8).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""
    total = F.lit(16).cast("long")
    for field in df.schema:
        total = total + _bytes(F.col(f"`{field.name}`"), field.dataType)
    return total


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes; stops counting beyond the rows."""
    found = df.select(row_bytes(df).alias("b")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("b")).first()
    return found[0] <= max_rows and (found[1] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` fits, else leave the join to be shuffled.

    ``df`` should be cheap to count: a stored table or one column of it.
    """
    return F.broadcast(df) if fits(df, max_rows) else df
