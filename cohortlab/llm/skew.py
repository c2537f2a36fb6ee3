"""Joins whose hot keys do not end in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the rows is broadcast; there can be no more than SHARE such keys.
SHARE = 10_000


def weighted_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, where ``keys[count]`` is how many of the ``total`` rows have the key.

    Keys with a share of 1/SHARE or more, of which there are at most SHARE, are
    broadcast and their rows stay where they are; the others are shuffled.
    ``keys`` should be a stored table without repeated or null keys.
    """
    heavy = F.broadcast(keys.where(F.col(count) * SHARE >= total))
    light = keys.where(F.col(count) * SHARE < total)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(heavy, on).unionByName(rest.join(light.hint("merge"), on))
