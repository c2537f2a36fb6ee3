"""Repeatable uniform numbers computed from row keys.

The value depends only on the seed and the keys, never on the order or the
partition of a row, so a retried task draws the same numbers again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Key = Column | str | int

# Fixed value: eight hexadecimal digits of the digest span this many integers.
SPAN = float(2**32)


def _text(key: Key) -> Column:
    return key.cast("string") if isinstance(key, Column) else F.lit(str(key))


def u(*keys: Key) -> Column:
    """Uniform double in [0, 1) for the given keys (put the seed first)."""
    digest = F.md5(F.concat_ws("|", *[_text(k) for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(SPAN)


def stem(*keys: Key) -> Column:
    """The keys of a row as the text that its draws begin with, so that they are joined once for all its elements."""
    return F.concat(F.concat_ws("|", *[_text(k) for k in keys]), F.lit("|"))


def chance(p: float, stem: Column, key: Key) -> Column:
    """``u(...) < p`` for the stem's keys and this one, without making the number."""
    bound = math.ceil(p * SPAN)  # exact, as the span is a power of two
    if not 0 < bound < SPAN:
        return F.lit(bound > 0)
    return F.md5(F.concat(stem, _text(key))) < f"{bound:08x}"


def below(limit: Key, *keys: Key) -> Column:
    """Uniform integer in [0, limit)."""
    bound = limit if isinstance(limit, Column) else F.lit(limit)
    return F.floor(u(*keys) * bound).cast("long")
