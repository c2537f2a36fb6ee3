"""Truncation, padding and assembly of token arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlab.functions.rand import Key, chance, stem


def pair_lengths(a: Column, b: Column, limit: int) -> tuple[Column, Column]:
    """Lengths left when the longer side loses its last token (the second on a tie) until both fit.

    The loop has a closed form: a side shorter than its half stays whole and the
    other takes the rest; otherwise the first side gets the larger half.
    """
    high, low = (limit + 1) // 2, limit // 2
    left_a = F.when(a + b <= limit, a).when(b < low, limit - b).when(a < high, a).otherwise(high)
    left_b = F.when(a + b <= limit, b).when(b < low, b).when(a < high, limit - a).otherwise(low)
    return left_a.cast("int"), left_b.cast("int")


def head(array: Column, n: Column | int) -> Column:
    return F.slice(array, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def truncate_pair(a: Column, b: Column, limit: int) -> tuple[Column, Column]:
    left_a, left_b = pair_lengths(F.size(a), F.size(b), limit)
    return head(a, left_a), head(b, left_b)


def truncate_random(array: Column, left: Column, *keys: Key) -> Column:
    """Drop tokens down to ``left``, each one from the front or the back with equal chance."""
    dropped = F.size(array) - left
    steps = F.when(dropped > 0, F.sequence(F.lit(1), dropped)).otherwise(F.array().cast("array<int>"))
    fronts = let(stem(*keys), lambda s: F.size(F.filter(steps, lambda i: chance(0.5, s, i))))
    return F.when(dropped > 0, F.slice(array, fronts + 1, left)).otherwise(array)


def repeat(value: Column | int, n: Column) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.array_repeat(value, n.cast("int"))


def pad(array: Column, value: int, length: int, left: bool = False) -> Column:
    filler = repeat(value, F.lit(length) - F.size(array))
    return F.concat(filler, array) if left else F.concat(array, filler)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use ``value`` several times, also inside lambdas, while it is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)
