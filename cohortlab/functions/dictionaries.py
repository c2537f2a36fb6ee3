"""Look up arrays of words where they are: a small dictionary goes to the tasks as Arrow arrays.

The arrays are neither taken apart nor grouped again, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def finder(dictionary: DataFrame, key: str, value: str):
    """A function of an array column: the values of its keys in their places, null where there is none.

    The dictionary must be one that may be broadcast; of a repeated key one entry counts.
    """
    spark = dictionary.sparkSession
    table = dictionary.select(key, value).toArrow().combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]
    shared = spark.sparkContext.broadcast(columns)
    kind = ArrayType(dictionary.schema[value].dataType)

    # self-contained, so that the tasks need no module of this package
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, values = shared.value
        for rows in parts:
            lengths = pc.list_value_length(rows)
            ends = pc.cumulative_sum(pc.fill_null(lengths, 0).cast(pa.int32()))
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            found = values.take(pc.index_in(rows.flatten().cast(keys.type), value_set=keys))
            yield pa.ListArray.from_arrays(offsets, found, mask=lengths.is_null())

    return F.arrow_udf(find, kind)


# --- word arrays as single texts ------------------------------------------------------------------------------------

#: What stands before each word, and what stands for these two and for null inside of one.
_MARK, _ESCAPE = "\x1f", "\x1e"


def pack(words: Column) -> Column:
    """An array of texts as one text that is much smaller in a shuffle; packed arrays are concatenated as texts."""
    joined = F.array_join(words, _MARK, _ESCAPE)
    plain = (F.length(joined) - F.length(F.replace(joined, F.lit(_MARK), F.lit(""))) == F.size(words) - 1) & ~F.contains(joined, F.lit(_ESCAPE))

    def escaped(w: Column) -> Column:
        w = F.replace(F.replace(w, F.lit(_ESCAPE), F.lit(_ESCAPE + "a")), F.lit(_MARK), F.lit(_ESCAPE + "b"))
        return F.concat(F.lit(_MARK), F.coalesce(w, F.lit(_ESCAPE + "n")))

    return F.when(F.size(words) == 0, F.lit("")).when(plain, F.concat(F.lit(_MARK), joined)).otherwise(
        F.array_join(F.transform(words, escaped), ""))


def unpack(text: Column) -> Column:
    """The array that was packed."""
    parts = F.split(F.substring(text, F.lit(2), F.length(text)), _MARK, -1)

    def unescaped(w: Column) -> Column:
        w_or_null = F.when(w != _ESCAPE + "n", w)
        return F.replace(F.replace(w_or_null, F.lit(_ESCAPE + "b"), F.lit(_MARK)), F.lit(_ESCAPE + "a"), F.lit(_ESCAPE))

    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.when(F.contains(text, F.lit(_ESCAPE)), F.transform(parts, unescaped)).otherwise(parts))
