"""Choose and hide tokens of many rows at once, as Arrow arrays.

The numbers are those of ``rand.u``. An expression that hashes inside of an array is interpreted for every
token; here the hashes of a batch are made together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.rand import SPAN

RESULT = ("tokens array<string>, masked_lm_positions array<int>, masked_lm_labels array<string>, "
          "swapped array<int>, places array<long>")


def drawer():
    """A function of (start, texts, rows, numbers): for each row number and number the draw, as 32 bits.

    The draw is that of the keys start, the row's text (which begins with the sign between keys, or is empty) and the number.
    """
    span = 8192  # messages at a time, so that the arrays stay in the processor's cache
    turns = np.array([(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)])
    constants = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
    places = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]

    def md5(words: np.ndarray) -> np.ndarray:
        """The first word of the digest of each column, a padded message of 16 words."""
        first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        a, b, c, d = (np.full(words.shape[1], x) for x in first)
        for i in range(64):
            kind = i // 16
            mixed = d ^ (b & (c ^ d)) if kind == 0 else c ^ (d & (b ^ c)) if kind == 1 else b ^ c ^ d if kind == 2 else c ^ (b | ~d)
            mixed += a
            mixed += constants[i]
            mixed += words[places[i]]
            turn = np.uint32(turns[kind][i % 4])
            turned = mixed << turn
            turned |= mixed >> (np.uint32(32) - turn)
            turned += b
            a, d, c, b = d, c, b, turned
        return a + first[0]

    def one(text: bytes) -> int:
        import hashlib

        return int.from_bytes(hashlib.md5(text).digest()[:4], "big")

    def draw(start: str, texts: list[bytes], rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.empty(0, np.uint32)
        heads = [start.encode() + t + b"|" for t in texts]
        sizes = np.array([len(h) for h in heads], np.int64)
        out = np.empty(len(rows), np.uint32)
        digits = np.ones(len(rows), np.int64)
        for k in range(1, len(str(int(numbers.max())))):
            digits += numbers >= 10**k
        # a message of more than 55 bytes has several blocks
        long = sizes[rows] + digits > 55
        for i in np.flatnonzero(long):
            out[i] = one(heads[rows[i]] + str(int(numbers[i])).encode())
        table = np.frombuffer(b"".join(h[:55].ljust(64, b"\0") for h in heads), np.uint8).reshape(-1, 64)
        short = np.flatnonzero(~long)
        for at in range(0, len(short), span):
            part = short[at:at + span]
            r, n, k = rows[part], numbers[part], digits[part]
            blocks, each, end = table[r], np.arange(len(part)), sizes[r]
            for _ in range(int(k.max())):
                left = k > 0
                blocks[each[left], end[left]] = 48 + n[left] // 10 ** (k[left] - 1) % 10
                end, k = end + left, k - left
            blocks[each, end] = 0x80
            blocks[:, 56], blocks[:, 57] = end * 8 & 255, end * 8 >> 8
            out[part] = md5(np.ascontiguousarray(blocks.view("<u4").T)).byteswap()
        return out

    return draw


def masker(seed: int, fixed: tuple[str, ...], mask: str, size: int, words: DataFrame | None, whole_word: bool):
    """A function of the columns (keyed, tokens, n) with the fields of ``RESULT``.

    ``keyed`` is the text of the row's keys, each after the sign between keys. ``words`` are the vocabulary's in their places
    and replace swapped tokens; without them these keep theirs. Of the others of 10 tokens chosen, 8 become the mask.
    """
    shared = None
    if words is not None:
        table = words.select("_place", "_word").toArrow().sort_by("_place").combine_chunks()
        column = table.column("_word")
        pool = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        shared = words.sparkSession.sparkContext.broadcast(pool)
    draw, span = drawer(), SPAN
    most_hidden, most_kept = math.ceil(0.8 * span), math.ceil(0.5 * span)

    def lists(counts: np.ndarray, values: pa.Array, absent: pa.Array) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=absent)

    def in_order(rows: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places by row and draw, of equal ones the earlier first, and for each its rank in its row."""
        order = np.argsort((rows.astype(np.uint64) << np.uint64(32)) | draws, kind="stable")
        by_row = rows[order]
        return order, np.arange(len(rows)) - np.searchsorted(by_row, by_row)

    def choose(text, flat, rows, at, n) -> np.ndarray:
        """Which of the usable tokens, given by row and position, are chosen."""
        taken = np.zeros(len(rows), bool)
        if not len(rows):
            return taken
        if not whole_word:
            order, rank = in_order(rows, draw(f"{seed}|mask", text, rows, at))
            taken[order[rank < n[rows]]] = True
            return taken
        begins = ~np.asarray(pc.fill_null(pc.starts_with(flat, "##"), True))
        begins[0] = True
        begins[1:] |= rows[1:] != rows[:-1]
        first = np.flatnonzero(begins)
        sizes = np.diff(np.append(first, len(rows)))
        order, rank = in_order(rows[first], draw(f"{seed}|mask", text, rows[first], at[first]))
        # the words of all rows are offered by rank; one that would exceed what is left is passed over
        left, word = n.copy(), np.zeros(len(first), bool)
        by_rank = order[np.argsort(rank, kind="stable")]
        for offered in np.split(by_rank, np.cumsum(np.bincount(rank))[:-1]):
            r = rows[first[offered]]
            fits = sizes[offered] <= left[r]
            word[offered] = fits
            left[r] -= np.where(fits, sizes[offered], 0)
            if not (left > 0).any():
                break
        return np.repeat(word, sizes)

    # self-contained, so that the tasks need no module of this package
    def find(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        swaps = shared is not None and size > 0
        pool = pa.array([mask], pa.string())
        if swaps:
            pool = pa.concat_arrays([pool, shared.value.cast(pa.string())])
        for keyed, tokens, n in parts:
            text = [t.encode() for t in keyed.to_pylist()]
            n = pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            absent, count = tokens.is_null(), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            flat = tokens.flatten().cast(pa.string())
            rows = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            special = pc.is_in(flat, value_set=pa.array(fixed, pa.string()))
            usable = np.flatnonzero(np.asarray(pc.and_(flat.is_valid(), pc.invert(special))))
            chosen = usable[choose(text, flat.take(pa.array(usable)), rows[usable], at[usable], n)]
            r, p = rows[chosen], at[chosen]
            hidden = draw(f"{seed}|hide", text, r, p) < most_hidden
            other = np.flatnonzero(~hidden)
            other = other[draw(f"{seed}|keep", text, r[other], p[other]) >= most_kept]
            place = np.floor(draw(f"{seed}|word", text, r[other], p[other]) / span * size).astype(np.int64)
            become = np.where(hidden, 0, -1)
            if swaps:
                become[other] = 1 + place
            new, changed = flat, np.flatnonzero(become >= 0)
            if len(changed):
                where = np.zeros(len(flat), bool)
                where[chosen[changed]] = True
                new = pc.replace_with_mask(flat, pa.array(where), pool.take(pa.array(become[changed])))
                new = pc.coalesce(new, flat) if pool.null_count else new
            chosen_of, other_of = np.bincount(r, minlength=len(count)), np.bincount(r[other], minlength=len(count))
            yield pa.StructArray.from_arrays([
                lists(count, new, absent), lists(chosen_of, pa.array(p, pa.int32()), absent), lists(chosen_of, flat.take(pa.array(chosen)), absent),
                lists(other_of, pa.array(p[other], pa.int32()), absent), lists(other_of, pa.array(place, pa.int64()), absent),
            ], names=["tokens", "masked_lm_positions", "masked_lm_labels", "swapped", "places"])

    return F.arrow_udf(find, RESULT)


def keyed(row: list[Column]) -> Column:
    """The text of a row's keys for ``masker``; like in ``rand.u`` a null key is left out."""
    return F.concat_ws("|", F.lit(""), *[c.cast("string") for c in row])
