"""Byte-level BPE as a finite-state transducer that is determinised while it reads.

A state is the last token. The bytes ahead, never more than the longest token
has, lead down a tree of all tokens; where they leave it, the transition emits
the longest token on the way that can stand after the last one, which is so if
merging the bytes of both gives both again. A text has only one row of tokens in which
every two neighbours can stand together, and these are the tokens that merging
gives; where a row cannot go on, the last token is taken back for a
shorter one. Transitions are made when they are first met and are then table look-ups;
tables and the cache of whole pieces are emptied when full, which changes no
result.

Defined cases: a null text counts as empty and has no ids; repeated rows and
ids are encoded one by one; an empty table gives no rows. Special tokens are
ordinary text. Only the named columns are read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import buffers

#: Entries of the piece cache of one worker; the table of transitions holds four times as many.
MAX_CACHED = 200_000
#: Characters from which the pieces of a text are not listed before they are encoded.
LONG = 1 << 22


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ranks file: base64 token, blank, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes pieces of bytes; the ids are those of merging the lowest ranks first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # a tree of all tokens: node << 8 | byte leads to a node
        self._child: dict[int, int] = {}
        self._token, self._above = [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                below = self._child.get(node << 8 | byte)
                if below is None:
                    below = self._child[node << 8 | byte] = len(self._token)
                    self._token.append(-1)
                    self._above.append(node)
                node = below
            self._token[node] = rank
        self._follows: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        #: the transitions met so far: state << 32 | node gives a token, its length and the node above its own
        self._steps: dict[int, tuple[int, int, int]] = {}

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """The definition: join the neighbours with the lowest rank, below the given one, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if self.ranks.get(parts[best] + parts[best + 1], 1 << 60) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._halves:
            data = self.tokens[token]
            below = self.merge(data, token)
            self._halves[token] = (below[0], below[1]) if len(below) == 2 else None
        return self._halves[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether merging the bytes of both tokens gives the two tokens again.

        Merges inside each token happen in the order of their ranks, so the
        tokens that touch at the border are taken apart, later merge first; a
        merge across the border must come before both of them to prevent them.
        """
        known = self._follows.get(before << 32 | token)
        if known is None:
            if len(self._follows) > 4 * MAX_CACHED:
                self._follows.clear()
            known = self._follows[before << 32 | token] = self._touch(before, token)
        return known

    def _touch(self, left: int, right: int) -> bool:
        if left < 0:
            return self.merge(self.tokens[right]) == [right]
        made_left = made_right = 1 << 60  # the rank at which the part at the border goes into a larger one
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            # the left part's own merge comes first on equal ranks, the right part's does not
            if across is not None and across < made_left and across <= made_right:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                made_left, left = left, a[1]
            else:
                made_right, right = right, b[0]

    def _make(self, last: int, node: int) -> tuple[int, int, int]:
        """The longest token on the way to ``node`` that can follow ``last``; length 0 if there is none."""
        key, step = last << 32 | node, (-1, 0, 0)
        while node:
            token = self._token[node]
            if token >= 0 and self.follows(last, token):
                step = (token, len(self.tokens[token]), self._above[node])
                break
            node = self._above[node]
        if len(self._steps) > 4 * MAX_CACHED:
            self._steps.clear()
        self._steps[key] = step
        return step

    def encode(self, piece: bytes) -> list[int]:
        child, known, make = self._child.get, self._steps.get, self._make
        size, at, last = len(piece), 0, -1
        out: list[int] = []
        back: list[tuple[int, int, int]] = []  # for each token: where it starts, the state before it, the node for a shorter one
        while at < size:
            node = 0
            for ahead in range(at, size):
                below = child(node << 8 | piece[ahead])
                if below is None:
                    break
                node = below
            token, length, above = known(last << 32 | node) or make(last, node)
            while not length:  # a dead end: a shorter token before it
                out.pop()
                at, last, node = back.pop()
                token, length, above = known(last << 32 | node) or make(last, node)
            out.append(token)
            back.append((at, last, above))
            at += length
            last = token
        return out


class Codec:
    """Encodes texts piece by piece and decodes ids as a stream."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.machine = Transducer(ranks)
        self.pieces = regex.compile(pattern)
        self._cache: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.machine.ranks.get(data)
        ids = [whole] if whole is not None else self.machine.encode(data)
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self._cache) >= MAX_CACHED:
                self._cache.clear()
            self._cache[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        known, make = self._cache.get, self._piece
        # a very long text is cut one piece at a time, others at once
        pieces = self.pieces.findall(text) if len(text) < LONG else (m.group() for m in self.pieces.finditer(text))
        return np.frombuffer(b"".join([known(piece) or make(piece) for piece in pieces]), "<u4")

    def decode_stream(self, ids: Iterable[int], every: int = 4096) -> Iterator[str]:
        """Text as soon as its characters are whole; bytes that are no UTF-8 become U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        tokens, ids = self.machine.tokens, iter(ids)
        while part := [tokens[i] for i in itertools.islice(ids, every)]:
            yield decoder.decode(b"".join(part))
        yield decoder.decode(b"", final=True)


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, digest: bool = False) -> DataFrame:
    """doc_id with ``ids`` and the decoded ``text``, or with their digests."""
    shared = documents.sparkSession.sparkContext.broadcast((ranks, pattern))
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tasks of one worker process share the tables they have made
        codec = buffers.kept(name, lambda: Codec(*shared.value))
        for batch in batches:
            # a few rows at a time, or else a batch of long texts would stand in memory three times
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[], [], []]
                for text in part.column("text").to_pylist():
                    ids = codec.encode(text or "")
                    if digest:
                        sums = hashlib.sha256()
                        for piece in codec.decode_stream(ids.tolist()):
                            sums.update(piece.encode())
                        rows[0].append(len(ids))
                        rows[1].append(hashlib.sha256(ids.tobytes()).hexdigest())
                        rows[2].append(sums.hexdigest())
                    else:
                        rows[0].append(len(ids))
                        rows[1].append(ids.astype(np.int32))
                        rows[2].append("".join(codec.decode_stream(ids.tolist())))
                kinds = [pa.int64(), pa.string() if digest else pa.list_(pa.int32()), pa.string()]
                arrays = [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names)

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "text"])]
    kinds = "string, decoded_sha256 string" if digest else "array<int>, text string"
    schema = f"doc_id long, n_tokens long, {names[2]} {kinds}"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(documents, ranks, public_tokenizers.PATTERN, digest=True)
