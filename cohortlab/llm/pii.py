"""Personal data by a semi-Markov conditional random field.

Fixed patterns find the base spans: e-mail addresses, IP addresses, card numbers
that pass the Luhn test, and phone numbers with a plus sign. They stay as they
are. Around digits and signs of addresses the text is cut into islands of
pieces; candidate segments of at most MAX_PIECES pieces are scored as wholes
(length, digits, separators, check sum, words before), and a dynamic program
over bounded segments chooses boundaries and types together. The weights are
fitted by gradient ascent on the likelihood of the base spans in a bounded
sample, with the leading plus sign hidden from half of the phone numbers.
Segments that touch no base span are added.

Defined cases: null and empty texts have no span; the text is used whole; rows
that repeat an id are searched one by one; without any base span in the sample
nothing is added; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_PIECES = 12
#: At most so many texts are fitted on: those with the smallest hash of their id that hold a trigger.
SAMPLE_ROWS = 600

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ signs, so that long words are read once."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits are skipped whole where no address begins at their first digit."""
    run = _DIGITS.search(text)
    while run:
        found = _IP.match(text, run.start())
        if found and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found.group().split(".")):
            yield found.span()
        run = _DIGITS.search(text, (found or run).end())


def base_spans(text: str) -> list[Span]:
    """The base spans in the order of their kinds, then of their starts."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    out += [("ip", a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# --- the random field -----------------------------------------------------------------------------------------------

_PIECE = re.compile(r"[0-9]{1,24}|[^\W\d_]{1,24}|[^\w\s]|_|[^\S\n]")
_TRIGGER = re.compile(r"[0-9]{2,}|@")
_NEAR = 48


def islands(text: str) -> Iterator[list[tuple[int, int]]]:
    """Pieces around triggers, in groups that do not overlap."""
    low = high = -1
    for m in _TRIGGER.finditer(text):
        if low >= 0 and m.start() - _NEAR > high:
            yield [p.span() for p in _PIECE.finditer(text, low, high)]
            low = -1
        low = max(0, m.start() - _NEAR) if low < 0 else low
        high = min(len(text), m.end() + _NEAR)
    if low >= 0:
        yield [p.span() for p in _PIECE.finditer(text, low, high)]


def segment_features(text: str, start: int, end: int, hide: bool = False) -> list[str]:
    """Features of the whole segment; ``hide`` leaves a leading plus sign out."""
    s = text[start:end]
    if hide and s.startswith("+"):
        s = s[1:]
    d = _digits(s)
    n = len(d)
    letters = sum(map(str.isalpha, s))
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", s))
    out = [
        "one", f"digits{min(n, 20)}", f"letters{min(letters, 3)}", f"shape {shape[:24]}",
        f"edge {s[:1].isdigit()}{s[-1:].isdigit()}", f"around {before.isalnum()}{after.isalnum()}",
        f"at{s.count('@')}", f"dots{min(s.count('.'), 4)}", f"plus{s.startswith('+')}", f"brackets{min(s.count('('), 2)}{min(s.count(')'), 2)}",
    ]
    if 13 <= n <= 19 and not letters:
        out.append(f"luhn{luhn(d)}")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        out.append("octets")
    return out


def candidates(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last) pieces of segments that could be an entity: no line break, some digits or an @, no blank at an edge.

    Neither edge may lie inside a word or number, or else parts of keys and hashes would be taken for numbers.
    """
    out = []
    for i in range(len(pieces)):
        a = pieces[i][0]
        if text[a].isspace() or (a and text[a - 1].isalnum() and text[a].isalnum()):
            continue
        for j in range(i, min(i + MAX_PIECES, len(pieces))):
            if j > i and pieces[j][0] != pieces[j - 1][1]:
                break
            b = pieces[j][1]
            s = text[a:b]
            if s[-1].isalnum() and text[b : b + 1].isalnum():
                continue
            if not s[-1].isspace() and ("@" in s[1:-1] or sum(map(str.isdigit, s)) >= 7 or s.count(".") == 3) and len(s) > 6:
                out.append((i, j))
    return out


@dataclass
class Model:
    number: dict[str, int]
    weight: np.ndarray  # features x kinds

    def scores(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), len(KINDS)))
        for row, names in zip(out, features, strict=True):
            for name in names:
                at = self.number.get(name)
                row += self.weight[at] if at is not None else 0.0
        return out


def best_segments(size: int, segments: list[tuple[int, int]], score: np.ndarray) -> list[tuple[int, int]]:
    """(segment, kind) of the best labelling; a piece outside any segment scores 0."""
    best, back = np.zeros(size + 1), [(-1, 0)] * (size + 1)
    ending: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(segments):
        ending.setdefault(j + 1, []).append(k)
    for at in range(1, size + 1):
        best[at] = best[at - 1]
        for k in ending.get(at, ()):
            kind = int(score[k].argmax())
            value = best[segments[k][0]] + score[k, kind]
            if value > best[at]:
                best[at], back[at] = value, (k, kind)
    out, at = [], size
    while at > 0:
        k, kind = back[at]
        if k >= 0:
            out.append((k, kind))
            at = segments[k][0]
        else:
            at -= 1
    return out[::-1]


def marginals(size: int, segments: list[tuple[int, int]], score: np.ndarray) -> np.ndarray:
    """Probability of each segment with each kind, by sums forward and backward over bounded segments."""
    forward, backward = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    forward[0] = backward[size] = 0.0
    whole = np.logaddexp.reduce(score, axis=1) if len(segments) else np.zeros(0)
    ending: dict[int, list[int]] = {}
    begin: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(segments):
        ending.setdefault(j + 1, []).append(k)
        begin.setdefault(i, []).append(k)
    for at in range(1, size + 1):
        forward[at] = np.logaddexp.reduce([forward[at - 1], *[forward[segments[k][0]] + whole[k] for k in ending.get(at, ())]])
    for at in range(size - 1, -1, -1):
        backward[at] = np.logaddexp.reduce([backward[at + 1], *[backward[segments[k][1] + 1] + whole[k] for k in begin.get(at, ())]])
    outer = np.array([forward[i] + backward[j + 1] for i, j in segments]) - forward[size]
    return np.exp(outer[:, None] + score)


def fit(texts: list[str], passes: int = 15, rate: float = 0.5, ridge: float = 0.02) -> Model:
    number: dict[str, int] = {}
    lattices = []
    for text in texts:
        gold = {(a, b): KINDS.index(kind) for kind, a, b in base_spans(text)}
        for pieces in islands(text):
            segments = candidates(text, pieces)
            if not segments:
                continue
            spans = [(pieces[i][0], pieces[j][1]) for i, j in segments]
            # every other phone number is learned without its plus sign
            hide = len(lattices) % 2 == 1
            features = [[number.setdefault(f, len(number)) for f in segment_features(text, a, b, hide)] for a, b in spans]
            target = np.zeros((len(segments), len(KINDS)))
            for k, span in enumerate(spans):
                if span in gold:
                    target[k, gold[span]] = 1.0
            lattices.append((len(pieces), segments, features, target))
    weight = np.zeros((len(number), len(KINDS)))
    if number:
        weight[number["one"]] = -2.0
    squares = np.full(weight.shape, 1e-6)
    rng = np.random.default_rng(11)
    for _ in range(passes if any(x[3].any() for x in lattices) else 0):
        for n in rng.permutation(len(lattices)):
            size, segments, features, target = lattices[n]
            score = np.array([weight[f].sum(axis=0) for f in features])
            rest = target - marginals(size, segments, score)
            rows = np.unique(np.concatenate([np.array(f) for f in features]))
            place = {r: i for i, r in enumerate(rows)}
            step = np.zeros((len(rows), len(KINDS)))
            for f, r in zip(features, rest, strict=True):
                step[[place[x] for x in f]] += r
            step -= ridge * weight[rows] / max(len(lattices), 1)
            squares[rows] += step * step
            weight[rows] += rate * step / np.sqrt(squares[rows])
    if not any(x[3].any() for x in lattices):
        return Model({}, weight)
    return Model(number, weight)


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Segments that the field chooses and that touch no base span."""
    if not model.number:
        return []
    taken = sorted((a, b) for _, a, b in base)
    out: list[Span] = []
    for pieces in islands(text):
        # candidates next to base spans are dropped before they are scored
        segments = []
        at = 0
        for i, j in candidates(text, pieces):
            a, b = pieces[i][0], pieces[j][1]
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if not any(x < b and a < y for x, y in taken[at : at + 8]):
                segments.append((i, j))
        if not segments:
            continue
        spans = [(pieces[i][0], pieces[j][1]) for i, j in segments]
        score = model.scores([segment_features(text, a, b) for a, b in spans])
        if (score > 0).any():
            out += [(KINDS[kind], *spans[k]) for k, kind in best_segments(len(pieces), segments, score)]
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


# --- on Spark -------------------------------------------------------------------------------------------------------


def train(documents: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    held = documents.where(F.col("text").rlike(r"[0-9]{5,}|@|[0-9]\.[0-9]|\+[0-9]") & F.col("doc_id").isNotNull())
    last = held.select(F.xxhash64("doc_id").alias("o")).orderBy("o").limit(rows).agg(F.max("o")).first()[0]
    texts = held.where(F.xxhash64("doc_id") <= F.lit(last)).select(F.xxhash64("doc_id").alias("o"), "text")
    # only the surroundings of triggers reach the driver
    near = texts.select("o", F.array_join(F.expr(
        r"regexp_extract_all(text, '(?s).{0,48}(?:[0-9]{2,}|@).{0,48}', 0)"), "\n").alias("text"))
    return fit([r["text"] for r in near.orderBy("o", "text").collect()])


def find(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, the base spans and all spans of every row, as lists of kind:start:end."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                for i, kind in enumerate(KINDS):
                    out[i].append(sum(s[0] == kind for s in base))
                out[4].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out[5].append(listed(base + added_spans(text, base, model)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(documents, train(documents))
