"""Character classes and per-string normalization as Spark expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that are never lower-cased or split.
PROTECTED = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")

# The code point ranges that count as ideographs.
CJK_RANGES = (
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F),
    (0x2B820, 0x2CEAF),
    (0xF900, 0xFAFF),
    (0x2F800, 0x2FA1F),
)

_INVALID = r"[\x{0}\x{FFFD}]|[\p{C}&&[^\t\n\r]]"
_SPACE = r"[\t\n\r\p{Zs}]"
_CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)
# all printable ASCII that is neither a letter nor a digit, and category P
_PUNCT = r"!-/:-@\[-`{-~\p{P}"
# every separator, with the line and paragraph separators that the cleaning keeps
_BREAK = r"\t\n\r\p{Zs}\x{2028}\x{2029}"
_WORD = f"[{_PUNCT}]|[^{_PUNCT}{_BREAK}]+"
_WORD_OR_IDEOGRAPH = f"[{_PUNCT}{_CJK}]|[^{_PUNCT}{_CJK}{_BREAK}]+"
_PROTECTED = r"\[(?:UNK|SEP|PAD|CLS|MASK)\]"
# Latin-1 text stays Latin-1 in every step, and its classes are listed character by
# character, because the regex engine turns such lists into a single bit set
_LATIN = [chr(c) for c in range(0x100)]


def _listed(chars: list[str]) -> str:
    return "".join(f"\\x{ord(c):02X}" for c in chars)


_LATIN_PUNCT = _listed([c for c in _LATIN if (c.isascii() and c.isprintable() and not c.isalnum() and c != " ")
                        or unicodedata.category(c)[0] == "P"])
_LATIN_BREAK = _listed([c for c in _LATIN if c in "\t\n\r" or unicodedata.category(c) == "Zs"])
_LATIN_INVALID = _listed([c for c in _LATIN if unicodedata.category(c)[0] == "C" and c not in "\t\n\r"])
_LATIN_WORD = f"[^{_LATIN_PUNCT}{_LATIN_BREAK}]+|[{_LATIN_PUNCT}]"

_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3


@cache
def accent_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What canonical decomposition without nonspacing marks does to each character.

    Returns the characters to translate with their replacements (deletions last),
    and the few characters that become several. Hangul syllables are left out:
    they decompose by arithmetic.
    """
    source, target, deleted, several = [], [], [], []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or _HANGUL_FIRST <= code <= _HANGUL_LAST:
            continue
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if plain == char:
            continue
        if not plain:
            deleted.append(char)
        elif len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            several.append((char, plain))
    return "".join(source + deleted), "".join(target), tuple(several)


def clean(text: Column) -> Column:
    """Drop control and invalid characters; every kind of space becomes a space."""
    return F.regexp_replace(F.regexp_replace(text, _INVALID, ""), _SPACE, " ")


def space_cjk(text: Column) -> Column:
    return F.regexp_replace(text, f"([{_CJK}])", " $1 ")


def _split_hangul(text: Column) -> Column:
    """Replace each Hangul syllable by its letters (19 initials x 21 vowels x 28 finals)."""
    initials = F.lit("".join(chr(0x1100 + i) for i in range(19)))
    vowels = F.lit("".join(chr(0x1161 + i) for i in range(21)))
    finals = F.lit("".join(chr(0x11A8 + i) for i in range(27)))

    def letters(char: Column) -> Column:
        index = F.ascii(char) - F.lit(_HANGUL_FIRST)
        final = index % 28
        parts = F.concat(
            F.substring(initials, F.floor(index / 588).cast("int") + 1, F.lit(1)),
            F.substring(vowels, F.floor((index % 588) / 28).cast("int") + 1, F.lit(1)),
            F.when(final > 0, F.substring(finals, final.cast("int"), F.lit(1))).otherwise(""),
        )
        return F.when(char.between(chr(_HANGUL_FIRST), chr(_HANGUL_LAST)), parts).otherwise(char)

    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.array_join(F.transform(chars, letters), "")


def strip_accents(lowered: Column) -> Column:
    """Decompose and drop nonspacing marks.

    ASCII text is returned as it is, Latin-1 text needs one small translation, and
    only text with other characters pays for the full tables.
    """
    source, target, several = accent_tables()
    full = F.translate(lowered, source, target)
    for char, replacement in several:
        full = F.replace(full, F.lit(char), F.lit(replacement))
    hangul = f"[\\x{{{_HANGUL_FIRST:X}}}-\\x{{{_HANGUL_LAST:X}}}]"
    return (
        F.when(~lowered.rlike(r"[^\x{0}-\x{7F}]"), lowered)
        .when(is_latin(lowered), strip_latin_accents(lowered))
        .when(lowered.rlike(hangul), _split_hangul(full))
        .otherwise(full)
    )


def strip_latin_accents(lowered: Column) -> Column:
    source, target, _ = accent_tables()
    pairs = [(c, target[i]) for i, c in enumerate(source[: len(target)]) if ord(c) < 0x100]
    latin = F.translate(lowered, "".join(c for c, _ in pairs), "".join(p for _, p in pairs))
    return F.when(lowered.rlike(r"[^\x{0}-\x{7F}]"), latin).otherwise(lowered)


def is_latin(text: Column) -> Column:
    """Whether all characters are Latin-1."""
    return ~text.rlike(r"[^\x{0}-\x{FF}]")


def latin_words(text: Column) -> Column:
    """``plain_words`` for Latin-1 text."""
    return F.regexp_extract_all(text, F.lit(_LATIN_WORD), F.lit(0))


def drop_invalid_latin(text: Column) -> Column:
    return F.regexp_replace(text, f"[{_LATIN_INVALID}]", "")


def plain_words(text: Column) -> Column:
    """Words between separators, each punctuation character a word of its own."""
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def plain_words_cjk(text: Column) -> Column:
    """The same, with each ideograph a word of its own."""
    return F.regexp_extract_all(text, F.lit(_WORD_OR_IDEOGRAPH), F.lit(0))


def drop_invalid(text: Column) -> Column:
    return F.regexp_replace(text, _INVALID, "")


def has_protected(text: Column) -> Column:
    return text.rlike(_PROTECTED)


def words_around_protected(text: Column, lower: bool) -> Column:
    """Words of text that may hold protected tokens: they stay whole if they stand alone."""
    normal = (lambda c: strip_accents(F.lower(c))) if lower else (lambda c: c)
    tokens = F.filter(F.split(text, f"[{_BREAK}]+"), lambda t: t != "")
    pieces = F.transform(
        tokens, lambda t: F.when(t.isin(*PROTECTED), F.array(t)).otherwise(plain_words(normal(t)))
    )
    return F.flatten(pieces)


def strip(text: Column) -> Column:
    """Trim spaces, tabs and line ends on both sides."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
