"""Normalizing and tokenizing whole corpora."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions import chars
from cohortlab.functions.dictionaries import finder, pack, unpack
from cohortlab.functions.sizing import BROADCAST_BYTES, BROADCAST_ROWS, HOT_KEYS, broadcast_if_small, fits
from cohortlab.scratch import materialize

UNK = "[UNK]"
# Fixed value: a longer word is unknown without a search.
MAX_WORD_CHARS = 100


def clean_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, chars.clean(F.col(column)))


def space_cjk(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, chars.space_cjk(F.col(column)))


def lower_strip_accents(df: DataFrame, column: str = "text") -> DataFrame:
    lowered = df.withColumn("_lower", F.lower(column))
    return lowered.withColumn(column, chars.strip_accents(F.col("_lower"))).drop("_lower")


def split_punct(df: DataFrame, column: str = "text", name: str = "words") -> DataFrame:
    text = F.col(column)
    whole = chars.words_around_protected(text, lower=False)
    return df.withColumn(name, F.when(chars.has_protected(text), whole).otherwise(chars.plain_words(text)))


def basic_tokenize(df: DataFrame, column: str = "text", name: str = "words", lower: bool = True) -> DataFrame:
    """Text to words: clean, separate ideographs, lower-case, drop accents, split.

    The steps are columns of their own, so that no step is evaluated twice. Latin-1
    text, recognized once per row, takes cheaper expressions with the same result.
    """
    latin = F.col("_latin")
    ready = df.withColumn("_latin", chars.is_latin(F.col(column)))
    ready = ready.withColumn("_valid", F.when(latin, chars.drop_invalid_latin(F.col(column))).otherwise(
        chars.drop_invalid(F.col(column))
    ))
    if lower:
        ready = ready.withColumn("_lower", F.lower("_valid"))
        lowered = F.col("_lower")
        ready = ready.withColumn("_plain", F.when(latin, chars.strip_latin_accents(lowered)).otherwise(
            chars.strip_accents(lowered)
        ))
    else:
        ready = ready.withColumn("_plain", F.col("_valid"))
    marked = chars.words_around_protected(chars.space_cjk(F.col("_valid")), lower)
    plain = F.when(latin, chars.latin_words(F.col("_plain"))).otherwise(chars.plain_words_cjk(F.col("_plain")))
    words = F.when(chars.has_protected(F.col("_valid")), marked).otherwise(plain)
    return ready.withColumn(name, words).drop("_latin", "_valid", "_lower", "_plain")


def word_counts(df: DataFrame, words: str = "words") -> DataFrame:
    """Occurrences of each distinct word; partial counts are merged before the shuffle.

    The outer form of explode keeps the optimizer from adding a size filter, which
    would be pushed below the tokenizing steps and repeat them.
    """
    exploded = df.select(F.explode_outer(words).alias("word")).where(F.col("word").isNotNull())
    return exploded.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def corpus_vocab(counts: DataFrame, base_size: int, fraction: float = 1.0) -> DataFrame:
    """Vocabulary (token, id) of ``round(base_size * fraction)`` entries.

    Special tokens come first, then single characters, their continuation forms,
    and the most frequent longer words; ties go by token. The ids of a smaller
    fraction are a prefix of those of a larger one.
    """
    spark = counts.sparkSession
    size = round(base_size * fraction)
    # The special tokens in id order.
    specials = spark.createDataFrame(
        [(0, t, 0) for t in ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")], "kind int, token string, n long"
    ).withColumn("n", -F.monotonically_increasing_id())
    letters = counts.select(F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)))).alias("c"))
    letters = letters.distinct()
    single = letters.select(F.lit(1).alias("kind"), F.col("c").alias("token"), F.lit(0).cast("long").alias("n"))
    inner = letters.select(
        F.lit(2).alias("kind"), F.concat(F.lit("##"), "c").alias("token"), F.lit(0).cast("long").alias("n")
    )
    longer = counts.where((F.char_length("word") > 1) & (F.char_length("word") <= MAX_WORD_CHARS)).select(
        F.lit(3).alias("kind"), F.col("word").alias("token"), "n"
    )
    order = [F.col("kind"), F.col("n").desc(), F.col("token")]
    everything = specials.unionByName(single).unionByName(inner).unionByName(longer)
    # the limit keeps at most ``base_size`` rows, so the unkeyed window is small
    kept = everything.orderBy(*order).limit(size)
    return kept.select("token", (F.row_number().over(Window.orderBy(*order)) - 1).alias("id"))


#: Characters under which the vocabulary lists the lengths of its entries.
PREFIX = 3


def piece_lengths(vocab: DataFrame) -> DataFrame:
    """first, prefix and the ``lens`` of the entries that begin with the prefix; shorter entries are their own prefix.

    ``first`` marks what may begin a word; an entry with ## goes on after its sign, or begins a word as it is.
    """
    token = F.col("token")
    entries = F.array(
        F.struct(F.lit(True).alias("first"), token.alias("text")),
        F.when(token.startswith("##"), F.struct(F.lit(False).alias("first"), F.substring(token, F.lit(3), F.char_length(token)).alias("text"))))
    rows = vocab.select(F.explode(entries).alias("e")).where(F.col("e").isNotNull()).select("e.*").where("text <> ''")
    return rows.groupBy("first", F.substring("text", 1, PREFIX).alias("prefix")).agg(F.collect_set(F.char_length("text")).alias("lens"))


def candidate_spans(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, start and len of the parts that some entry's prefix and length allow."""
    word, size = F.col("word"), F.char_length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    keys = F.transform(F.sequence(F.lit(1), F.least(F.lit(PREFIX), size - F.col("start") + 1)), lambda n: F.substring(word, F.col("start"), n))
    asked = starts.select("word", "start", (F.col("start") == 1).alias("first"), F.explode(keys).alias("prefix"))
    known = asked.join(broadcast_if_small(materialize(piece_lengths(vocab), "prefixes")), ["first", "prefix"])
    lens = F.filter("lens", lambda n: F.col("start") + n - 1 <= size)
    return known.select("word", "start", F.explode(lens).alias("len"))


def piece_finder(vocab: DataFrame, unk: str = UNK):
    """A function of a column of words: their greedy longest-match pieces. The vocabulary must be one that may be broadcast."""
    tokens = frozenset(t for t in vocab.select("token").toArrow().column(0).to_pylist() if t is not None)
    shared, most = vocab.sparkSession.sparkContext.broadcast(tokens), MAX_WORD_CHARS

    # self-contained, so that the tasks need no module of this package
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        longest = max(map(len, known), default=0)

        def pieces(word: str | None) -> list[str]:
            if word is None or len(word) > most:
                return [unk]
            taken, at, size = [], 0, len(word)
            while at < size:
                for end in range(min(size, at + longest), at, -1):
                    piece = "##" + word[at:end] if at else word[at:end]
                    if piece in known:
                        break
                else:
                    return [unk]
                taken.append(piece)
                at = end
            return taken

        for words in parts:
            yield pa.array([pieces(w) for w in words.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(find, "array<string>")


def wordpiece(words: DataFrame, vocab: DataFrame, column: str = "word", unk: str = UNK) -> DataFrame:
    """Greedy longest-match pieces of each distinct word: (word, pieces).

    With a small vocabulary each word is cut where it is. With a larger one, from each start, the parts of those lengths that occur in the vocabulary under the
    next characters are matched with one equi-join, and one aggregate per word brings the matches together, where the
    longest match is taken from each start reached. Give it distinct words (as
    from ``word_counts``): the work is per row, though repeated rows do no harm.
    """
    size = F.char_length("word")
    all_words = words.select(F.col(column).alias("word"))
    if fits(vocab.select("token")):
        return all_words.distinct().withColumn("pieces", piece_finder(vocab, unk)("word"))
    spans = candidate_spans(all_words.where((size <= MAX_WORD_CHARS) & (size > 0)), vocab)
    text = F.substring(F.col("word"), F.col("start"), F.col("len"))
    spans = spans.withColumn("token", F.when(F.col("start") > 1, F.concat(F.lit("##"), text)).otherwise(text))
    matched = spans.join(broadcast_if_small(vocab.select("token")), "token", "left_semi")
    # every word once more without a match, so that words without any are kept
    nothing = F.lit(None).cast("int")
    rows = matched.select("word", "start", "len").unionByName(
        all_words.select("word", nothing.alias("start"), nothing.alias("len"))
    )
    # by start, longest first: the fold takes the first entry at the position it has reached
    entry = F.when(F.col("start").isNotNull(), F.struct("start", (-F.col("len")).alias("minus_len")))
    table = rows.groupBy("word").agg(F.array_sort(F.collect_list(entry)).alias("entries"))

    def follow(state: Column, e: Column) -> Column:
        taken = F.struct(
            (e["start"] - e["minus_len"]).alias("next"), F.concat(state["taken"], F.array(e)).alias("taken")
        )
        return F.when(e["start"] == state["next"], taken).otherwise(state)

    def piece(e: Column) -> Column:
        part = F.substring(F.col("word"), e["start"], -e["minus_len"])
        return F.when(e["start"] > 1, F.concat(F.lit("##"), part)).otherwise(part)

    def finish(state: Column) -> Column:
        return F.when(state["next"] == size + 1, F.transform(state["taken"], piece)).otherwise(F.array(F.lit(unk)))

    start = F.struct(
        F.lit(1).alias("next"), F.array().cast("array<struct<start:int,minus_len:int>>").alias("taken")
    )
    pieces = F.aggregate("entries", start, follow, finish)
    return table.select("word", F.when(size == 0, F.array().cast("array<string>")).otherwise(pieces).alias("pieces"))


def lookup(rows: DataFrame, key: str, dictionary: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Add each row's dictionary entry (null without one), whatever the sizes and the skew.

    A small dictionary is broadcast. Otherwise the entries of frequent keys are
    broadcast (at most ``HOT_KEYS`` keys can each hold that share of all
    rows) and the rest, which then has no hot key, goes through a shuffle.
    ``counts`` gives the rows per key as (key, n); it is computed when missing.
    """
    if fits(dictionary):
        return rows.join(F.broadcast(dictionary), key, "left")
    if counts is None:
        counts = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") > max(1, total // HOT_KEYS)).select(key)
    hot = dictionary.join(frequent, key, "left_semi").withColumn("_hot", F.lit(True))
    tried = rows.join(F.broadcast(hot), key, "left")
    # rows without a key have nothing to look up and must not meet in one task
    done = F.col("_hot").isNotNull() | F.col(key).isNull()
    found = tried.where(done).drop("_hot")
    rest = tried.where(~done).select(*rows.columns)
    cold = dictionary.join(frequent, key, "left_anti")
    return found.unionByName(rest.join(cold.hint("shuffle_hash"), key, "left").select(*found.columns))


def collect_in_order(position: str, value: str) -> Column:
    """Values of a group as one array, ordered by position; null values are left out."""
    pairs = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(position, value)))
    return F.transform(F.array_sort(pairs), lambda s: s[value])


def frequent_words(counts: DataFrame) -> DataFrame:
    """The words (word, n) counted most often, as many as may be broadcast with an entry of one piece for each character.

    One scan counts the words and bytes of each power of two of ``n``.
    """
    size = F.octet_length("word") + 20 * F.char_length("word") + 64
    level = F.floor(F.log2("n")).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum(size).alias("bytes"))
    least, words, total = 64, 0, 0
    for r in sizes.orderBy(F.desc("level")).collect():  # one row per power of two
        words, total = words + r["words"], total + r["bytes"]
        if words > BROADCAST_ROWS or total > BROADCAST_BYTES:
            break
        least = r["level"]
    return counts.where(level >= least)


def _by_word(df: DataFrame, keys: Sequence[str], words: str, entries: Callable[[DataFrame], DataFrame], value: str, name: str) -> DataFrame:
    """The arrays ``value`` that ``entries`` gives for each distinct word, put together for every row: (keys, name).

    The words are stored, so that texts are normalized once. Frequent words are looked up where they are;
    only the occurrences of the others are shuffled, and none of these words is hot.
    """
    packed = df.select(*keys, pack(F.col(words)).alias("packed"), F.monotonically_increasing_id().alias("_row"))
    stored = materialize(packed, "worded")
    texts = stored.withColumn("words", unpack(F.col("packed"))).drop("packed")
    exploded = texts.select(F.explode_outer("words").alias("word")).where(F.col("word").isNotNull())
    counts = materialize(exploded.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    dictionary = materialize(entries(counts).select("word", value), "dictionary")
    empty = F.array().cast(dictionary.schema[value].dataType)
    if fits(dictionary):
        find = finder(dictionary, "word", value)
        found = texts.withColumn("_found", find("words"))
        return found.select(*keys, F.coalesce(F.flatten(F.filter("_found", lambda x: x.isNotNull())), empty).alias(name))
    frequent = F.broadcast(frequent_words(counts).select("word"))
    find = finder(dictionary.join(frequent, "word", "left_semi"), "word", value)
    rare = dictionary.join(frequent, "word", "left_anti")
    tried = texts.withColumn("_found", find("words"))
    missing = F.filter(
        F.transform("words", lambda w, i: F.when(F.get("_found", i).isNull() & w.isNotNull(), F.struct(i.alias("pos"), w.alias("word")))),
        lambda x: x.isNotNull())
    asked = tried.select("_row", F.explode(missing).alias("m")).select("_row", "m.*")
    late = asked.join(rare, "word").groupBy("_row").agg(F.collect_list(F.struct("pos", value)).alias("_late"))
    # the packed words go through the shuffle, and are looked up behind it
    both = stored.join(late, "_row", "left").withColumn("words", unpack(F.col("packed"))).drop("packed")
    both = both.withColumn("_found", find("words"))
    placed = F.filter(F.transform("_found", lambda x, i: F.struct(i.alias("pos"), x.alias(value))), lambda x: x[value].isNotNull())
    ordered = F.when(F.col("_late").isNull(), placed).otherwise(F.array_sort(F.concat(placed, "_late")))
    return both.select(*keys, F.coalesce(F.flatten(F.transform(ordered, lambda x: x[value])), empty).alias(name))


def tokenize_words(df: DataFrame, keys: Sequence[str], vocab: DataFrame, words: str = "words",
                   unk: str = UNK) -> DataFrame:
    """Replace the word array of each row by its pieces: (keys, tokens).

    Pieces are found once per distinct word, then looked up for all occurrences.
    """
    return _by_word(df, keys, words, lambda counts: wordpiece(counts, vocab, unk=unk), "pieces", "tokens")


def _worded(df: DataFrame, keys: Sequence[str], column: str, lower: bool, basic: bool) -> DataFrame:
    if basic:
        worded = basic_tokenize(df, column, "words", lower)
    else:
        split = F.filter(F.split(F.col(column), r"[\s\p{Z}\x{85}]+"), lambda t: t != "")
        worded = df.withColumn("words", split)
    return worded.select(*keys, "words")


def tokenize(df: DataFrame, keys: Sequence[str], vocab: DataFrame, column: str = "text", lower: bool = True,
             basic: bool = True) -> DataFrame:
    """Text to pieces; without ``basic`` the words are only split at spaces."""
    return tokenize_words(_worded(df, keys, column, lower, basic), keys, vocab)


def text_to_ids(df: DataFrame, keys: Sequence[str], vocab: DataFrame, column: str = "text", lower: bool = True,
                basic: bool = True, unk: str = UNK) -> DataFrame:
    """Text to ids of pieces: (keys, ids). Pieces become ids once per distinct word, so rows are taken apart once."""

    def entries(counts: DataFrame) -> DataFrame:
        return tokens_to_ids(wordpiece(counts, vocab, unk=unk), ["word"], vocab, "pieces", "_ids", unk=unk)

    return _by_word(_worded(df, keys, column, lower, basic), keys, "words", entries, "_ids", "ids")


def tokens_to_ids(df: DataFrame, keys: Sequence[str], vocab: DataFrame, tokens: str = "tokens", name: str = "ids",
                  max_len: int | None = None, unk: str = UNK) -> DataFrame:
    """Ids of each row's tokens: (keys, ids, too_long); a token that is null or outside the vocabulary is unknown."""
    ids = in_place_ids(df, vocab, tokens, name, unk)
    if ids is None:
        ids = _shuffled_ids(df, keys, vocab, tokens, name, unk)
    limit = F.lit(max_len if max_len is not None else 10**9)
    return ids.select(*keys, name).withColumn("too_long", F.size(name) > limit)


def in_place_ids(df: DataFrame, vocab: DataFrame, tokens: str, name: str, unk: str = UNK) -> DataFrame | None:
    """``df`` with the ids of its tokens, without a shuffle; none when the vocabulary is too large for that."""
    if not fits(vocab.select("token", "id")):
        return None
    find = finder(vocab, "token", "id")
    unknown = vocab.where(F.col("token") == unk).select("id").first()  # one row
    unknown = F.lit(unknown[0] if unknown else None).cast(vocab.schema["id"].dataType)
    found = df.withColumn(name, find(tokens))
    known = F.filter(F.transform(name, lambda i: F.coalesce(i, unknown)), lambda i: i.isNotNull())
    return found.withColumn(name, F.coalesce(known, F.array().cast(found.schema[name].dataType)))


def _shuffled_ids(df: DataFrame, keys: Sequence[str], vocab: DataFrame, tokens: str, name: str, unk: str) -> DataFrame:
    unknown = vocab.where(F.col("token") == unk).select("id").scalar()
    exploded = df.select(*keys, F.posexplode_outer(tokens).alias("_pos", "token"))
    found = lookup(exploded, "token", vocab.select("token", "id")).withColumn(
        "id", F.when(F.col("_pos").isNotNull(), F.coalesce("id", unknown))
    )
    return found.groupBy(*keys).agg(collect_in_order("_pos", "id").alias(name))


def ids_to_tokens(df: DataFrame, keys: Sequence[str], vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """Tokens of each row's ids and their text: (keys, tokens, decoded); an unknown id fails the job."""
    if fits(vocab.select("token", "id")):
        found = df.withColumn("_tokens", finder(vocab, "id", "token")(ids))
        absent = F.filter(F.zip_with(ids, "_tokens", lambda i, t: F.when(t.isNull(), i)), lambda i: i.isNotNull())
        wrong = F.raise_error(F.concat(F.lit("no token has id "), F.get("_absent", F.lit(0)).cast("string"))).cast("array<string>")
        tokens = F.when(F.size("_absent") > 0, wrong).otherwise(F.filter("_tokens", lambda t: t.isNotNull()))
        found = found.withColumn("_absent", absent)
        out = found.select(*keys, F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
        return out.withColumn("decoded", F.array_join("tokens", " "))
    exploded = df.select(*keys, F.posexplode_outer(ids).alias("_pos", "id"))
    joined = lookup(exploded, "id", vocab.select("token", "id"))
    missing = F.raise_error(F.concat(F.lit("no token has id "), F.col("id").cast("string"))).cast("string")
    checked = joined.withColumn(
        "token", F.when(F.col("token").isNotNull() | F.col("id").isNull(), F.col("token")).otherwise(missing)
    )
    out = checked.groupBy(*keys).agg(collect_in_order("_pos", "token").alias("tokens"))
    return out.withColumn("decoded", F.array_join("tokens", " "))


def split_pair(df: DataFrame, column: str = "text") -> DataFrame:
    """Split marked text into ``text_a`` and ``text_b``; unmarked text is a single sequence."""
    text = F.col(column)
    after_cls = F.substring(text, F.locate("[CLS]", text) + 5, F.char_length(text))
    after_sep = F.substring(text, F.locate("[SEP]", text) + 5, F.char_length(text))
    marked = text.contains("[CLS]") & text.contains("[SEP]")
    first = chars.strip(F.substring_index(after_cls, "[SEP]", 1))
    second = chars.strip(F.substring_index(after_sep, "[SEP]", 1))
    return df.withColumn("text_a", F.when(marked, first).otherwise(text)).withColumn("text_b", F.when(marked, second))
