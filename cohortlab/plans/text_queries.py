"""Queries that normalize and tokenize whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.chars import CJK_RANGES
from cohortlab.operators import text as T
from cohortlab.plans.registry import query
from cohortlab.plans.tables import spread, table
from cohortlab.scratch import materialize

BASE_SIZE = 8000

CLEAN_SQL = r"""regexp_replace(regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{{FFFD}}\p{{Cf}}\p{{Co}}]', '', 'g'),
  '[\t\n\r\p{{Zs}}]', ' ', 'g')"""
_IDEOGRAPHS = "".join(rf"\x{{{{{a:X}}}}}-\x{{{{{b:X}}}}}" for a, b in CJK_RANGES)
CJK_SQL = rf"regexp_replace({{0}}, '([{_IDEOGRAPHS}])', ' \1 ', 'g')"
WORDS_SQL = r"regexp_extract_all({0}, '[!-/:-@\[-`{{-~\p{{P}}]|[^!-/:-@\[-`{{-~\p{{P}} \x{{2028}}\x{{2029}}]+')"


def basic_sql(column: str) -> str:
    return WORDS_SQL.format("strip_accents(lower(" + CJK_SQL.format(CLEAN_SQL.format(column)) + "))")


DOC_WORDS = f"doc_words AS MATERIALIZED (SELECT doc_id, {basic_sql('text')} AS words FROM documents)"
COUNTS = DOC_WORDS + ", counts AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM doc_words) GROUP BY word)"


def vocab_sql(counts: str, size: int | str, name: str = "vocab") -> str:
    """Vocabulary of a counts table, as in corpus_vocab."""
    return f"""
{name}_letters AS (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM {counts}),
{name}_all AS (
  SELECT 0 AS kind, t AS token, -i AS n FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3), ('[MASK]', 4)) s(t, i)
  UNION ALL SELECT 1, c, 0 FROM {name}_letters
  UNION ALL SELECT 2, '##' || c, 0 FROM {name}_letters
  UNION ALL SELECT 3, word, n FROM {counts} WHERE length(word) BETWEEN 2 AND 100),
{name} AS MATERIALIZED (
  SELECT token, (r - 1)::INTEGER AS id FROM (
    SELECT token, row_number() OVER (ORDER BY kind, n DESC, token) AS r FROM {name}_all) WHERE r <= {size})"""


def pieces_sql(words: str, vocab: str, name: str = "pieces") -> str:
    """Greedy pieces of the distinct words of a table, by recursion over the starts."""
    return f"""
{name}_w AS (SELECT DISTINCT word FROM {words}),
{name}_best AS MATERIALIZED (
  SELECT word, s AS start, max(l) AS len FROM (
    SELECT word, s, unnest(range(1, length(word) - s + 2)) AS l FROM (
      SELECT word, unnest(range(1, length(word) + 1)) AS s FROM {name}_w WHERE length(word) <= 100)) x
  JOIN {vocab} v ON v.token = CASE WHEN s > 1 THEN '##' ELSE '' END || substr(word, s, l)
  GROUP BY word, s),
{name}_walk(word, start, out) AS (
  SELECT word, 1::BIGINT, []::VARCHAR[] FROM {name}_w
  UNION ALL
  SELECT w.word, w.start + b.len, list_append(w.out, CASE WHEN b.start > 1 THEN '##' ELSE '' END || substr(w.word, b.start, b.len))
  FROM {name}_walk w JOIN {name}_best b ON b.word = w.word AND b.start = w.start),
{name} AS (
  SELECT w.word, coalesce(any_value(k.out), ['[UNK]']) AS pieces
  FROM {name}_w w LEFT JOIN {name}_walk k ON k.word = w.word AND k.start = length(w.word) + 1 GROUP BY w.word)"""


VOCAB = COUNTS + ", " + vocab_sql("counts", BASE_SIZE)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def document_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return T.basic_tokenize(docs).select("doc_id", "words")


def document_vocab(spark: SparkSession, sf: str, fraction: float = 1.0) -> DataFrame:
    counts = materialize(T.word_counts(document_words(spark, sf)), "counts")
    return materialize(T.corpus_vocab(counts, BASE_SIZE, fraction), "vocab")


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn with the next turn of its conversation (null after the last)."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return turns.join(following, ["conv_id", "turn"], "left")


PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, a.text, b.text AS next_text
  FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


@query(f"SELECT doc_id, {CLEAN_SQL.format('text')} AS text FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return T.clean_text(documents(spark, sf))


@query(f"""
SELECT doc_id, {CJK_SQL.format("replace(replace(text, 'é', chr(20013)), 'ö', chr(131072))")} AS text FROM documents""")
def space_cjk(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus has no ideographs, so two of its letters are mapped to some first."""
    docs = documents(spark, sf).withColumn("text", F.translate("text", "éö", "中\U00020000"))
    return T.space_cjk(docs)


@query("SELECT doc_id, strip_accents(lower(text)) AS text FROM documents")
def lower_strip_accents(spark: SparkSession, sf: str) -> DataFrame:
    return T.lower_strip_accents(documents(spark, sf))


@query(f"""
SELECT page_id, len(w) AS n_words, array_to_string(w, ' ') AS words
FROM (SELECT page_id, {WORDS_SQL.format(CLEAN_SQL.format('html'))} AS w FROM pages)""")
def split_punct(spark: SparkSession, sf: str) -> DataFrame:
    pages = T.clean_text(spread(table(spark, sf, "pages").select("page_id", "html")), "html")
    out = T.split_punct(pages, "html")
    return out.select("page_id", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


@query(f"WITH {DOC_WORDS} SELECT doc_id, len(words) AS n_words, array_to_string(words, ' ') AS words FROM doc_words")
def basic_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    out = document_words(spark, sf)
    return out.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


@query(f"""
WITH {PAIRS}
SELECT conv_id, turn, array_to_string(
  ['[CLS]'] || {basic_sql('text')} || ['[SEP]'] || CASE WHEN next_text IS NULL THEN [] ELSE {basic_sql('next_text')} || ['[SEP]'] END,
  ' ') AS words
FROM pairs""")
def basic_tokenize_marked(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with protected markers between the turns."""
    marked = F.concat_ws(
        "", F.lit("[CLS] "), "text", F.lit(" [SEP]"), F.concat(F.lit(" "), "next_text", F.lit(" [SEP]"))
    )
    pairs = turn_pairs(spark, sf).select("conv_id", "turn", marked.alias("text"))
    return T.basic_tokenize(pairs).select("conv_id", "turn", F.array_join("words", " ").alias("words"))


@query(f"WITH {VOCAB} SELECT token, id FROM vocab")
def corpus_vocab(spark: SparkSession, sf: str) -> DataFrame:
    counts = materialize(T.word_counts(document_words(spark, sf)), "counts")
    return T.corpus_vocab(counts, BASE_SIZE)


@query(f"""
WITH {VOCAB}
SELECT f AS fraction, count(*) AS n, max(id) AS last_id, min(token) AS first_token
FROM vocab, (VALUES (100), (75), (50), (25)) s(f) WHERE id < {BASE_SIZE} * f / 100 GROUP BY f""")
def corpus_vocab_fractions(spark: SparkSession, sf: str) -> DataFrame:
    counts = materialize(T.word_counts(document_words(spark, sf)), "counts")
    out = None
    for percent in (100, 75, 50, 25):
        part = T.corpus_vocab(counts, BASE_SIZE, percent / 100).agg(
            F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"), F.min("token").alias("first_token")
        ).select(F.lit(percent).alias("fraction"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""
WITH RECURSIVE {VOCAB}, {pieces_sql('counts', 'vocab')}
SELECT word, array_to_string(pieces, ' ') AS pieces FROM pieces""")
def wordpiece(spark: SparkSession, sf: str) -> DataFrame:
    counts = materialize(T.word_counts(document_words(spark, sf)), "counts")
    vocab = materialize(T.corpus_vocab(counts, BASE_SIZE), "vocab")
    return T.wordpiece(counts, vocab).select("word", F.array_join("pieces", " ").alias("pieces"))


DOC_TOKENS = VOCAB + ", " + pieces_sql("counts", "vocab") + """,
doc_tokens AS (
  SELECT doc_id, flatten(list(pieces ORDER BY pos)) AS tokens
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM doc_words) x
  JOIN pieces USING (word) GROUP BY doc_id)"""


@query(f"WITH RECURSIVE {DOC_TOKENS} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM doc_tokens")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    tokens = T.tokenize(docs, ["doc_id"], document_vocab(spark, sf))
    return tokens.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"""
WITH {VOCAB}, x AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM doc_words)
SELECT doc_id, string_agg(coalesce(id, 1)::VARCHAR, ' ' ORDER BY pos) AS ids, count(*) > 512 AS too_long
FROM x LEFT JOIN vocab ON vocab.token = x.word GROUP BY doc_id""")
def tokens_to_ids(spark: SparkSession, sf: str) -> DataFrame:
    words = document_words(spark, sf)
    out = T.tokens_to_ids(words, ["doc_id"], document_vocab(spark, sf), "words", max_len=512)
    return out.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), "too_long")


@query(f"""
WITH {VOCAB}, x AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM doc_words)
SELECT doc_id, string_agg(coalesce(token, '[UNK]'), ' ' ORDER BY pos) AS decoded
FROM x LEFT JOIN vocab ON vocab.token = x.word GROUP BY doc_id""")
def ids_to_tokens(spark: SparkSession, sf: str) -> DataFrame:
    vocab = document_vocab(spark, sf)
    ids = T.tokens_to_ids(document_words(spark, sf), ["doc_id"], vocab, "words")
    return T.ids_to_tokens(ids, ["doc_id"], vocab).select("doc_id", "decoded")


@query(f"""
WITH {PAIRS}
SELECT conv_id, turn, CASE WHEN next_text IS NULL THEN text ELSE trim(text, chr(10) || ' ') END AS text_a,
       trim(next_text, chr(10) || ' ') AS text_b
FROM pairs""")
def split_pair(spark: SparkSession, sf: str) -> DataFrame:
    pairs = turn_pairs(spark, sf)
    marked = F.concat(F.lit("[CLS] "), "text", F.lit(" [SEP] "), "next_text", F.lit(" [SEP]"))
    return T.split_pair(pairs.withColumn("text", F.coalesce(marked, "text"))).select("conv_id", "turn", "text_a", "text_b")
