"""Queries that build fixed-length features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import encode as E
from cohortlab.operators import text as T
from cohortlab.operators.groups import Recipe
from cohortlab.plans.registry import query
from cohortlab.plans.tables import labelled, spread, table, u_sql
from cohortlab.plans.text_queries import DOC_TOKENS, PAIRS, VOCAB, basic_sql, document_vocab, documents, turn_pairs


def joined(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(c.cast("array<string>"), " ")


def pair_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each turn and of the next turn; a last turn has an empty second side."""
    pairs = turn_pairs(spark, sf).withColumn("next_text", F.coalesce("next_text", F.lit("")))
    both = T.basic_tokenize(T.basic_tokenize(pairs, "text", "a"), "next_text", "b")
    return both.select("conv_id", "turn", "a", "b")


PAIR_WORDS = PAIRS + f""",
pair_words AS (SELECT conv_id, turn, {basic_sql('text')} AS a, {basic_sql("coalesce(next_text, '')")} AS b FROM pairs)"""

# one token at a time, as the definition says
LOOP = """
cut(conv_id, turn, la, lb) AS (
  SELECT conv_id, turn, len(a)::BIGINT, len(b)::BIGINT FROM pair_words
  UNION ALL
  SELECT conv_id, turn, CASE WHEN la > lb THEN la - 1 ELSE la END, CASE WHEN la > lb THEN lb ELSE lb - 1 END
  FROM cut WHERE la + lb > 40),
lens AS (SELECT conv_id, turn, min(la) AS la, min(lb) AS lb FROM cut GROUP BY ALL)"""


@query(f"""
WITH RECURSIVE {PAIR_WORDS}, {LOOP}
SELECT conv_id, turn, array_to_string(a[1:la], ' ') AS a, array_to_string(b[1:lb], ' ') AS b
FROM pair_words JOIN lens USING (conv_id, turn)""")
def truncate_pair(spark: SparkSession, sf: str) -> DataFrame:
    out = E.truncate_pair(pair_words(spark, sf), 40)
    return out.select("conv_id", "turn", joined("a").alias("a"), joined("b").alias("b"))


@query(f"""
WITH RECURSIVE {PAIR_WORDS}, {LOOP},
front AS (
  SELECT conv_id, turn, side, count(*) FILTER (CASE WHEN side = 'a' THEN {u_sql(5, "'a'", 'conv_id', 'turn', 'i')}
                                               ELSE {u_sql(5, "'b'", 'conv_id', 'turn', 'i')} END < 0.5) AS f
  FROM (SELECT conv_id, turn, 'a' AS side, unnest(range(1, len(a) - la + 1)) AS i FROM pair_words JOIN lens USING (conv_id, turn)
        UNION ALL
        SELECT conv_id, turn, 'b', unnest(range(1, len(b) - lb + 1)) FROM pair_words JOIN lens USING (conv_id, turn))
  GROUP BY ALL)
SELECT p.conv_id, p.turn, array_to_string(a[coalesce(x.f, 0) + 1:coalesce(x.f, 0) + la], ' ') AS a,
       array_to_string(b[coalesce(y.f, 0) + 1:coalesce(y.f, 0) + lb], ' ') AS b
FROM pair_words p JOIN lens l USING (conv_id, turn)
LEFT JOIN front x ON x.conv_id = p.conv_id AND x.turn = p.turn AND x.side = 'a'
LEFT JOIN front y ON y.conv_id = p.conv_id AND y.turn = p.turn AND y.side = 'b'""")
def truncate_pair_random(spark: SparkSession, sf: str) -> DataFrame:
    out = E.truncate_pair_random(pair_words(spark, sf), 40, 5, ["conv_id", "turn"])
    return out.select("conv_id", "turn", joined("a").alias("a"), joined("b").alias("b"))


@query(f"""
WITH {PAIR_WORDS} SELECT conv_id, turn, array_to_string(a[1:30], ' ') AS a FROM pair_words""")
def truncate_single(spark: SparkSession, sf: str) -> DataFrame:
    out = E.truncate_single(pair_words(spark, sf), 30)
    return out.select("conv_id", "turn", joined("a").alias("a"))


def pair_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Id arrays of the turn pairs; ids_b is null after the last turn."""
    vocab = document_vocab(spark, sf)
    pairs = turn_pairs(spark, sf)
    sides = pairs.select("conv_id", "turn", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("next_text").alias("text")),
    )).alias("s")).select("conv_id", "turn", "s.side", "s.text").where(F.col("text").isNotNull())
    keys = ["conv_id", "turn", "side"]
    ids = T.tokens_to_ids(T.basic_tokenize(sides), keys, vocab, "words")
    return ids.groupBy("conv_id", "turn").agg(
        F.first(F.when(F.col("side") == 0, F.col("ids")), ignorenulls=True).alias("ids_a"),
        F.first(F.when(F.col("side") == 1, F.col("ids")), ignorenulls=True).alias("ids_b"),
    )


def ids_sql(table_name: str, keys: str, words: str, name: str) -> str:
    return f"""
{name} AS (SELECT {keys}, list(coalesce(id, 1) ORDER BY pos) AS ids
  FROM (SELECT {keys}, unnest({words}) AS word, unnest(range(len({words}))) AS pos FROM {table_name}) x
  LEFT JOIN vocab ON token = word GROUP BY {keys})"""


PAIR_IDS = VOCAB + ", " + PAIR_WORDS + ", " + ids_sql("pair_words", "conv_id, turn", "a", "ia") + ", " + ids_sql(
    "pair_words", "conv_id, turn", "b", "ib") + """,
pair_ids AS (
  SELECT p.conv_id, p.turn, coalesce(ia.ids, []) AS ids_a, CASE WHEN q.next_text IS NULL THEN NULL ELSE coalesce(ib.ids, []) END AS ids_b
  FROM pair_words p JOIN pairs q USING (conv_id, turn) LEFT JOIN ia USING (conv_id, turn) LEFT JOIN ib USING (conv_id, turn))"""


def lens_sql(limit: int, single: int) -> str:
    """Closed-form lengths (the loop itself is checked by truncate_pair)."""
    high, low = (limit + 1) // 2, limit // 2
    return f"""
cut AS (
  SELECT conv_id, turn, coalesce(len(ids_b), 0) > 0 AS pair,
    CASE WHEN coalesce(len(ids_b), 0) = 0 THEN ids_a[1:{single}] ELSE ids_a[1:CASE WHEN len(ids_a) + len(ids_b) <= {limit} THEN len(ids_a)
      WHEN len(ids_b) < {low} THEN {limit} - len(ids_b) WHEN len(ids_a) < {high} THEN len(ids_a) ELSE {high} END] END AS a,
    CASE WHEN coalesce(len(ids_b), 0) = 0 THEN [] ELSE ids_b[1:CASE WHEN len(ids_a) + len(ids_b) <= {limit} THEN len(ids_b)
      WHEN len(ids_b) < {low} THEN len(ids_b) WHEN len(ids_a) < {high} THEN {limit} - len(ids_a) ELSE {low} END] END AS b
  FROM pair_ids)"""


def fill_sql(value: int, n: str) -> str:
    return f"[{value} FOR _i IN range({n})]"


@query(f"""
WITH {PAIR_IDS}, {lens_sql(61, 62)},
f AS (
  SELECT conv_id, turn, [2] || a || [3] || CASE WHEN len(b) > 0 THEN b || [3] ELSE [] END AS ids,
         {fill_sql(0, 'len(a) + 2')} || CASE WHEN len(b) > 0 THEN {fill_sql(1, 'len(b) + 1')} ELSE [] END AS seg FROM cut)
SELECT conv_id, turn, array_to_string(ids || {fill_sql(0, '64 - len(ids)')}, ' ') AS input_ids,
       array_to_string({fill_sql(1, 'len(ids)')} || {fill_sql(0, '64 - len(ids)')}, ' ') AS input_mask,
       array_to_string(seg || {fill_sql(0, '64 - len(ids)')}, ' ') AS segment_ids
FROM f""")
def encode(spark: SparkSession, sf: str) -> DataFrame:
    out = E.encode(pair_ids(spark, sf), 64, E.Layout(cls_id=2, sep_id=3))
    return out.select("conv_id", "turn", *[joined(c).alias(c) for c in ("input_ids", "input_mask", "segment_ids")])


@query(f"""
WITH {PAIR_IDS}, {lens_sql(60, 61)},
f AS (
  SELECT conv_id, turn, a || [3, 3] || CASE WHEN len(b) > 0 THEN b || [3] ELSE [] END || [2] AS ids,
         {fill_sql(0, 'len(a) + 2')} || CASE WHEN len(b) > 0 THEN {fill_sql(1, 'len(b) + 1')} ELSE [] END || [2] AS seg FROM cut)
SELECT conv_id, turn, array_to_string({fill_sql(9, '64 - len(ids)')} || ids, ' ') AS input_ids,
       array_to_string({fill_sql(1, '64 - len(ids)')} || {fill_sql(0, 'len(ids)')}, ' ') AS input_mask,
       array_to_string({fill_sql(4, '64 - len(ids)')} || seg, ' ') AS segment_ids
FROM f""")
def encode_other_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Class token at the end, doubled separator, padding on the left, inverted mask."""
    layout = E.Layout(cls_id=2, sep_id=3, pad_id=9, cls_at_end=True, extra_sep=True, pad_left=True, cls_segment=2,
                      pad_segment=4, real_is_one=False)
    out = E.encode(pair_ids(spark, sf), 64, layout)
    return out.select("conv_id", "turn", *[joined(c).alias(c) for c in ("input_ids", "input_mask", "segment_ids")])


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS label_id, false AS rejected
FROM documents WHERE lang <> 'es'
UNION ALL SELECT doc_id, NULL, true FROM documents WHERE lang = 'es'""")
def encode_label(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    good, bad = E.encode_label(docs, ["en", "fr", "de"], "classification", "lang")
    rejected = bad.select("doc_id", F.lit(None).cast("int").alias("label_id"), F.lit(True).alias("rejected"))
    return good.select("doc_id", "label_id", F.lit(False).alias("rejected")).unionByName(rejected)


@query("SELECT event_id, (props->>'k')::DOUBLE AS label_id FROM events")
def encode_label_regression(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("label"))
    good, _ = E.encode_label(scores, None, "regression")
    return good.select("event_id", "label_id")


@query(f"""
WITH RECURSIVE {DOC_TOKENS},
ids AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids
  FROM (SELECT doc_id, unnest(tokens) AS t, unnest(range(len(tokens))) AS pos FROM doc_tokens) x LEFT JOIN vocab ON token = t
  GROUP BY doc_id),
f AS (SELECT d.doc_id, l.quality AS y, l.toxic AS c, [2] || coalesce(ids, [])[1:298] || [3] AS ids
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 0 WHEN doc_id % 10 = 8 THEN 1 ELSE 2 END AS split, y, c, y * 2 + c AS g,
       array_to_string(ids || {fill_sql(0, '300 - len(ids)')}, ' ') AS input_ids,
       array_to_string({fill_sql(1, 'len(ids)')} || {fill_sql(0, '300 - len(ids)')}, ' ') AS input_mask,
       array_to_string({fill_sql(0, '300')}, ' ') AS segment_ids
FROM f""")
def encode_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents, tokenized with the corpus vocabulary, at length 300."""
    meta = labelled(spark, sf).select("doc_id", "y", "c", "split")
    df = spread(meta.join(documents(spark, sf), "doc_id"))
    recipe = Recipe("y", ("c",), max_length=300)
    out = E.encode_dataset(df, "doc_id", recipe, document_vocab(spark, sf))
    arrays = ("input_ids", "input_mask", "segment_ids")
    return out.select("doc_id", "split", "y", "c", "g", *[joined(c).alias(c) for c in arrays])
