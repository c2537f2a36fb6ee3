"""Queries that sample a corpus and build training instances.

Segments are the non-blank lines of the documents, tokens the words between
spaces; the tokenizers have queries of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.chars import strip
from cohortlab.operators import encode as E
from cohortlab.operators import instances as I
from cohortlab.operators import text as T
from cohortlab.plans.encoding_queries import PAIR_IDS, fill_sql, joined, lens_sql, pair_ids
from cohortlab.plans.registry import query
from cohortlab.plans.tables import u_sql
from cohortlab.plans.text_queries import VOCAB, document_vocab, documents
from cohortlab.scratch import materialize

SEED, EPOCHS, MAX_LEN = 11, 2, 64
MOST = MAX_LEN - 3


def line_segments(df: DataFrame) -> DataFrame:
    """Non-blank lines of each text, numbered within their document."""
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    numbered = df.select("doc_id", F.posexplode_outer(lines).alias("seg_no", "line")).where(F.col("line").isNotNull())
    return numbered.withColumn("seg_no", F.col("seg_no").cast("long"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    lines = line_segments(documents(spark, sf))
    return lines.select("doc_id", "seg_no", F.split("line", " +").alias("tokens"))


SEGS = r"""
segs AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seg_no,
         string_split_regex(trim(line, ' ' || chr(10)), ' +') AS tokens
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
  WHERE trim(line, ' ' || chr(10)) <> ''),
pos AS MATERIALIZED (
  SELECT doc_id, seg_no, len(tokens) AS n_tok,
         (sum(len(tokens)) OVER (PARTITION BY doc_id ORDER BY seg_no) - len(tokens))::BIGINT AS before FROM segs),
docs AS MATERIALIZED (
  SELECT doc_id, count(*) AS n_segs, (row_number() OVER (ORDER BY doc_id) - 1) AS idx,
         (sum(count(*)) OVER (ORDER BY doc_id) - count(*))::BIGINT AS cum_start FROM segs GROUP BY doc_id)"""


@query(f"WITH {SEGS} SELECT doc_id, n_segs, idx, cum_start FROM docs")
def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return I.doc_lengths(segments(spark, sf))


@query(f"WITH {SEGS} SELECT doc_id, seg_no, n_tok, before FROM pos")
def segment_positions(spark: SparkSession, sf: str) -> DataFrame:
    return I.segment_positions(segments(spark, sf))


@query(f"""
WITH {SEGS}, d AS (
  SELECT s.doc_id, s.seg_no, (cum_start + n_segs + floor({u_sql(SEED, 's.doc_id', 's.seg_no')} * (t - n_segs))::BIGINT) % t AS off
  FROM segs s JOIN docs USING (doc_id), (SELECT sum(n_segs)::BIGINT AS t FROM docs))
SELECT d.doc_id, d.seg_no, o.doc_id AS doc_b, o.n_segs AS n_segs_b
FROM d JOIN docs o ON d.off >= o.cum_start AND d.off < o.cum_start + o.n_segs""")
def sample_other_doc(spark: SparkSession, sf: str) -> DataFrame:
    """One weighted draw per segment."""
    segs = segments(spark, sf)
    docs = materialize(I.doc_lengths(segs), "docs")
    draws = segs.select("doc_id", "seg_no")
    return I.sample_other_doc(draws, docs, [SEED, F.col("doc_id"), F.col("seg_no")])


@query(f"""
WITH {SEGS}, d AS (
  SELECT s.doc_id, s.seg_no, (idx + 1 + floor({u_sql(SEED, 's.doc_id', 's.seg_no')} * (n - 1))::BIGINT) % n AS i
  FROM segs s JOIN docs USING (doc_id), (SELECT count(*) AS n FROM docs))
SELECT d.doc_id, d.seg_no, o.doc_id AS doc_b, o.n_segs AS n_segs_b FROM d JOIN docs o ON o.idx = d.i""")
def sample_other_doc_uniform(spark: SparkSession, sf: str) -> DataFrame:
    segs = segments(spark, sf)
    docs = materialize(I.doc_lengths(segs), "docs")
    draws = segs.select("doc_id", "seg_no")
    return I.sample_other_doc(draws, docs, [SEED, F.col("doc_id"), F.col("seg_no")], weighted=False)


TARGET = f"""
CASE WHEN {u_sql(SEED, "'short'", 'epoch', 'doc_id')} < 0.1
     THEN 2 + floor({u_sql(SEED, "'length'", 'epoch', 'doc_id')} * {MOST - 1})::BIGINT ELSE {MOST} END"""


@query(f"WITH {SEGS} SELECT epoch::INTEGER AS epoch, doc_id, {TARGET} AS target FROM docs, range({EPOCHS}) e(epoch)")
def target_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return I.target_lengths(I.doc_lengths(segments(spark, sf)), EPOCHS, MAX_LEN, 0.1, SEED)


@query(f"""
WITH RECURSIVE {SEGS},
walk(doc_id, seg_no, chunk_no, acc) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, n_tok::BIGINT FROM pos WHERE seg_no = 0
  UNION ALL
  SELECT w.doc_id, p.seg_no, CASE WHEN acc >= 80 THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN acc >= 80 THEN 0 ELSE acc END + n_tok
  FROM walk w JOIN pos p ON p.doc_id = w.doc_id AND p.seg_no = w.seg_no + 1)
SELECT doc_id, chunk_no, min(seg_no) AS first_seg, max(seg_no) AS last_seg, max(acc) AS n_tok FROM walk GROUP BY doc_id, chunk_no""")
def pack_segments(spark: SparkSession, sf: str) -> DataFrame:
    return I.pack_segments(segments(spark, sf), 80)


ROW = ("epoch", "doc_id", "seg_no")


def plan_sql(pairs: bool) -> str:
    """Chunk plan: pointer of each segment, then the chain from segment 0."""
    foreign = f"(n = 1 OR {u_sql(SEED, chr(39) + 'next' + chr(39), *ROW)} < 0.5)" if pairs else "false"
    return SEGS + f""",
tgt AS MATERIALIZED (SELECT epoch::INTEGER AS epoch, doc_id, {TARGET} AS target FROM docs, range({EPOCHS}) e(epoch)),
ends AS MATERIALIZED (
  SELECT t.epoch, s.doc_id, s.seg_no, any_value(s.before) AS before, any_value(t.target) AS target, max(j.seg_no) AS seg_end,
         max(j.seg_no) - s.seg_no + 1 AS n
  FROM pos s JOIN tgt t ON t.doc_id = s.doc_id
  JOIN pos j ON j.doc_id = s.doc_id AND (j.seg_no = s.seg_no OR (j.seg_no > s.seg_no AND j.before - s.before < t.target))
  GROUP BY t.epoch, s.doc_id, s.seg_no),
link AS MATERIALIZED (
  SELECT *, seg_no + CASE WHEN n = 1 THEN 1 ELSE 1 + floor({u_sql(SEED, "'cut'", *ROW)} * (n - 1))::BIGINT END AS a_end,
         {foreign} AS random_next FROM ends),
chain(epoch, doc_id, here) AS (
  SELECT epoch, doc_id, 0::BIGINT FROM tgt
  UNION ALL
  SELECT l.epoch, l.doc_id, CASE WHEN random_next THEN a_end ELSE seg_end + 1 END
  FROM chain c JOIN link l ON l.epoch = c.epoch AND l.doc_id = c.doc_id AND l.seg_no = c.here),
plan AS MATERIALIZED (SELECT l.* FROM chain c JOIN link l ON l.epoch = c.epoch AND l.doc_id = c.doc_id AND l.seg_no = c.here)"""


PLAN_COLUMNS = ["epoch", "doc_id", "seg_no", "a_end", "seg_end", "random_next", "before", "target"]


@query(f"WITH RECURSIVE {plan_sql(True)} SELECT {', '.join(PLAN_COLUMNS)} FROM plan")
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    positions = materialize(I.segment_positions(segments(spark, sf)), "positions")
    return I.chunk_plan(positions, SEED, EPOCHS, MAX_LEN).select(*PLAN_COLUMNS)


@query(f"WITH RECURSIVE {plan_sql(True)} SELECT {', '.join(PLAN_COLUMNS)} FROM plan")
def chunk_plan_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same chunks when documents are cut into many small blocks."""
    positions = materialize(I.segment_positions(segments(spark, sf)), "positions")
    return I.chunk_plan(positions, SEED, EPOCHS, MAX_LEN, block=128).select(*PLAN_COLUMNS)


PAIRED = plan_sql(True) + f""",
sized AS (
  SELECT p.*, p.target - (x.before + x.n_tok - p.before) AS want FROM plan p
  JOIN pos x ON x.doc_id = p.doc_id AND x.seg_no = p.a_end - 1),
off AS (
  SELECT s.*, (d.cum_start + d.n_segs + floor({u_sql(SEED, "'doc'", 's.epoch', 's.doc_id', 's.seg_no')} * (t - d.n_segs))::BIGINT) % t AS off
  FROM sized s JOIN docs d ON d.doc_id = s.doc_id, (SELECT sum(n_segs)::BIGINT AS t FROM docs) WHERE random_next),
drawn AS MATERIALIZED (
  SELECT o.epoch, o.doc_id, o.seg_no, o.want, d.doc_id AS doc_b,
         floor({u_sql(SEED, "'start'", 'o.epoch', 'o.doc_id', 'o.seg_no')} * d.n_segs)::BIGINT AS start
  FROM off o JOIN docs d ON o.off >= d.cum_start AND o.off < d.cum_start + d.n_segs),
side_a AS (
  SELECT p.epoch, p.doc_id, p.seg_no, flatten(list(s.tokens ORDER BY s.seg_no)) AS tokens_a
  FROM plan p JOIN segs s ON s.doc_id = p.doc_id AND s.seg_no >= p.seg_no AND s.seg_no < p.a_end GROUP BY ALL),
side_b AS (
  SELECT p.epoch, p.doc_id, p.seg_no, NULL::BIGINT AS doc_b, flatten(list(s.tokens ORDER BY s.seg_no)) AS tokens_b
  FROM plan p JOIN segs s ON s.doc_id = p.doc_id AND s.seg_no >= p.a_end AND s.seg_no <= p.seg_end
  WHERE NOT random_next GROUP BY ALL
  UNION ALL
  SELECT d.epoch, d.doc_id, d.seg_no, d.doc_b, flatten(list(s.tokens ORDER BY s.seg_no))
  FROM drawn d JOIN pos f ON f.doc_id = d.doc_b AND f.seg_no = d.start
  JOIN pos k ON k.doc_id = d.doc_b AND (k.seg_no = d.start OR (k.seg_no > d.start AND k.before - f.before < d.want))
  JOIN segs s ON s.doc_id = k.doc_id AND s.seg_no = k.seg_no
  GROUP BY d.epoch, d.doc_id, d.seg_no, d.doc_b),
paired AS MATERIALIZED (
  SELECT p.epoch, p.doc_id, p.seg_no, p.random_next, b.doc_b, tokens_a, coalesce(tokens_b, ['.']) AS tokens_b
  FROM plan p JOIN side_a a ON a.epoch = p.epoch AND a.doc_id = p.doc_id AND a.seg_no = p.seg_no
  LEFT JOIN side_b b ON b.epoch = p.epoch AND b.doc_id = p.doc_id AND b.seg_no = p.seg_no)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return I.make_pairs(segments(spark, sf), SEED, EPOCHS, MAX_LEN)


@query(f"""
WITH RECURSIVE {PAIRED}
SELECT epoch, doc_id, seg_no, random_next, doc_b, array_to_string(tokens_a, ' ') AS tokens_a, array_to_string(tokens_b, ' ') AS tokens_b
FROM paired""")
def make_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = pairs(spark, sf)
    return out.withColumns({c: joined(c) for c in ("tokens_a", "tokens_b")})


@query(f"""
WITH RECURSIVE {plan_sql(False)}
SELECT p.epoch, p.doc_id, p.seg_no, p.random_next,
       string_agg(array_to_string(s.tokens, ' '), ' ' ORDER BY s.seg_no) FILTER (s.seg_no < a_end) AS tokens_a,
       coalesce(string_agg(array_to_string(s.tokens, ' '), ' ' ORDER BY s.seg_no) FILTER (s.seg_no >= a_end), '.') AS tokens_b
FROM plan p JOIN segs s ON s.doc_id = p.doc_id AND s.seg_no BETWEEN p.seg_no AND p.seg_end
GROUP BY p.epoch, p.doc_id, p.seg_no, p.random_next""")
def make_pairs_one_seq(spark: SparkSession, sf: str) -> DataFrame:
    """Without foreign second sides: every chunk continues itself."""
    out = I.make_pairs(segments(spark, sf), SEED, EPOCHS, MAX_LEN, pairs=False)
    return out.drop("doc_b").withColumns({c: joined(c) for c in ("tokens_a", "tokens_b")})


def cut_sql(side: str, la: str) -> str:
    key = u_sql(SEED, "'trim'", f"'{side}'", *ROW, "i")
    return f"""
front_{side} AS (
  SELECT epoch, doc_id, seg_no, count(*) FILTER ({key} < 0.5) AS f FROM (
    SELECT epoch, doc_id, seg_no, unnest(range(1, len(tokens_{side}) - {la} + 1)) AS i FROM lens) GROUP BY ALL)"""


HIGH, LOW = (MOST + 1) // 2, MOST // 2
LAID_OUT = PAIRED + f""",
lens AS MATERIALIZED (
  SELECT *, CASE WHEN len(tokens_a) + len(tokens_b) <= {MOST} THEN len(tokens_a) WHEN len(tokens_b) < {LOW} THEN {MOST} - len(tokens_b)
    WHEN len(tokens_a) < {HIGH} THEN len(tokens_a) ELSE {HIGH} END AS la,
    CASE WHEN len(tokens_a) + len(tokens_b) <= {MOST} THEN len(tokens_b) WHEN len(tokens_b) < {LOW} THEN len(tokens_b)
    WHEN len(tokens_a) < {HIGH} THEN {MOST} - len(tokens_a) ELSE {LOW} END AS lb FROM paired),
{cut_sql('a', 'la')},
{cut_sql('b', 'lb')},
laid_out AS MATERIALIZED (
  SELECT l.epoch, l.doc_id, l.seg_no, l.random_next,
    ['[CLS]'] || tokens_a[coalesce(x.f, 0) + 1:coalesce(x.f, 0) + la] || ['[SEP]'] || tokens_b[coalesce(y.f, 0) + 1:coalesce(y.f, 0) + lb]
      || ['[SEP]'] AS tokens,
    {fill_sql(0, 'la + 2')} || {fill_sql(1, 'lb + 1')} AS segment_ids
  FROM lens l LEFT JOIN front_a x ON x.epoch = l.epoch AND x.doc_id = l.doc_id AND x.seg_no = l.seg_no
  LEFT JOIN front_b y ON y.epoch = l.epoch AND y.doc_id = l.doc_id AND y.seg_no = l.seg_no)"""
KEY = ["epoch", "doc_id", "seg_no"]


def laid_out(spark: SparkSession, sf: str) -> DataFrame:
    return I.assemble_pair(pairs(spark, sf), KEY, SEED, MAX_LEN)


@query(f"""
WITH RECURSIVE {LAID_OUT}
SELECT epoch, doc_id, seg_no, array_to_string(tokens, ' ') AS tokens, array_to_string(segment_ids, ' ') AS segment_ids FROM laid_out""")
def assemble_pair(spark: SparkSession, sf: str) -> DataFrame:
    return laid_out(spark, sf).select(*KEY, joined("tokens").alias("tokens"), joined("segment_ids").alias("segment_ids"))


def hide_sql(chosen: str, source: str) -> str:
    """Rewrite chosen positions (a table of keys and pos) and list them."""
    return f"""
randomized AS MATERIALIZED (
  SELECT *, floor({u_sql(SEED, "'word'", *ROW, 'pos')} * (SELECT count(*) FROM vocab))::INTEGER AS vid FROM tok),
hidden AS MATERIALIZED (
  SELECT t.epoch, t.doc_id, t.seg_no, t.pos, t.token AS label,
    CASE WHEN c.pos IS NULL THEN t.token WHEN {u_sql(SEED, "'hide'", 't.epoch', 't.doc_id', 't.seg_no', 't.pos')} < 0.8 THEN '[MASK]'
         WHEN {u_sql(SEED, "'keep'", 't.epoch', 't.doc_id', 't.seg_no', 't.pos')} < 0.5 THEN t.token
         ELSE v.token END AS token, c.pos IS NOT NULL AS chosen
  FROM randomized t LEFT JOIN {chosen} c ON c.epoch = t.epoch AND c.doc_id = t.doc_id AND c.seg_no = t.seg_no AND c.pos = t.pos
  JOIN vocab v ON v.id = t.vid),
masked AS (
  SELECT epoch, doc_id, seg_no, string_agg(token, ' ' ORDER BY pos) AS tokens,
    string_agg(pos::VARCHAR, ' ' ORDER BY pos) FILTER (chosen) AS masked_lm_positions,
    string_agg(label, ' ' ORDER BY pos) FILTER (chosen) AS masked_lm_labels
  FROM hidden GROUP BY epoch, doc_id, seg_no)"""


def number_sql(prob: float, most: int) -> str:
    return f"least({most}, greatest(1, round_even(len(tokens) * {prob}::DOUBLE, 0)::BIGINT))"


MASKED = LAID_OUT + ", " + VOCAB + """,
tok AS MATERIALIZED (SELECT epoch, doc_id, seg_no, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM laid_out),
num AS MATERIALIZED (SELECT epoch, doc_id, seg_no, """ + number_sql(0.15, 20) + f""" AS n FROM laid_out),
chosen AS MATERIALIZED (
  SELECT t.* FROM (
    SELECT epoch, doc_id, seg_no, pos, row_number() OVER (PARTITION BY epoch, doc_id, seg_no ORDER BY {u_sql(SEED, "'mask'", *ROW, 'pos')}, pos) AS r
    FROM tok WHERE token NOT IN ('[CLS]', '[SEP]')) t JOIN num USING (epoch, doc_id, seg_no) WHERE r <= n),
""" + hide_sql("chosen", "tok")


def instance_text(df: DataFrame) -> DataFrame:
    return df.select(*KEY, *[joined(c).alias(c) for c in ("tokens", "masked_lm_positions", "masked_lm_labels")])


@query(f"WITH RECURSIVE {MASKED} SELECT * FROM masked")
def mask_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return instance_text(I.mask_tokens(laid_out(spark, sf), KEY, document_vocab(spark, sf), SEED, 0.15))


# every word longer than four letters continues as a ## piece
PIECES = """
laid_out AS MATERIALIZED (
  SELECT epoch, doc_id, seg_no, flatten([CASE WHEN length(t) > 4 AND t NOT IN ('[CLS]', '[SEP]')
    THEN [substr(t, 1, 4), '##' || substr(t, 5)] ELSE [t] END FOR t IN tokens]) AS tokens FROM whole)"""


def in_pieces(df: DataFrame) -> DataFrame:
    def cut(t):
        halves = F.array(F.substring(t, 1, 4), F.concat(F.lit("##"), F.substring(t, F.lit(5), F.char_length(t))))
        return F.when((F.char_length(t) > 4) & ~t.isin("[CLS]", "[SEP]"), halves).otherwise(F.array(t))

    return df.withColumn("tokens", F.flatten(F.transform("tokens", cut)))


WHOLE_WORD = (
    LAID_OUT.replace("laid_out AS", "whole AS") + ", " + PIECES + ", " + VOCAB + """,
tok AS MATERIALIZED (SELECT epoch, doc_id, seg_no, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM laid_out),
num AS MATERIALIZED (SELECT epoch, doc_id, seg_no, """ + number_sql(0.15, 20) + f""" AS n FROM laid_out),
cand AS MATERIALIZED (
  SELECT *, sum(CASE WHEN token LIKE '##%' THEN 0 ELSE 1 END) OVER (PARTITION BY epoch, doc_id, seg_no ORDER BY pos) AS w
  FROM tok WHERE token NOT IN ('[CLS]', '[SEP]')),
wordy AS MATERIALIZED (SELECT epoch, doc_id, seg_no, w, min(pos) AS first, count(*) AS size FROM cand GROUP BY epoch, doc_id, seg_no, w),
ord AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY epoch, doc_id, seg_no ORDER BY {u_sql(SEED, "'mask'", *ROW, 'first')}, first) AS r
  FROM wordy),
fill(epoch, doc_id, seg_no, r, n, used, took) AS (
  SELECT epoch, doc_id, seg_no, 0::BIGINT, n, 0::BIGINT, false FROM num
  UNION ALL
  SELECT f.epoch, f.doc_id, f.seg_no, o.r, f.n, CASE WHEN f.used + o.size <= f.n THEN f.used + o.size ELSE f.used END, f.used + o.size <= f.n
  FROM fill f JOIN ord o ON o.epoch = f.epoch AND o.doc_id = f.doc_id AND o.seg_no = f.seg_no AND o.r = f.r + 1),
chosen AS MATERIALIZED (
  SELECT c.epoch, c.doc_id, c.seg_no, c.pos FROM fill f
  JOIN ord o ON o.epoch = f.epoch AND o.doc_id = f.doc_id AND o.seg_no = f.seg_no AND o.r = f.r
  JOIN cand c ON c.epoch = o.epoch AND c.doc_id = o.doc_id AND c.seg_no = o.seg_no AND c.w = o.w WHERE f.took),
""" + hide_sql("chosen", "tok"))


@query(f"WITH RECURSIVE {WHOLE_WORD} SELECT * FROM masked")
def mask_whole_words(spark: SparkSession, sf: str) -> DataFrame:
    pieces = in_pieces(laid_out(spark, sf))
    return instance_text(I.mask_tokens(pieces, KEY, document_vocab(spark, sf), SEED, 0.15, whole_word=True))


@query(f"""
WITH {PAIR_IDS}, {lens_sql(61, 62)},
f AS (SELECT conv_id, turn, [2] || a || [3] || CASE WHEN len(b) > 0 THEN b || [3] ELSE [] END AS ids FROM cut),
p AS (SELECT conv_id, turn, ids || {fill_sql(0, '64 - len(ids)')} AS ids FROM f),
x AS (SELECT conv_id, turn, unnest(ids) AS id, unnest(range(64)) AS i FROM p)
SELECT conv_id, turn,
  string_agg(CASE WHEN {u_sql(3, 'i')} < 0.15 AND id > 4 THEN 4 ELSE id END::VARCHAR, ' ' ORDER BY i) AS input_ids,
  string_agg(id::VARCHAR, ' ' ORDER BY i) AS labels
FROM x GROUP BY conv_id, turn""")
def mask_fixed_pattern(spark: SparkSession, sf: str) -> DataFrame:
    encoded = E.encode(pair_ids(spark, sf), 64, E.Layout(cls_id=2, sep_id=3))
    out = I.mask_fixed_pattern(encoded, 3, 64, 4, [0, 1, 2, 3, 4])
    return out.select("conv_id", "turn", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query(f"""
WITH RECURSIVE {MASKED},
tid AS (
  SELECT t.epoch, t.doc_id, t.seg_no, list(coalesce(v.id, 1) ORDER BY pos) AS ids,
         list(CASE WHEN chosen THEN coalesce(w.id, 1) ELSE -1 END ORDER BY pos) AS labels
  FROM hidden t LEFT JOIN vocab v ON v.token = t.token LEFT JOIN vocab w ON w.token = t.label GROUP BY t.epoch, t.doc_id, t.seg_no)
SELECT epoch, doc_id, seg_no, array_to_string(ids || {fill_sql(0, f'{MAX_LEN} - len(ids)')}, ' ') AS input_ids,
  array_to_string({fill_sql(1, 'len(ids)')} || {fill_sql(0, f'{MAX_LEN} - len(ids)')}, ' ') AS input_mask,
  array_to_string(segment_ids || {fill_sql(0, f'{MAX_LEN} - len(ids)')}, ' ') AS segment_ids,
  array_to_string(labels || {fill_sql(-1, f'{MAX_LEN} - len(ids)')}, ' ') AS lm_label_ids, random_next AS is_next
FROM tid JOIN laid_out USING (epoch, doc_id, seg_no)""")
def pack_lm_features(spark: SparkSession, sf: str) -> DataFrame:
    vocab = document_vocab(spark, sf)
    made = I.generate_epochs(segments(spark, sf), vocab, SEED, EPOCHS, MAX_LEN, prob=0.15)
    out = E.pack_lm_features(made, KEY, vocab, MAX_LEN)
    return out.select(*KEY, *[joined(c).alias(c) for c in ("input_ids", "input_mask", "segment_ids", "lm_label_ids")], "is_next")


@query()
def generate_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job on word pieces: three epochs, default probabilities.

    Its parts have SQL of their own; together they would take too long there.
    """
    vocab = document_vocab(spark, sf)
    lines = line_segments(documents(spark, sf)).withColumnRenamed("line", "text")
    pieces = materialize(T.tokenize(lines, ["doc_id", "seg_no"], vocab), "pieces")
    made = I.generate_epochs(pieces, vocab, SEED)
    return made.withColumns({c: joined(c) for c in ("tokens", "segment_ids", "masked_lm_positions", "masked_lm_labels")})


@query(f"""
WITH {SEGS}, x AS (SELECT epoch::INTEGER AS epoch, doc_id, seg_no FROM segs, range({EPOCHS}) e(epoch)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY {u_sql(SEED, 'epoch', 'doc_id', 'seg_no')}, doc_id, seg_no) - 1 AS k,
         count(*) OVER (PARTITION BY epoch) AS n FROM x)
SELECT epoch, doc_id, seg_no, k // 256 AS batch_no FROM r WHERE k < n // 256 * 256""")
def full_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of 256 segments; each epoch has its own order."""
    rows = segments(spark, sf).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"), "doc_id", "seg_no")
    return I.full_batches(rows, 256, SEED, ["doc_id", "seg_no"])


@query(f"""
WITH RECURSIVE {plan_sql(True)}, m AS (SELECT epoch, count(*) AS n FROM plan GROUP BY epoch)
SELECT e.epoch::INTEGER AS epoch, m.epoch AS data_epoch, n AS num_training_examples
FROM range(5) e(epoch) JOIN m ON m.epoch = e.epoch % {EPOCHS}""")
def instance_metrics(spark: SparkSession, sf: str) -> DataFrame:
    positions = materialize(I.segment_positions(segments(spark, sf)), "positions")
    metrics = I.instance_metrics(I.chunk_plan(positions, SEED, EPOCHS, MAX_LEN), MAX_LEN)
    return I.epoch_schedule(metrics, 5)

