"""Queries over embedding tables. Token ids of the document vocabulary are vector ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import catalog as C
from cohortlab.operators import text as T
from cohortlab.operators import vectors as V
from cohortlab.plans.registry import query
from cohortlab.plans.tables import r6, spread, table, u_sql
from cohortlab.plans.text_queries import VOCAB, basic_sql, document_vocab, pieces_sql, vocab_sql
from cohortlab.scratch import materialize

NEW_SIZE = 2000


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def old_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the document vocabulary that have a vector."""
    vectors = embeddings(spark, sf).select(F.col("vec_id").cast("int").alias("id"), "embedding")
    return materialize(document_vocab(spark, sf).join(vectors, "id"), "old")


def new_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary of the conversations."""
    turns = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    counts = materialize(T.word_counts(T.basic_tokenize(turns)), "counts")
    return materialize(T.corpus_vocab(counts, NEW_SIZE), "new")


TOKENS = VOCAB + f""",
old_tokens AS MATERIALIZED (SELECT token, id, embedding::DOUBLE[] AS e FROM vocab JOIN embeddings ON vec_id = id),
conv_counts AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (SELECT unnest({basic_sql('text')}) AS word FROM conversations) GROUP BY word),
{vocab_sql('conv_counts', NEW_SIZE, 'new_tokens')},
added AS MATERIALIZED (
  SELECT token, id, regexp_replace(token, '^##', '') AS word FROM new_tokens WHERE token NOT IN (SELECT token FROM old_tokens))"""

PARTS = TOKENS + f""",
{pieces_sql('added', 'old_tokens')},
parts AS MATERIALIZED (
  SELECT a.token, a.id, a.word, unnest(pieces) AS piece FROM added a JOIN pieces USING (word)),
part_vec AS (
  SELECT a.token, a.id, coalesce(length(regexp_replace(piece, '^##', '')) / length(a.word)::DOUBLE, 1) AS w,
         unnest(coalesce(o.e, (SELECT e FROM old_tokens WHERE token = '[UNK]'), list_resize([0.0::DOUBLE], 64, 0.0::DOUBLE))) AS x,
         unnest(range(64)) AS dim
  FROM added a LEFT JOIN parts p USING (token, id) LEFT JOIN old_tokens o ON o.token = p.piece),
kept_vec AS (SELECT n.token, n.id, unnest(o.e) AS x, unnest(range(64)) AS dim FROM new_tokens n JOIN old_tokens o ON o.token = n.token)"""


def long_form(df: DataFrame) -> DataFrame:
    return df.select("token", "id", F.posexplode("embedding").alias("dim", "x")).withColumns(
        {"dim": F.col("dim").cast("long"), "x": r6("x")}
    )


@query(f"""
WITH {TOKENS} SELECT token, id, token IN (SELECT token FROM old_tokens) AS kept FROM new_tokens""")
def vocab_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return V.vocab_overlap(old_tokens(spark, sf), new_tokens(spark, sf))


@query(f"""
WITH RECURSIVE {PARTS}
SELECT token, id, dim, round(avg(x), 6) AS x FROM part_vec GROUP BY token, id, dim
UNION ALL SELECT token, id, dim, round(x, 6) FROM kept_vec""")
def transfer_average(spark: SparkSession, sf: str) -> DataFrame:
    return long_form(V.vocab_transfer(old_tokens(spark, sf), new_tokens(spark, sf), "FVT"))


@query(f"""
WITH RECURSIVE {PARTS}
SELECT token, id, dim, round(sum(w * x), 6) AS x FROM part_vec GROUP BY token, id, dim
UNION ALL SELECT token, id, dim, round(x, 6) FROM kept_vec""")
def transfer_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return long_form(V.vocab_transfer(old_tokens(spark, sf), new_tokens(spark, sf), "WVT"))


@query(f"""
WITH {TOKENS}
SELECT token, id, dim, round({u_sql(0, 'dim')}, 6) AS x FROM added, range(64) d(dim)
UNION ALL
SELECT n.token, n.id, unnest(range(64)), round(unnest(o.e), 6) FROM new_tokens n JOIN old_tokens o ON o.token = n.token""")
def transfer_random(spark: SparkSession, sf: str) -> DataFrame:
    return long_form(V.vocab_transfer(old_tokens(spark, sf), new_tokens(spark, sf), "PVT", dim=64))


@query(f"""
WITH RECURSIVE {VOCAB}, ng AS (SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS token FROM part),
ngw AS MATERIALIZED (SELECT token, unnest(string_split(token, '_')) AS word, unnest(range(len(string_split(token, '_')))) AS pos
  FROM (SELECT DISTINCT token FROM ng)),
{pieces_sql('ngw', 'vocab')},
joined AS (SELECT token, string_agg(array_to_string(pieces, ' '), ' ' ORDER BY pos) AS pieces FROM ngw JOIN pieces USING (word) GROUP BY token)
SELECT p_partkey, token, pieces, length(replace(token, '_', '')) AS n_chars FROM ng JOIN joined USING (token)""")
def ngram_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Part types as multi-word tokens, cut into pieces of the document vocabulary."""
    parts = table(spark, sf, "part").select(
        "p_partkey", F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))).alias("token")
    )
    words = V.token_words(parts, True)
    pieces = T.tokenize_words(words, ["p_partkey", "token", "n_chars"], document_vocab(spark, sf))
    return pieces.select("p_partkey", "token", F.array_join("tokens", " ").alias("pieces"), F.col("n_chars").cast("long").alias("n_chars"))


WEIGHTS = "w AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS dim FROM embeddings)"


@query(f"""
WITH {WEIGHTS}, r AS (SELECT *, row_number() OVER (ORDER BY abs(x), vec_id, dim) AS k, count(*) OVER () AS n FROM w)
SELECT vec_id, dim, CASE WHEN k <= round_even(n * 0.6::DOUBLE, 0) THEN 0 ELSE round(x::DOUBLE, 6) END AS x FROM r""")
def prune_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    out = V.prune_magnitude(embeddings(spark, sf).select("vec_id", "embedding"), 0.6, "vec_id")
    return out.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumns(
        {"dim": F.col("dim").cast("long"), "x": r6("x")}
    )


LAYERS = """
scores AS (
  SELECT (vec_id % 4)::INTEGER AS layer, (dim // 16)::INTEGER AS block, sum(abs(x::DOUBLE)) AS score FROM w GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (ORDER BY score, layer, block) <= floor(count(*) OVER () * 0.4::DOUBLE) AS dropped FROM scores)"""


def with_layers(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings(spark, sf).select("vec_id", F.pmod("vec_id", F.lit(4)).cast("int").alias("layer"), "embedding")


@query(f"WITH {WEIGHTS}, {LAYERS} SELECT layer, block, round(score, 6) AS score, dropped FROM ranked")
def prune_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return V.prune_blocks(with_layers(spark, sf), "layer", 16, 0.4).withColumn("score", r6("score"))


@query(f"""
WITH {WEIGHTS}, {LAYERS}
SELECT vec_id, (vec_id % 4)::INTEGER AS layer, count(*) AS kept, round(sum(x::DOUBLE), 6) AS total
FROM w JOIN ranked ON ranked.layer = vec_id % 4 AND ranked.block = dim // 16 WHERE NOT dropped GROUP BY vec_id""")
def kept_blocks(spark: SparkSession, sf: str) -> DataFrame:
    df = with_layers(spark, sf)
    out = V.kept_blocks(df, V.prune_blocks(df, "layer", 16, 0.4), "layer", 16)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    kept = out.where(F.size("embedding") > 0)
    return kept.select("vec_id", "layer", F.size("embedding").cast("long").alias("kept"), r6(total).alias("total"))


@query(f"""
WITH {WEIGHTS}, {LAYERS}
SELECT layer, string_agg(block::VARCHAR, ' ' ORDER BY block) AS blocks FROM ranked WHERE dropped GROUP BY layer""")
def dropped_blocks(spark: SparkSession, sf: str) -> DataFrame:
    out = V.dropped_per_layer(V.prune_blocks(with_layers(spark, sf), "layer", 16, 0.4))
    return out.withColumn("blocks", F.array_join(F.col("blocks").cast("array<string>"), " "))


# vectors with label below 8 are the calibration rows
CODES = WEIGHTS + """,
k AS (SELECT least(min(x), 0)::DOUBLE AS lo, greatest(max(x), 0)::DOUBLE AS hi FROM w JOIN embeddings USING (vec_id) WHERE label < 8),
q AS (SELECT (hi - lo) / 255.0::DOUBLE AS s, round_even(-128 - lo / ((hi - lo) / 255.0::DOUBLE), 0) AS z FROM k),
codes AS (SELECT vec_id, dim, x::DOUBLE AS x, greatest(least(round_even(x::DOUBLE / s, 0) + z, 127), -128)::INTEGER AS code, s, z FROM w, q)"""


def fitted_range(spark: SparkSession, sf: str) -> V.QuantRange:
    return V.calibrate(embeddings(spark, sf).where(F.col("label") < 8))


@query(f"WITH {CODES} SELECT vec_id, string_agg(code::VARCHAR, ' ' ORDER BY dim) AS codes FROM codes GROUP BY vec_id")
def quantize_static(spark: SparkSession, sf: str) -> DataFrame:
    out = V.quantize_static(embeddings(spark, sf), fitted_range(spark, sf))
    return out.select("vec_id", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"))


@query(f"""
WITH {WEIGHTS}, m AS (SELECT vec_id, max(abs(x::DOUBLE)) / 127.0::DOUBLE AS s FROM w GROUP BY vec_id)
SELECT vec_id, round(any_value(s), 6) AS scale, string_agg(round_even(x::DOUBLE / s, 0)::INTEGER::VARCHAR, ' ' ORDER BY dim) AS codes
FROM w JOIN m USING (vec_id) GROUP BY vec_id""")
def quantize_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    out = V.quantize_dynamic(embeddings(spark, sf))
    return out.select("vec_id", r6("scale").alias("scale"), F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"))


@query(f"""
WITH {CODES}, e AS (SELECT x - (code - z) * s AS d FROM codes)
SELECT round(avg(d * d) * 1000000, 6) AS mse_millionths, round(max(abs(d)), 6) AS max_error FROM e""")
def fake_quantize(spark: SparkSession, sf: str) -> DataFrame:
    restored = V.fake_quantize(embeddings(spark, sf), fitted_range(spark, sf))
    out = V.quantization_error(restored)
    return out.select(r6(F.col("mse") * 1000000).alias("mse_millionths"), r6("max_error").alias("max_error"))


@query(f"""
WITH {WEIGHTS}
SELECT round(sum(x::DOUBLE * x), 6) AS norm_sq, round(0.005::DOUBLE * sum(x::DOUBLE * x), 6) AS reg_loss, count(*) * 4 / 1000000.0::DOUBLE AS size_mb
FROM w""")
def table_norms(spark: SparkSession, sf: str) -> DataFrame:
    out = V.table_norms(embeddings(spark, sf), 0.01)
    return out.select(r6("norm_sq").alias("norm_sq"), r6("reg_loss").alias("reg_loss"), "size_mb")


def activations(spark: SparkSession, sf: str, layers: int, factor: float) -> DataFrame:
    """Activations of a model: each vector scaled per layer; below -0.3 counts as a masked score."""
    values = F.transform("embedding", lambda x: F.when(x < -0.3, F.lit(-10000.0)).otherwise(x.cast("double") * F.col("k")))
    rows = embeddings(spark, sf).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer"))
    return rows.withColumn("k", F.lit(factor) + F.col("layer")).select(F.col("vec_id").alias("example"), "layer", values.alias("values"))


@query(f"""
WITH {WEIGHTS}, v AS (SELECT CASE WHEN x < -0.3 THEN NULL ELSE x::DOUBLE END AS x FROM w),
p AS (SELECT layer, coalesce(x, 0) * (1.0::DOUBLE + 2 * layer + 1) - coalesce(x, 0) * (0.5::DOUBLE + layer) AS d FROM v, range(2) l(layer))
SELECT layer::INTEGER AS layer, round(avg(d * d), 6) AS mse FROM p GROUP BY layer""")
def layer_mse_attention(spark: SparkSession, sf: str) -> DataFrame:
    """Four teacher layers against two student layers."""
    pairs = V.layer_map(4, 2)["attention"]
    out = V.layer_mse(activations(spark, sf, 4, 1.0), activations(spark, sf, 2, 0.5), pairs, attention=True)
    return out.withColumn("mse", r6("mse"))


@query(f"""
WITH {WEIGHTS}, v AS (SELECT CASE WHEN x < -0.3 THEN NULL ELSE x::DOUBLE END AS x FROM w),
a AS (SELECT layer, coalesce(x, 0) * (1.0::DOUBLE + 2 * layer + 1) - coalesce(x, 0) * (0.5::DOUBLE + layer) AS d FROM v, range(2) l(layer)),
r AS (SELECT layer, CASE WHEN x IS NULL THEN 0 ELSE x * (1.0::DOUBLE + 2 * layer) - x * (0.5::DOUBLE + layer) END AS d FROM v, range(3) l(layer)),
am AS (SELECT layer, avg(d * d) AS m FROM a GROUP BY layer), rm AS (SELECT layer, avg(d * d) AS m FROM r WHERE layer > 0 GROUP BY layer)
SELECT round((SELECT sum(m) FROM am), 6) AS att_loss, round((SELECT sum(m) FROM rm), 6) AS rep_loss,
       round((SELECT sum(m) FROM am) + (SELECT sum(m) FROM rm), 6) AS loss""")
def distillation_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Attention and hidden terms, without the embedding term."""
    pairs = V.layer_map(4, 2)
    att = V.layer_mse(activations(spark, sf, 4, 1.0), activations(spark, sf, 2, 0.5), pairs["attention"], attention=True)
    rep = V.layer_mse(activations(spark, sf, 5, 1.0), activations(spark, sf, 3, 0.5), pairs["representation"])
    out = V.distillation_loss(att, rep, use_embedding=False)
    return out.withColumns({c: r6(c) for c in out.columns})


def tagged_pages(spark: SparkSession, sf: str) -> DataFrame:
    etag = F.when(F.pmod("page_id", F.lit(2)) == 1, F.md5("html"))
    return table(spark, sf, "pages").select("page_id", "url", etag.alias("etag"))


KEYS = """
keyed AS (
  SELECT page_id, url, CASE WHEN page_id % 2 = 1 THEN md5(html) END AS etag,
         sha256(url) || CASE WHEN page_id % 2 = 1 THEN '.' || sha256(md5(html)) ELSE '' END AS cache_key FROM pages)"""


@query(f"WITH {KEYS} SELECT page_id, cache_key FROM keyed")
def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return C.cache_key(tagged_pages(spark, sf)).select("page_id", "cache_key")


@query(r"""
WITH x AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^http[s]?:', 's3:') WHEN 2 THEN regexp_replace(url, '^http[s]?://', '')
    ELSE regexp_replace(url, '^http[s]?:', 'ftp:') END || CASE WHEN url LIKE '%?%' OR url LIKE '%#%' THEN '' ELSE '.TXT' END AS url FROM pages),
s AS (SELECT *, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^([a-z0-9]+):', 1) WHEN 1 THEN 's3' WHEN 2 THEN '' ELSE 'ftp' END AS scheme,
  regexp_extract(url, '^[^:/?#]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]+/?([^?#]*)', 1) AS path FROM x)
SELECT page_id, scheme, CASE WHEN scheme = 's3' AND path = '' THEN 'error' WHEN scheme = '' THEN 'local' WHEN scheme = 'ftp' THEN 'error' ELSE 'fetch' END AS route,
  CASE WHEN scheme = 's3' THEN host END AS bucket, CASE WHEN scheme = 's3' AND path <> '' THEN path END AS object_key,
  lower(regexp_extract(CASE WHEN scheme = '' THEN url ELSE path END, '[^/.][^/]*?(\.[^/.]*)$', 1)) AS extension
FROM s""")
def route_url(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses with schemes changed by page number, some with a file extension."""
    kind = F.pmod("page_id", F.lit(4))
    url = F.col("url")
    changed = (
        F.when(kind == 0, url).when(kind == 1, F.regexp_replace(url, "^http[s]?:", "s3:"))
        .when(kind == 2, F.regexp_replace(url, "^http[s]?://", "")).otherwise(F.regexp_replace(url, "^http[s]?:", "ftp:"))
    )
    suffix = F.when(url.contains("?") | url.contains("#"), "").otherwise(".TXT")
    pages = table(spark, sf, "pages").select("page_id", F.concat(changed, suffix).alias("url"))
    return C.route_url(pages).select("page_id", "scheme", "route", "bucket", "object_key", "extension")


@query(f"""
WITH {KEYS}, cat AS (
  SELECT cache_key AS name, url, etag FROM keyed
  UNION ALL SELECT sha256(url) || '.' || sha256('v' || page_id), url, 'v' || page_id FROM keyed WHERE page_id % 3 = 0
  UNION ALL SELECT cache_key || '.json', url, etag FROM keyed),
entries AS (SELECT * FROM cat WHERE name NOT LIKE '%.json'),
want AS (SELECT page_id, url, CASE WHEN page_id % 3 = 1 THEN md5(url) WHEN page_id % 3 = 2 AND page_id % 2 = 1 THEN etag END AS etag FROM keyed),
wk AS (SELECT *, sha256(url) AS stem, sha256(url) || CASE WHEN etag IS NOT NULL THEN '.' || sha256(etag) ELSE '' END AS cache_key FROM want),
ex AS (SELECT wk.page_id, min(name) AS name FROM wk JOIN entries ON name = cache_key GROUP BY wk.page_id),
la AS (SELECT wk.page_id, max(name) AS name FROM wk JOIN entries ON starts_with(name, stem || '.') GROUP BY wk.page_id)
SELECT wk.page_id, wk.cache_key, coalesce(ex.name, CASE WHEN wk.etag IS NULL THEN la.name END) AS file
FROM wk LEFT JOIN ex ON ex.page_id = wk.page_id LEFT JOIN la ON la.page_id = wk.page_id""")
def resolve_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog with several versions per URL, asked with known, unknown and stale etags."""
    pages = tagged_pages(spark, sf)
    keyed = C.cache_key(pages)
    third = F.pmod("page_id", F.lit(3))
    version = F.concat(F.lit("v"), F.col("page_id").cast("string"))
    current = keyed.select(F.col("cache_key").alias("name"), "url", "etag")
    older = C.cache_key(pages.where(third == 0).withColumn("etag", version)).select(F.col("cache_key").alias("name"), "url", "etag")
    sidecars = keyed.select(F.concat("cache_key", F.lit(".json")).alias("name"), "url", "etag")
    wanted = pages.withColumn(
        "etag", F.when(third == 1, F.md5("url")).when((third == 2) & (F.pmod("page_id", F.lit(2)) == 1), F.col("etag"))
    )
    catalog = current.unionByName(older).unionByName(sidecars).dropDuplicates(["name"])
    return C.resolve_cache(wanted, catalog).select("page_id", "cache_key", "file")
