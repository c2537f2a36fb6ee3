"""Queries over labels, attributes, groups and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators import groups as G
from cohortlab.plans.registry import query
from cohortlab.plans.tables import LAB, RECIPE, SPACE, labelled, r6, table, u_sql


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their balance scaled to 0..1."""
    return table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", ((F.col("c_acctbal") + 1000.0) / 11000.0).alias("score"),
        (F.col("c_nationkey") / 24.0).alias("nation_score"),
    )


@query("""
SELECT c_custkey, CASE WHEN (c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS y
FROM customer""")
def threshold_label(spark: SparkSession, sf: str) -> DataFrame:
    return G.threshold_label(_scaled(spark, sf), "score").select("c_custkey", "y")


@query("""
SELECT event_id,
       CASE WHEN value / 500.0::DOUBLE >= 0.05 THEN 1 ELSE 0 END
       + 2 * CASE WHEN user_id / 150.0::DOUBLE >= 0.05 THEN 1 ELSE 0 END AS c
FROM events""")
def confounder_code(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "events").select(
        "event_id", (F.col("value") / 500.0).alias("a"), (F.col("user_id") / 150.0).alias("b")
    )
    return G.confounder_code(scores, ["a", "b"], threshold=0.05).select("event_id", "c")


@query(f"""
WITH {LAB}, k AS (SELECT count(DISTINCT y) AS n_classes, count(DISTINCT c) AS n_values FROM lab)
SELECT doc_id, y, c, (y * n_values + c)::INTEGER AS g, (n_classes * n_values)::INTEGER AS n_groups FROM lab, k""")
def assign_group(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf)
    space = G.group_space(df)
    return G.assign_group(df, space).select("doc_id", "y", "c", "g", F.lit(space.n_groups).alias("n_groups"))


@query(f"""
WITH {LAB}
SELECT doc_id, y * 4 + c + 2 * CASE WHEN lang <> 'en' THEN 1 ELSE 0 END AS g FROM lab""")
def assign_group_two_attributes(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf).withColumn("other_lang", (F.col("lang") != "en").cast("int"))
    coded = G.confounder_code(df, ["c", "other_lang"], name="code")
    space = G.group_space(coded, n_binary=2)
    return G.assign_group(coded, space, c="code").select("doc_id", "g")


@query(f"WITH {LAB} SELECT doc_id, y AS g FROM lab")
def label_only_groups(spark: SparkSession, sf: str) -> DataFrame:
    return G.label_only_groups(labelled(spark, sf)).select("doc_id", "g")


@query(f"""
WITH {LAB}, two AS (
  SELECT doc_id, y, c, g, CASE WHEN lang <> 'en' THEN 1 ELSE 0 END AS other_lang FROM lab)
SELECT doc_id,
  'quality = ' || y || ', toxic = ' || c || ', other_lang = ' || other_lang AS binary_name,
  'quality = ' || y || ', toxic = ' || c AS coded_name,
  'quality = ' || y AS label_name
FROM two""")
def group_name(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf).withColumn("other_lang", (F.col("lang") != "en").cast("int"))
    coded = G.confounder_code(df, ["c", "other_lang"], name="code")
    wide = G.GroupSpace(2, 4)
    out = G.assign_group(coded, wide, c="code", name="g4")
    out = G.assign_group(out, SPACE, name="g2")
    return out.select(
        "doc_id",
        G.group_name("g4", wide, "quality", ["toxic", "other_lang"]).alias("binary_name"),
        G.group_name("g2", SPACE, "quality", ["toxic"], binary=False).alias("coded_name"),
        G.group_name("y", G.GroupSpace(2, 1), "quality").alias("label_name"),
    )


@query(f"WITH {LAB} SELECT doc_id, split::INTEGER AS split FROM lab")
def encode_split(spark: SparkSession, sf: str) -> DataFrame:
    named = labelled(spark, sf).withColumn(
        "split_name", F.when(F.col("split") == 0, "train").when(F.col("split") == 1, "val").otherwise("test")
    )
    return G.encode_split(named.drop("split"), "split_name").select("doc_id", "split")


@query(f"WITH {LAB} SELECT doc_id, y, g FROM lab WHERE split = 1")
def take_split(spark: SparkSession, sf: str) -> DataFrame:
    grouped = G.assign_group(labelled(spark, sf), SPACE)
    return G.take_split(grouped, "val").select("doc_id", "y", "g")


@query(f"""
WITH {LAB}, train AS (
  SELECT doc_id, row_number() OVER (ORDER BY {u_sql(7, 'doc_id')}, doc_id) AS r, count(*) OVER () AS n
  FROM lab WHERE split = 0)
SELECT doc_id, 0 AS split FROM train WHERE r <= round_even(n * 0.35::DOUBLE, 0)
UNION ALL SELECT doc_id, split FROM lab WHERE split <> 0""")
def sample_split(spark: SparkSession, sf: str) -> DataFrame:
    return G.sample_split(labelled(spark, sf), 0.35, 7, "doc_id").select("doc_id", "split")


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS y FROM documents WHERE lang IN ('en', 'de')""")
def label_subset(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    docs = table(spark, sf, "documents").select("doc_id", code.alias("y"))
    return G.label_subset(docs, [0, 2]).select("doc_id", "y")


@query("""
SELECT d.doc_id, l.quality AS left_value, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS right_value
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS DISTINCT FROM CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END""")
def align_check(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("y"))
    return G.align_check(labels, docs, "doc_id")


@query(f"""
WITH {LAB}
SELECT k.g::INTEGER AS g, count(l.doc_id) AS n,
       round(count(l.doc_id) / (SELECT count(*) FROM lab)::DOUBLE, 6) AS fraction
FROM range(6) k(g) LEFT JOIN lab l ON l.g = k.g GROUP BY k.g""")
def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    grouped = G.assign_group(labelled(spark, sf), SPACE)
    # a third class that no row has: its groups must show up empty
    return G.group_counts(grouped, G.GroupSpace(3, 2)).withColumn("fraction", r6("fraction"))


@query(f"""
WITH {LAB}
SELECT k.y::INTEGER AS y, count(l.doc_id) AS n,
       round(count(l.doc_id) / (SELECT count(*) FROM lab)::DOUBLE, 6) AS fraction
FROM range(2) k(y) LEFT JOIN lab l ON l.y = k.y GROUP BY k.y""")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.class_counts(labelled(spark, sf), SPACE).withColumn("fraction", r6("fraction"))


@query(f"WITH {LAB} SELECT doc_id, split, y, c, g FROM lab")
def build_subgroup_dataset(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = G.build_subgroup_dataset(labelled(spark, sf), RECIPE)
    return out.select("doc_id", "split", "y", "c", "g")


@query("""
SELECT doc_id, y, c, (y * 2 + c) AS g FROM (
  SELECT d.doc_id, l.toxic AS c, CASE d.lang WHEN 'fr' THEN 0 ELSE 1 END AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang IN ('fr', 'de'))""")
def build_class_pair_dataset(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    df = labelled(spark, sf).withColumn("lang_code", code)
    out, _ = G.build_subgroup_dataset(df, G.Recipe("lang_code", ("c",), labels=(1, 2)))
    return out.select("doc_id", "y", "c", "g")


@query(f"WITH {LAB} SELECT doc_id, y, upper(lang) AS lang FROM lab")
def with_item_fn(spark: SparkSession, sf: str) -> DataFrame:
    hook = lambda df: df.withColumn("lang", F.upper("lang"))
    return G.with_item_fn(labelled(spark, sf), hook).select("doc_id", "y", "lang")
