"""Embedding and weight tables: vocabulary transfer, pruning, quantization, layer errors.

A table has an id and an array of floats. Arrays stay in one piece where the job
is per vector; only exact global ranks look at single weights.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.rand import u
from cohortlab.functions.sizing import broadcast_if_small
from cohortlab.operators import text as T
from cohortlab.operators.ordering import at_most, kth_smallest
from cohortlab.scratch import materialize


def vocab_overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """New tokens with whether the old vocabulary has them: token, id, kept."""
    kept = new.join(old.select("token"), "token", "left_semi").withColumn("kept", F.lit(True))
    added = new.join(old.select("token"), "token", "left_anti").withColumn("kept", F.lit(False))
    return kept.unionByName(added)


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def token_words(tokens: DataFrame, ngram: bool) -> DataFrame:
    """Words of each token without its leading ##; multi-word tokens are joined by underscores."""
    bare = F.regexp_replace("token", "^##", "")
    words = F.split(F.col("token"), "_") if ngram else F.array(bare)
    size = F.char_length(F.regexp_replace("token", "_", "")) if ngram else F.char_length(bare)
    return tokens.withColumn("words", F.filter(words, lambda w: w != "")).withColumn("n_chars", size)


def _pieces(old: DataFrame, added: DataFrame, ngrams: bool) -> DataFrame:
    """Pieces of each added token in the old vocabulary: token, id, n_chars, piece; a token without pieces has one null row."""
    is_ngram = F.col("token").rlike("[^_]_[^_]") if ngrams else F.lit(False)
    plain = token_words(added.where(~is_ngram), False)
    joined = token_words(added.where(is_ngram), True)
    words = materialize(plain.unionByName(joined), "words")
    tokens = T.tokenize_words(words, ["token", "id", "n_chars"], old)
    return tokens.select("token", "id", "n_chars", F.explode_outer("tokens").alias("piece"))


def transfer_average(old: DataFrame, new: DataFrame, ngrams: bool = False) -> DataFrame:
    """Shared tokens keep their vector, new ones get the mean of their old pieces."""
    return _transfer(old, new, ngrams, False)


def transfer_weighted(old: DataFrame, new: DataFrame, ngrams: bool = False) -> DataFrame:
    """As the average, with each piece weighted by its share of the token's characters."""
    return _transfer(old, new, ngrams, True)


def _kept(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    shared = new.join(old.select("token", _doubles(F.col("embedding")).alias("embedding")), "token")
    return shared.select("token", "id", "embedding"), new.join(old.select("token"), "token", "left_anti")


def _transfer(old: DataFrame, new: DataFrame, ngrams: bool, weighted: bool) -> DataFrame:
    """One vector for every new token.

    A piece without a vector counts with the vector of the unknown token, or with
    zeros where the old table has none; so does a token that has no piece at all. Vectors are looked
    up with care for pieces that very many tokens share, and summed dimension by
    dimension, so that no task holds the vectors of a token.
    """
    shared, added = _kept(old, new)
    vectors = old.select(F.col("token").alias("piece"), _doubles(F.col("embedding")).alias("v"))
    width = old.agg(F.max(F.size("embedding"))).first()[0] or 0
    unknown = old.where(F.col("token") == T.UNK).select(_doubles(F.col("embedding"))).limit(1).scalar()
    found = T.lookup(materialize(_pieces(old, added.select("token", "id"), ngrams), "pieces"), "piece", vectors)
    found = found.withColumn("v", F.coalesce("v", unknown, F.array_repeat(F.lit(0.0), width)))
    share = F.char_length(F.regexp_replace("piece", "^##", "")) / F.col("n_chars")
    weight = F.coalesce(share, F.lit(1.0)) if weighted else F.lit(1.0)
    sums = [F.sum(weight * F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)]
    summed = found.groupBy("token", "id").agg(F.count(F.lit(1)).alias("n"), *sums)
    total = F.lit(1.0) if weighted else F.col("n")
    vector = F.array(*[F.col(f"s{i}") / total for i in range(width)]).cast("array<double>")
    return shared.unionByName(summed.select("token", "id", vector.alias("embedding")))


def transfer_random(old: DataFrame, new: DataFrame, dim: int, seed: int = 0, per_token: bool = False) -> DataFrame:
    """New tokens get a uniform random vector: the same one for all, or one per token."""
    shared, added = _kept(old, new)
    keys = [F.col("token")] if per_token else []
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: u(seed, *keys, i))
    return shared.unionByName(added.select("token", "id", vector.alias("embedding")))


# Names of the ways to fill new vectors.
TRANSFERS = {"FVT": transfer_average, "PVT": transfer_random, "WVT": transfer_weighted}


def vocab_transfer(old: DataFrame, new: DataFrame, init: str, **options) -> DataFrame:
    if init not in TRANSFERS:
        raise ValueError(f"{init!r} is not one of {sorted(TRANSFERS)}")
    return TRANSFERS[init](old, new, **options)


def prune_magnitude(df: DataFrame, amount: float, key: str, vector: str = "embedding") -> DataFrame:
    """Zero the ``round(amount * n)`` smallest weights of the whole table; ties go by key and dimension.

    Only the exact threshold is searched globally; every vector is then cut by a
    plain expression, without moving a weight.
    """
    total = df.agg(F.sum(F.size(vector)).alias("n")).first().n or 0
    k = round(total * amount)
    if k == 0:
        return df
    long = df.select(F.col(key), F.posexplode(vector).alias("_dim", "_w")).select(
        F.abs("_w").alias("_abs"), key, "_dim"
    )
    last = kth_smallest(long, ["_abs", key, "_dim"], k)

    def cut(w: Column, i: Column) -> Column:
        return F.when(at_most([F.abs(w), F.col(key), i], last), F.lit(0.0).cast("float")).otherwise(w)

    return df.withColumn(vector, F.transform(vector, cut))


def block_scores(df: DataFrame, layer: str, block: int, vector: str = "embedding") -> DataFrame:
    """L1 weight of each block of dimensions in each layer: layer, block, score.

    Vectors are summed per block in place first, so one number per vector and
    block reaches the aggregate.
    """
    sums = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / block).cast("int")),
        lambda b: F.aggregate(
            F.slice(vector, b * block + 1, F.lit(block)), F.lit(0.0), lambda s, w: s + F.abs(w.cast("double"))
        ),
    )
    return df.select(F.col(layer).alias("layer"), F.posexplode(sums).alias("block", "s")).groupBy("layer", "block").agg(
        F.sum("s").alias("score")
    )


def prune_blocks(df: DataFrame, layer: str, block: int, amount: float, vector: str = "embedding") -> DataFrame:
    """Rank all blocks of all layers and drop the ``floor(amount * blocks)`` weakest: adds dropped."""
    scores = block_scores(df, layer, block, vector)
    ranked = Window.orderBy("score", "layer", "block")  # one row per layer and block
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return scores.withColumn("dropped", F.row_number().over(ranked) <= F.floor(n * F.lit(float(amount))))


def kept_blocks(df: DataFrame, pruned: DataFrame, layer: str, block: int, vector: str = "embedding") -> DataFrame:
    """The table with the dropped blocks removed from its vectors."""
    lost = pruned.groupBy("layer").agg(F.collect_set(F.when(F.col("dropped"), F.col("block"))).alias("_lost"))
    joined = df.join(F.broadcast(lost), df[layer] == lost["layer"], "left").drop(lost["layer"])  # one row per layer
    left = F.filter(vector, lambda w, i: ~F.array_contains(F.coalesce("_lost", F.array().cast("array<int>")),
                                                           F.floor(i / block).cast("int")))
    return joined.withColumn(vector, left).drop("_lost")


def dropped_per_layer(pruned: DataFrame) -> DataFrame:
    """Dropped blocks of each layer in order: layer, blocks."""
    return pruned.where("dropped").groupBy("layer").agg(F.array_sort(F.collect_set("block")).alias("blocks"))


@dataclass(frozen=True)
class QuantRange:
    """An 8-bit affine range: value = (code - zero) * scale."""

    scale: float
    zero: int


def calibrate(df: DataFrame, vector: str = "embedding") -> QuantRange:
    """Range of the calibration rows, always containing zero (two numbers on the driver)."""
    found = df.agg(F.min(F.array_min(vector)).alias("lo"), F.max(F.array_max(vector)).alias("hi")).first()
    low, high = min(float(found.lo or 0.0), 0.0), max(float(found.hi or 0.0), 0.0)  # an empty table has no range
    scale = (high - low) / 255.0 or 1.0
    return QuantRange(scale, round(-128 - low / scale))


def quantize_static(df: DataFrame, fitted: QuantRange, vector: str = "embedding", name: str = "codes") -> DataFrame:
    """8-bit codes with a fixed range; values outside it are clipped."""
    def code(w: Column) -> Column:
        raw = F.bround(w.cast("double") / F.lit(fitted.scale)) + F.lit(fitted.zero)
        return F.greatest(F.least(raw, F.lit(127)), F.lit(-128)).cast("int")

    return df.withColumn(name, F.transform(vector, code))


def quantize_dynamic(df: DataFrame, vector: str = "embedding", name: str = "codes") -> DataFrame:
    """Symmetric 8-bit codes with one scale per vector: adds scale and codes."""
    largest = F.array_max(F.transform(vector, lambda w: F.abs(w.cast("double"))))
    scaled = df.withColumn("scale", F.when(largest > 0, largest / 127.0).otherwise(F.lit(1.0)))
    return scaled.withColumn(
        name, F.transform(vector, lambda w: F.bround(w.cast("double") / F.col("scale")).cast("int"))
    )


def fake_quantize(df: DataFrame, fitted: QuantRange, vector: str = "embedding", name: str = "restored") -> DataFrame:
    """Quantize and restore, as seen by training that is aware of the quantization."""
    coded = quantize_static(df, fitted, vector, "_codes")
    return coded.withColumn(
        name, F.transform("_codes", lambda q: (q - F.lit(fitted.zero)) * F.lit(fitted.scale))
    ).drop("_codes")


def quantization_error(df: DataFrame, vector: str = "embedding", restored: str = "restored") -> DataFrame:
    """Mean squared and largest error over all weights: mse, max_error."""
    errors = F.zip_with(vector, restored, lambda a, b: a.cast("double") - b)
    squared = F.aggregate("_e", F.lit(0.0), lambda s, e: s + e * e)
    largest = F.array_max(F.transform("_e", lambda e: F.abs(e)))
    return df.select(errors.alias("_e")).agg(
        (F.sum(squared) / F.sum(F.size("_e"))).alias("mse"), F.max(largest).alias("max_error")
    )


def table_norms(df: DataFrame, weight_decay: float, vector: str = "embedding", bytes_per_weight: int = 4) -> DataFrame:
    """Squared norm, its penalty and the size in megabytes: norm_sq, reg_loss, size_mb."""
    squared = F.aggregate(vector, F.lit(0.0), lambda s, w: s + w.cast("double") * w.cast("double"))
    return df.agg(F.sum(squared).alias("norm_sq"), F.sum(F.size(vector)).alias("_n")).select(
        "norm_sq", (F.lit(weight_decay / 2) * F.col("norm_sq")).alias("reg_loss"),
        (F.col("_n") * bytes_per_weight / 1e6).alias("size_mb"),
    )


def layer_map(n_teacher: int, n_student: int) -> dict[str, list[tuple[int, int]]]:
    """Pairs (teacher layer, student layer) for attention maps and for representations."""
    if n_teacher % n_student:
        raise ValueError(f"{n_teacher} teacher layers cannot be shared out to {n_student}")
    k = n_teacher // n_student
    return {
        "attention": [(i * k + k - 1, i) for i in range(n_student)],
        "representation": [(i * k, i) for i in range(n_student + 1)],
    }


# Fixed value: attention scores at or below this are masked positions.
MASKED_SCORE = -100.0


def layer_mse(teacher: DataFrame, student: DataFrame, pairs: Sequence[tuple[int, int]], attention: bool = False,
              key: str = "example", vector: str = "values") -> DataFrame:
    """Mean squared difference of each mapped layer pair: layer (of the student), mse.

    Both tables have the key, ``layer`` and the values. The mapped layer is part
    of the join key, so unmapped teacher layers never leave the scan.
    """
    to_student = F.lit(None).cast("int")
    for t, s in pairs:
        to_student = F.when(F.col("layer") == t, F.lit(s)).otherwise(to_student)
    used = teacher.where(F.col("layer").isin([t for t, _ in pairs]))
    mapped = used.select(F.col(key), to_student.alias("layer"), F.col(vector).alias("_t"))

    def seen(x: Column) -> Column:
        value = x.cast("double")
        return F.when(value <= MASKED_SCORE, F.lit(0.0)).otherwise(value) if attention else value

    joined = mapped.join(student.select(key, "layer", F.col(vector).alias("_s")), [key, "layer"])
    squares = F.aggregate(
        F.zip_with("_t", "_s", lambda a, b: seen(a) - seen(b)), F.lit(0.0), lambda s, d: s + d * d
    )
    return joined.groupBy("layer").agg((F.sum(squares) / F.sum(F.size("_t"))).alias("mse"))


def distillation_loss(attention: DataFrame | None, representation: DataFrame | None, use_attention: bool = True,
                      use_hidden: bool = True, use_embedding: bool = True) -> DataFrame:
    """Sum of the enabled layer errors: att_loss, rep_loss, loss.

    Representation layer 0 is the embedding layer, the others are hidden layers.
    """
    if not (use_attention or use_hidden or use_embedding):
        raise ValueError("at least one term has to be enabled")
    terms = []
    if attention is not None and use_attention:
        terms.append(attention.select(F.col("mse").alias("att"), F.lit(0.0).alias("rep")))
    if representation is not None and (use_hidden or use_embedding):
        wanted = F.when(F.col("layer") == 0, F.lit(use_embedding)).otherwise(F.lit(use_hidden))
        terms.append(representation.where(wanted).select(F.lit(0.0).alias("att"), F.col("mse").alias("rep")))
    if not terms:
        raise ValueError("no table of an enabled term is given")
    rows = terms[0] if len(terms) == 1 else terms[0].unionByName(terms[1])
    return rows.agg(F.sum("att").alias("att_loss"), F.sum("rep").alias("rep_loss")).withColumn(
        "loss", F.col("att_loss") + F.col("rep_loss")
    )
