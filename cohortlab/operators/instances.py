"""Training instances from a corpus: chunks, sentence pairs and masked tokens.

A corpus is a table of segments: ``doc_id``, ``seg_no`` (0, 1, ... within the
document) and ``tokens``. All random choices are functions of the seed and of
the row's keys, so what happens to a chunk depends only on where it starts.
That turns the walk over a document into a pointer from each segment to the
start of the following chunk, computed for all segments at once; only the chain
of starts is sequential, and it is followed block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions import arrays
from cohortlab.functions.dictionaries import pack, unpack
from cohortlab.functions.masking import keyed, masker
from cohortlab.functions.rand import below, u
from cohortlab.functions.sizing import broadcast_if_small, fits
from cohortlab.operators.ordering import dense_index, prefix_sums, running_sums
from cohortlab.operators.text import lookup
from cohortlab.scratch import materialize

# Tokens of the instance layout.
CLS, SEP, MASK, EMPTY_SIDE = "[CLS]", "[SEP]", "[MASK]", "."

# Tokens per block of a document; a block is the unit that one task walks.
BLOCK_TOKENS = 16_384
# Segments per bucket when an offset is looked up among documents.
OFFSET_BUCKET = 64
#: A piece of a document, in which a chain is followed by one task, has at most so many segments.
PIECE_SEGMENTS = 16_384


def segment_positions(segments: DataFrame) -> DataFrame:
    """Tokens in each segment and before it in its document: doc_id, seg_no, n_tok, before."""
    return _positions(segments.select("doc_id", "seg_no", F.size("tokens").cast("long").alias("n_tok")))


def _positions(sizes: DataFrame) -> DataFrame:
    summed = running_sums(sizes, ["doc_id"], "seg_no", {"_after": F.col("n_tok")})
    return summed.select("doc_id", "seg_no", "n_tok", (F.col("_after") - F.col("n_tok")).alias("before"))


def doc_lengths(segments: DataFrame) -> DataFrame:
    """Segments per document with its index and the segments before it: doc_id, n_segs, idx, cum_start."""
    counts = segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_segs"))
    return prefix_sums(counts, ["doc_id"], {"idx": F.lit(1), "cum_start": F.col("n_segs")}).select(
        "doc_id", F.col("n_segs"), F.col("idx").cast("long").alias("idx"), F.col("cum_start").cast("long").alias("cum_start")
    )


def sample_other_doc(draws: DataFrame, docs: DataFrame, keys: Sequence[Column | str | int],
                     weighted: bool = True) -> DataFrame:
    """Pick another document for each draw: adds doc_b and its n_segs_b.

    ``keys`` name the draw for the random number. Weighted draws choose documents
    in proportion to their segments. The offset lookup is an equi-join on buckets
    of ``OFFSET_BUCKET`` segments; a long document owns many buckets.
    """
    sizes = docs.agg(F.count(F.lit(1)).alias("docs"), F.sum("n_segs").alias("segs")).first()
    if sizes.docs is None or sizes.docs < 2:
        raise ValueError("another document cannot be drawn from fewer than two documents")
    own = docs.select("doc_id", "n_segs", "idx", "cum_start")
    known = lookup(draws, "doc_id", own)  # one document may make most of the draws
    if not weighted:
        index = (F.col("idx") + 1 + below(sizes.docs - 1, *keys)) % sizes.docs
        other = docs.select(F.col("idx").alias("_idx"), F.col("doc_id").alias("doc_b"), F.col("n_segs").alias("n_segs_b"))
        drawn = known.withColumn("_idx", index).join(broadcast_if_small(other), "_idx")
        return drawn.drop("_idx", "n_segs", "idx", "cum_start")
    end = F.col("cum_start") + F.col("n_segs")
    offset = (end + below(F.lit(sizes.segs) - F.col("n_segs"), *keys)) % F.lit(sizes.segs)
    drawn = known.withColumn("_off", offset).drop("n_segs", "idx", "cum_start")
    drawn = drawn.withColumn("_bucket", F.floor(F.col("_off") / OFFSET_BUCKET))
    first, last = F.floor(F.col("cum_start") / OFFSET_BUCKET), F.floor((end - 1) / OFFSET_BUCKET)
    owners = docs.select(
        F.col("doc_id").alias("doc_b"), F.col("n_segs").alias("n_segs_b"), F.col("cum_start").alias("_from"),
        end.alias("_to"), F.explode(F.sequence(first, last)).alias("_bucket"),
    )
    inside = (F.col("_off") >= F.col("_from")) & (F.col("_off") < F.col("_to"))
    return drawn.join(owners, "_bucket").where(inside).drop("_bucket", "_off", "_from", "_to")


def target_length(max_seq_len: int, short_prob: float, *keys: Column | str | int) -> Column:
    """Tokens to aim for: the maximum, or now and then a uniform shorter length of at least 2."""
    most = max_seq_len - 3
    seed, *row = keys
    short = F.lit(2).cast("long") + below(most - 1, seed, "length", *row)
    return F.when(u(seed, "short", *row) < short_prob, short).otherwise(F.lit(most).cast("long"))


def target_lengths(docs: DataFrame, epochs: int, max_seq_len: int, short_prob: float, seed: int) -> DataFrame:
    """Target of every document in every epoch: epoch, doc_id, target."""
    numbered = docs.select(F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "doc_id")
    target = target_length(max_seq_len, short_prob, seed, F.col("epoch"), F.col("doc_id"))
    return numbered.withColumn("target", target)


def _chunk_ends(positions: DataFrame, most: int, block: int, target: Column, epochs: int) -> DataFrame:
    """For each segment taken as the start of a chunk, the last segment of that chunk.

    Segment e belongs to the chunk of s while the tokens between their starts stay
    below the target. Within (document, block) this is one sorted pass over segment
    starts and probes; the next block lends its first segments to the block before.
    """
    blocked = positions.withColumn("blk", F.floor(F.col("before") / block).cast("long"))
    numbered = blocked.select(F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "*")
    numbered = numbered.withColumn("target", target)
    borrowed = (F.col("blk") > 0) & (F.col("before") - F.col("blk") * block < F.lit(most))
    start = F.struct(F.col("before").alias("at"), F.lit(1).alias("kind"), F.col("blk").alias("grp"))
    probe = F.struct((F.col("before") + F.col("target")).alias("at"), F.lit(0).alias("kind"), F.col("blk").alias("grp"))
    halo = F.struct(F.col("before").alias("at"), F.lit(1).alias("kind"), (F.col("blk") - 1).alias("grp"))
    rows = numbered.withColumn(
        "_row", F.explode(F.when(borrowed, F.array(start, probe, halo)).otherwise(F.array(start, probe)))
    ).select("epoch", "doc_id", "seg_no", "before", "blk", "target", "_row.*")
    order = Window.partitionBy("epoch", "doc_id", "grp").orderBy("at", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    seen = F.max(F.when(F.col("kind") == 1, F.col("seg_no"))).over(order)
    ends = rows.withColumn("seg_end", seen).where(F.col("kind") == 0)
    return ends.select("epoch", "doc_id", "seg_no", "before", "blk", "target", "seg_end")


def _inside(links: str = "links") -> Column:
    """For each link of a piece the index that it leads to; the size of the piece and more lie outside."""
    first = F.element_at(links, 1)["seg_no"]
    return F.transform(links, lambda l: (l["next"] - first).cast("int"))


def _walk(entry: Column, links: str = "links") -> Column:
    """The links of one piece that the chain takes from ``entry`` on.

    Only indexes are gathered on the way, and each link is looked at once.
    """
    at = (entry - F.element_at(links, 1)["seg_no"]).cast("int")
    start = F.struct(at.alias("at"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("taken"))

    def step(state: Column, to: Column) -> Column:
        here, i = state["at"] == state["i"], state["i"]
        return F.struct(
            F.when(here, to).otherwise(state["at"]).alias("at"), (i + 1).alias("i"),
            F.when(here, F.concat(state["taken"], F.array(i))).otherwise(state["taken"]).alias("taken"))

    return F.transform(F.aggregate(_inside(links), start, step)["taken"], lambda i: F.get(links, i))


def _piece_exits(pieces: DataFrame) -> DataFrame:
    """Adds ``exits``: for each link the first segment outside of the piece that its chain reaches.

    The jumps are doubled for all links at once, so every link costs a logarithm of the piece, wherever the chain enters.
    """
    pieces = pieces.withColumn("_to", _inside())
    for _ in range(PIECE_SEGMENTS.bit_length()):
        pieces = pieces.withColumn("_to", F.transform("_to", lambda x: F.coalesce(F.get("_to", x), x)))
    first = F.element_at("links", 1)["seg_no"]
    return pieces.withColumn("exits", F.transform("_to", lambda x: x + first)).drop("_to")


def _piece_entries(pieces: DataFrame, most: int, rounds: int) -> DataFrame:
    """Where the chain of a long document enters each of its pieces: epoch, doc_id, entry.

    A piece can only be entered near its beginning, by the tokens before. Each such entry leads to one
    exit, and doubling the jumps reaches all pieces in a logarithmic number of joins.
    """
    keys = ["epoch", "doc_id"]
    found = _piece_exits(pieces)
    first = F.element_at("links", 1)["before"]
    pairs = F.zip_with("links", "exits", lambda l, x: F.struct(l["seg_no"].alias("entry"), x.alias("exit")))
    # an entry follows a segment that begins near the piece's beginning, however long that segment is
    near = F.filter(pairs, lambda x, i: (i == 0) | (F.get("links", i - 1)["before"] - first < most))
    jumps = materialize(found.select(*keys, F.explode(near).alias("j")).select(*keys, "j.entry", "j.exit"), "jumps")
    reached = jumps.where(F.col("entry") == 0).select(*keys, "entry")
    for _ in range(rounds):
        ahead = reached.join(jumps, [*keys, "entry"]).select(*keys, F.col("exit").alias("entry"))
        reached = materialize(reached.unionByName(ahead).distinct(), "reached")
        second = jumps.select(*keys, F.col("entry").alias("exit"), F.col("exit").alias("_exit2"))
        jumps = materialize(
            jumps.join(second, [*keys, "exit"]).select(*keys, "entry", F.col("_exit2").alias("exit")), "jumps"
        )
    return reached


def chunk_plan(positions: DataFrame, seed: int, epochs: int = 1, max_seq_len: int = 128, short_prob: float = 0.1,
               pairs: bool = True, block: int = BLOCK_TOKENS) -> DataFrame:
    """Chunks of every document and epoch, by segment numbers only.

    Columns: epoch, doc_id, seg_no (first segment), a_end (first segment after side
    A), seg_end (last segment), random_next, before, target. With ``pairs`` half of
    the chunks, and all of one segment, get a foreign second side; the segments
    that would have been the second side then start the following chunk.
    """
    most = max_seq_len - 3
    if block < most:
        raise ValueError("a block must hold at least one chunk")
    target = target_length(max_seq_len, short_prob, seed, F.col("epoch"), F.col("doc_id"))
    ends = _chunk_ends(positions, most, block, target, epochs)
    row = [F.col("epoch"), F.col("doc_id"), F.col("seg_no")]
    n = F.col("seg_end") - F.col("seg_no") + 1
    a_end = F.col("seg_no") + F.when(n == 1, F.lit(1)).otherwise(1 + below(n - 1, seed, "cut", *row))
    foreign = ((n == 1) | (u(seed, "next", *row) < 0.5)) if pairs else F.lit(False)
    linked = ends.withColumn("a_end", a_end.cast("long")).withColumn("random_next", foreign)
    following = F.when(F.col("random_next"), F.col("a_end")).otherwise(F.col("seg_end") + 1)
    link = F.struct(
        F.col("seg_no").cast("long").alias("seg_no"), following.cast("long").alias("next"), "a_end",
        F.col("seg_end").cast("long").alias("seg_end"), "random_next", F.col("before").cast("long").alias("before"),
        F.col("target").cast("long").alias("target"),
    )
    # a piece is bounded by tokens, and by segments, which may be empty
    piece = ["blk", "part"]
    part = F.floor(F.col("seg_no") / PIECE_SEGMENTS).cast("long").alias("part")
    pieces = linked.select("*", part).groupBy("epoch", "doc_id", *piece).agg(F.array_sort(F.collect_list(link)).alias("links"))
    last = positions.agg(F.max("before").alias("tokens"), F.max("seg_no").alias("segments")).first()
    tokens, count = last.tokens or 0, last.segments or 0
    if tokens < block and count < PIECE_SEGMENTS:
        entered = pieces.withColumn("entry", F.lit(0).cast("long"))
    else:
        pieces = materialize(pieces, "pieces")
        several = pieces.where((F.col("blk") > 0) | (F.col("part") > 0)).select("epoch", "doc_id").distinct()
        # few documents are long, so that the pieces of the others need no shuffle
        several = broadcast_if_small(materialize(several, "several"))
        long = pieces.join(several, ["epoch", "doc_id"], "left_semi")
        short = pieces.join(several, ["epoch", "doc_id"], "left_anti").withColumn("entry", F.lit(0).cast("long"))
        rounds = (tokens // block + count // PIECE_SEGMENTS + 1).bit_length()
        entries = _piece_entries(long, most, rounds)
        bounds = positions.select("doc_id", F.col("seg_no").alias("entry"), F.floor(F.col("before") / block).cast("long").alias("blk"), part)
        placed = entries.join(bounds, ["doc_id", "entry"])
        # the chain is in a piece from its first entry on
        placed = placed.groupBy("epoch", "doc_id", *piece).agg(F.min("entry").alias("entry"))
        entered = short.unionByName(long.join(placed, ["epoch", "doc_id", *piece]).select(*pieces.columns, "entry"))
    taken = entered.select("epoch", "doc_id", F.explode(_walk(F.col("entry"))).alias("l"))
    return taken.select("epoch", "doc_id", "l.*").drop("next")


def pack_segments(segments: DataFrame, target: int, block: int = BLOCK_TOKENS) -> DataFrame:
    """Consecutive chunks of at least ``target`` tokens: doc_id, chunk_no, first_seg, last_seg, n_tok."""
    positions = materialize(segment_positions(segments), "positions")
    plan = chunk_plan(positions, 0, 1, target + 3, 0.0, pairs=False, block=max(block, target))
    ends = positions.select("doc_id", F.col("seg_no").alias("seg_end"), (F.col("before") + F.col("n_tok")).alias("_after"))
    sized = plan.join(ends, ["doc_id", "seg_end"])
    numbered = running_sums(sized, ["doc_id"], "seg_no", {"_no": F.lit(1)})
    return numbered.select(
        "doc_id", (F.col("_no") - 1).cast("long").alias("chunk_no"), F.col("seg_no").alias("first_seg"),
        F.col("seg_end").alias("last_seg"), (F.col("_after") - F.col("before")).alias("n_tok"),
    )


def make_pairs(segments: DataFrame, seed: int, epochs: int = 1, max_seq_len: int = 128, short_prob: float = 0.1,
               pairs: bool = True, block: int = BLOCK_TOKENS) -> DataFrame:
    """Both sides of every instance: epoch, doc_id, seg_no, random_next, doc_b, tokens_a, tokens_b.

    Only numbers are planned; the tokens are fetched once, by (document, segment), and go on once to all chunks of a part
    of a document, whatever the epochs. Each segment's tokens are one text until their side is complete, as arrays of short
    texts take several times the room in a shuffle.
    """
    # the texts are read where they are: once for their sizes, and once for the chunks
    numbered = segments.withColumn("seg_no", F.col("seg_no").cast("long"))
    sizes = materialize(numbered.select("doc_id", "seg_no", F.size("tokens").cast("long").alias("n_tok")), "sizes")
    positions = materialize(_positions(sizes), "positions")
    plan = materialize(chunk_plan(positions, seed, epochs, max_seq_len, short_prob, pairs, block), "plan")
    # a chunk belongs to the part of its document in which it begins, so that a long one is still dealt out
    plan = plan.withColumn("part", F.floor(F.col("before") / block).cast("long"))
    home = ["doc_id", "part"]

    def chunk(side: int) -> Column:
        return F.struct("epoch", "seg_no", F.lit(side).alias("side"), "random_next")

    # a chunk's own segments are all wanted; null marks them
    own = [F.lit(None).cast("long").alias(c) for c in ("start", "from", "want")]
    own_a = plan.select(
        *home, chunk(0).alias("chunk"), F.col("doc_id").alias("src"),
        F.explode(F.sequence("seg_no", F.col("a_end") - 1)).alias("src_seg"), *own,
    )
    own_b = plan.where(~F.col("random_next") & (F.col("a_end") <= F.col("seg_end"))).select(
        *home, chunk(1).alias("chunk"), F.col("doc_id").alias("src"),
        F.explode(F.sequence("a_end", "seg_end")).alias("src_seg"), *own,
    )
    wanted = own_a.unionByName(own_b)
    if pairs:
        drawn = materialize(_draw_sides(plan, positions, seed, max_seq_len - 3, block), "drawn")
        foreign = drawn.withColumns({"random_next": F.lit(True), "part": F.floor(F.col("before") / block).cast("long")}).select(
            *home, chunk(1).alias("chunk"), F.col("doc_b").alias("src"),
            F.explode(F.sequence("start", "start_end")).alias("src_seg"), "start", "from", "want",
        )
        wanted = wanted.unionByName(foreign)
    # dealt by the segment, so that the numbers of a segment's chunks come together where its text is
    asked = wanted.repartition("src", "src_seg").groupBy("src", "src_seg", *home, "start", "from", "want").agg(
        F.collect_list("chunk").alias("chunks"))
    packed = numbered.select("doc_id", "seg_no", pack(F.col("tokens")).alias("packed"))
    source = packed.join(positions, ["doc_id", "seg_no"]).select(
        F.col("doc_id").alias("src"), F.col("seg_no").alias("src_seg"), "packed", F.col("before").alias("at")
    )
    fetched = asked.join(source, ["src", "src_seg"]).where(
        F.col("start").isNull() | (F.col("src_seg") == F.col("start")) | (F.col("at") - F.col("from") < F.col("want"))
    )
    sent = fetched.select(*home, F.when(F.col("start").isNotNull(), F.col("src")).alias("doc_b"), "src_seg", "packed", "chunks")
    # the texts are dealt before they are repeated for each chunk, and groups within a part need no other shuffle
    each = sent.repartition(*home).select(*home, "doc_b", "src_seg", "packed", F.explode("chunks").alias("chunk"))
    each = each.select(*home, "doc_b", "src_seg", "packed", "chunk.*")

    def side(k: int) -> Column:
        parts = F.collect_list(F.when(F.col("side") == k, F.struct("src_seg", "packed")))
        return arrays.let(F.array_join(F.transform(F.sort_array(parts), lambda s: s["packed"]), ""), unpack)

    sides = each.groupBy("epoch", "doc_id", "seg_no", "part").agg(
        F.max("random_next").alias("random_next"), F.max("doc_b").alias("doc_b"), side(0).alias("tokens_a"), side(1).alias("tokens_b"))
    filled = {
        c: F.when(F.size(c) == 0, F.array(F.lit(EMPTY_SIDE))).otherwise(F.col(c)) for c in ("tokens_a", "tokens_b")
    }
    out = sides.drop("part").withColumns(filled)
    return out if pairs else out.withColumn("doc_b", F.lit(None).cast("long"))


def _draw_sides(plan: DataFrame, positions: DataFrame, seed: int, most: int, block: int) -> DataFrame:
    """Where the foreign second side of a chunk comes from, and how much of it is wanted."""
    key = ["epoch", "doc_id", "seg_no"]
    row = [F.col(k) for k in key]
    docs = materialize(doc_lengths(positions), "docs")
    foreign = plan.where("random_next").select(*key, "a_end", "before", "target")
    after = positions.select(
        "doc_id", (F.col("seg_no") + 1).alias("a_end"), (F.col("before") + F.col("n_tok")).alias("_after")
    )
    sized = foreign.join(after, ["doc_id", "a_end"]).withColumn(
        "want", F.col("target") - (F.col("_after") - F.col("before"))
    )
    drawn = sample_other_doc(sized.select(*key, "before", "want"), docs, [seed, "doc", *row])
    placed = drawn.withColumn("start", below(F.col("n_segs_b"), seed, "start", *row))
    # the longest a second side can get does not depend on the chunk, so it is one lookup per segment
    reach = _chunk_ends(positions, most, block, F.lit(most).cast("long"), 1).select(
        F.col("doc_id").alias("doc_b"), F.col("seg_no").alias("start"), F.col("before").alias("from"),
        F.col("seg_end").alias("start_end"),
    )
    return placed.join(reach, ["doc_b", "start"]).select(*key, "before", "want", "doc_b", "start", "from", "start_end")


def assemble_pair(df: DataFrame, keys: Sequence[str], seed: int, max_seq_len: int = 128) -> DataFrame:
    """Truncate both sides and lay them out: adds tokens and segment_ids."""
    row = [F.col(k) for k in keys]
    left_a, left_b = arrays.pair_lengths(F.size("tokens_a"), F.size("tokens_b"), max_seq_len - 3)
    cut = df.withColumns({"_la": left_a, "_lb": left_b}).withColumns({
        "_a": arrays.truncate_random(F.col("tokens_a"), F.col("_la"), seed, "trim", "a", *row),
        "_b": arrays.truncate_random(F.col("tokens_b"), F.col("_lb"), seed, "trim", "b", *row),
    })
    sep = F.array(F.lit(SEP))
    return cut.withColumns({
        "tokens": F.concat(F.array(F.lit(CLS)), "_a", sep, "_b", sep),
        "segment_ids": F.concat(arrays.repeat(0, F.size("_a") + 2), arrays.repeat(1, F.size("_b") + 1)),
    }).drop("_la", "_lb", "_a", "_b", "tokens_a", "tokens_b")


def mask_tokens(df: DataFrame, keys: Sequence[str], vocab: DataFrame, seed: int, prob: float = 0.0,
                max_predictions: int = 20, whole_word: bool = False) -> DataFrame:
    """Choose positions and hide them: rewrites tokens, adds masked_lm_positions and masked_lm_labels.

    ``n = min(max_predictions, max(1, round(len * prob)))`` tokens are chosen, so one
    even at probability 0. Of these 80 % become the mask token, 10 % stay, 10 %
    become a random token. With ``whole_word`` continuation pieces are chosen with
    their word, and a word that would exceed ``n`` is passed over.

    A random token is drawn as its place in the id order of the vocabulary. A small
    vocabulary is looked up in the rows; with a larger one, of any size, only the
    positions that need a token are joined. ``keys`` identify a row.
    """
    row = [F.col(k) for k in keys]
    places = dense_index(vocab.select("token", "id"), ["id"], "_place").select("_place", F.col("token").alias("_word"))
    size = places.count()
    tokens = F.col("tokens")
    # Python and numpy round halves to even
    n = F.least(
        F.lit(max_predictions), F.greatest(F.lit(1), F.bround(F.size(tokens) * F.lit(float(prob))).cast("int"))
    )
    small = fits(places)
    mask = masker(seed, (CLS, SEP), MASK, size, places if small else None, whole_word)
    found = df.withColumn("_m", mask(keyed(row), tokens, n))
    if not small:
        found = materialize(found, "chosen")
        drawn = found.select(*keys, F.explode(F.arrays_zip("_m.swapped", "_m.places")).alias("_s"))
        drawn = drawn.select(*keys, F.col("_s.swapped").alias("_i"), F.col("_s.places").alias("_place"))
        # places are drawn evenly, so that none is hot; a row has at most max_predictions of them
        words = drawn.join(places, "_place").groupBy(*keys).agg(
            F.map_from_entries(F.collect_set(F.struct("_i", "_word"))).alias("_swaps"))
        found = found.join(words, list(keys), "left")
    masked = F.col("_m.tokens")
    if not small:
        swapped = F.transform(masked, lambda t, i: F.coalesce(F.try_element_at("_swaps", i), t))
        masked = F.when(F.col("_swaps").isNull(), masked).otherwise(swapped)
    out = found.withColumns({
        "tokens": masked, "masked_lm_positions": F.col("_m.masked_lm_positions"), "masked_lm_labels": F.col("_m.masked_lm_labels")})
    return out.select(*df.columns, "masked_lm_positions", "masked_lm_labels")


def mask_fixed_pattern(df: DataFrame, seed: int, length: int, mask_id: int, special: Sequence[int],
                       prob: float = 0.15, ids: str = "input_ids") -> DataFrame:
    """The same random positions for every row: hides them and keeps the whole sequence as labels."""
    pattern = F.array(*[u(seed, i) < prob for i in range(length)])  # constant, folded once

    def hide(x: Column, i: Column) -> Column:
        return F.when(F.element_at(pattern, i + 1) & ~x.isin(list(special)), F.lit(mask_id)).otherwise(x)

    return df.withColumn("labels", F.col(ids)).withColumn(ids, F.transform(ids, hide))


def generate_epochs(segments: DataFrame, vocab: DataFrame, seed: int, epochs: int = 3, max_seq_len: int = 128,
                    short_prob: float = 0.1, prob: float = 0.0, max_predictions: int = 20, whole_word: bool = False,
                    one_seq: bool = False) -> DataFrame:
    """All instances of all epochs: epoch, doc_id, seg_no and the instance columns."""
    key = ["epoch", "doc_id", "seg_no"]
    pairs = make_pairs(segments, seed, epochs, max_seq_len, short_prob, pairs=not one_seq)
    laid_out = assemble_pair(pairs, key, seed, max_seq_len)
    masked = mask_tokens(laid_out, key, vocab, seed, prob, max_predictions, whole_word)
    return masked.select(
        *key, "tokens", "segment_ids", F.col("random_next").alias("is_random_next"), "masked_lm_positions",
        "masked_lm_labels",
    )


def full_batches(df: DataFrame, batch: int, seed: int, keys: Sequence[str], epoch: str = "epoch") -> DataFrame:
    """Shuffle each epoch into batches and drop its last incomplete one: adds batch_no."""
    drawn = df.withColumn("_u", u(seed, F.col(epoch), *[F.col(k) for k in keys]))
    placed = dense_index(drawn, [epoch, "_u", *keys], "_i")
    counts = placed.groupBy(epoch).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    rank = F.col("_i") - F.col("_first")
    joined = placed.join(F.broadcast(counts), epoch)  # one row per epoch
    kept = joined.where(rank < F.floor(F.col("_n") / batch) * batch)
    return kept.withColumn("batch_no", F.floor(rank / batch).cast("long")).drop("_u", "_i", "_n", "_first")


def instance_metrics(df: DataFrame, max_seq_len: int, epoch: str = "epoch") -> DataFrame:
    """Examples per generated epoch, with the sequence length."""
    return df.groupBy(epoch).agg(F.count(F.lit(1)).alias("num_training_examples")).withColumn(
        "max_seq_len", F.lit(max_seq_len)
    )


def epoch_schedule(metrics: DataFrame, requested: int) -> DataFrame:
    """Which generated epoch each requested epoch reads, when there are fewer: epoch, data_epoch, examples."""
    available = metrics.select(F.count(F.lit(1))).first()[0]
    if available == 0:
        raise ValueError("no generated epochs were found")
    wanted = metrics.sparkSession.range(requested).select(
        F.col("id").cast("int").alias("epoch"), (F.col("id") % available).cast("int").alias("data_epoch")
    )
    per_epoch = metrics.select(F.col("epoch").alias("data_epoch"), "num_training_examples")
    return wanted.join(F.broadcast(per_epoch), "data_epoch")  # one row per epoch
