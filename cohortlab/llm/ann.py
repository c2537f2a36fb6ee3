"""Nearest neighbours by robust-pruned directed graphs, one for each shard of vectors.

Equal vectors are one node, which keeps the smallest of their ids: as many as a
query can ask for, and one more for its own. Nodes are dealt into shards of about SHARD by a hash of the vector. In a
shard every node is searched for greedily in the graph so far; of the vectors
met, the nearest is kept and those much nearer to it than to the searched one
are dropped, again and again, which leaves short and long edges. Reverse edges
are added and pruned likewise, and vectors that no edge leads to any more get one from the nearest that is reached. Queries are packed into blocks, and each block is
answered in each shard by a beam search; the results are merged by distance.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part; neither do those whose length is not the most common
one (the larger on ties); rows that repeat an id are candidates one by one, and
a query leaves out every row of its own id; queries that repeat an id and vector are
answered once, and those that repeat an id with other vectors are queries of
their own; with fewer candidates than asked for, all are returned; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.scratch import materialize

SHARD = 2048
BLOCK = 256
DEGREE = 24
BEAM = 48
SEARCH_BEAM = 96
RELAX = 1.2
NEAREST = 10


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] to every b[i, j]."""
    return np.maximum((a * a).sum(-1)[:, None] + (b * b).sum(-1) - 2 * np.matmul(b, a[:, :, None])[:, :, 0], 0)


def beam_search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beams of all queries at once: ids (-1: none) and squared distances, nearest first."""
    q = len(queries)
    ids = np.tile(start, (q, 1))
    far = _squares(queries, points[ids])
    done = np.zeros(ids.shape, bool)
    seen = np.zeros((q, len(points)), bool)
    seen[:, start] = True
    line = np.arange(q)
    while True:
        open_ = np.where(done | (ids < 0), np.inf, far)
        pick = open_.argmin(axis=1)
        live = np.flatnonzero(np.isfinite(open_[line, pick]))
        if not len(live):
            return ids, far
        done[live, pick[live]] = True
        near = edges[ids[live, pick[live]]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        rows, cols = np.nonzero(fresh)
        seen[live[rows], near[rows, cols]] = True
        d = np.where(fresh, _squares(queries[live], points[near]), np.inf)
        all_ids = np.concatenate((ids[live], np.where(fresh, near, -1)), axis=1)
        all_far = np.concatenate((far[live], d), axis=1)
        all_done = np.concatenate((done[live], np.zeros(near.shape, bool)), axis=1)
        if ids.shape[1] < beam:  # the beam fills up first
            pad = beam - ids.shape[1]
            ids = np.concatenate((ids, np.full((q, pad), -1, ids.dtype)), axis=1)
            far = np.concatenate((far, np.full((q, pad), np.inf)), axis=1)
            done = np.concatenate((done, np.zeros((q, pad), bool)), axis=1)
        width = min(beam, all_far.shape[1])
        order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        ids[live, :width] = np.take_along_axis(all_ids, order, 1)
        far[live, :width] = np.take_along_axis(all_far, order, 1)
        done[live, :width] = np.take_along_axis(all_done, order, 1)


def robust_prune(points: np.ndarray, own: np.ndarray, ids: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each own[i] at most ``degree`` diverse neighbours out of ids[i] (-1: none)."""
    ids = np.where(ids == own[:, None], -1, ids)
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    near = points[ids]
    far = np.where(ids < 0, np.inf, _squares(points[own], near))
    length = (near * near).sum(-1)
    between = length[:, :, None] + length[:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1))
    out = np.full((len(own), degree), -1, np.int64)
    line = np.arange(len(own))
    for k in range(degree):
        pick = far.argmin(axis=1)
        live = np.isfinite(far[line, pick])
        if not live.any():
            break
        out[live, k] = ids[live, pick[live]]
        drop = relax * relax * between[line, pick] <= far
        drop[line, pick] = True
        far[drop & live[:, None]] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rows x degree, -1: none) and the entry points."""
    n = len(points)
    rng = np.random.default_rng(5)
    middle = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    start = np.unique(np.append(rng.integers(0, n, min(n, 8)), middle))
    edges = rng.integers(0, n, (n, degree))
    for alpha in (1.0, relax):
        for part in np.array_split(rng.permutation(n), max(1, n // 256)):
            met, _ = beam_search(points, edges, points[part], start, beam)
            edges[part] = robust_prune(points, part, np.concatenate((met, edges[part]), axis=1), degree, alpha)
            back = edges[part]
            source, target = np.repeat(part, degree)[back.ravel() >= 0], back.ravel()[back.ravel() >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            while len(target):  # at most ``degree`` new edges of a vector at a time
                turn = np.arange(len(target)) - np.searchsorted(target, target)
                now = turn < degree
                nodes = np.unique(target[now])
                added = np.full((len(nodes), degree), -1, np.int64)
                added[np.searchsorted(nodes, target[now]), turn[now]] = source[now]
                edges[nodes] = robust_prune(points, nodes, np.concatenate((edges[nodes], added), axis=1), degree, alpha)
                source, target = source[~now], target[~now]
    return reachable(points, edges, start), start


def reachable(points: np.ndarray, edges: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``edges`` with further ones, so that every vector can be reached from the entry points.

    A vector that pruning has cut off gets an edge from the nearest one that is reached.
    """
    while True:
        seen = np.zeros(len(points), bool)
        seen[start] = True
        front = start
        while len(front):
            near = np.unique(edges[front])
            front = near[(near >= 0) & ~seen[near]]
            seen[front] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return edges
        known = np.flatnonzero(seen)
        source = np.concatenate([known[_squares(points[part], np.broadcast_to(points[known], (len(part), *points[known].shape))).argmin(axis=1)]
                                 for part in np.array_split(lost, -(-len(lost) // 64))])
        order = np.argsort(source, kind="stable")
        source, lost = source[order], lost[order]
        turn = np.arange(len(source)) - np.searchsorted(source, source)
        more = np.full((len(points), turn.max() + 1), -1, edges.dtype)
        more[source, turn] = lost
        edges = np.concatenate((edges, more), axis=1)


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _graph(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["k1", "k2"], kind="stable")
    points = np.stack(rows["v"].to_list()).astype(np.float64)
    edges, start = build_graph(points)
    ids = [np.asarray(x, np.int64) for x in rows["ids"]]
    return pd.DataFrame({
        "shard": [rows["shard"].iloc[0]], "ids": [_pack(np.concatenate(ids))], "ends": [_pack(np.cumsum([len(x) for x in ids]))],
        "points": [_pack(points)], "edges": [_pack(edges.astype(np.int32))], "start": [_pack(start.astype(np.int64))]})


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    points = np.stack(rows["v"].to_list()).astype(np.float64)
    return pd.DataFrame({"q_ids": [_pack(rows["vec_id"].to_numpy(np.int64))], "q_keys": [_pack(rows["k1"].to_numpy(np.int64))],
                         "q_points": [_pack(points)]})


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            get = {c: batch.column(c)[row].as_buffer() for c in ("ids", "ends", "points", "edges", "start", "q_ids", "q_keys", "q_points")}
            ids, ends, q_ids, q_keys = (np.frombuffer(get[c], np.int64) for c in ("ids", "ends", "q_ids", "q_keys"))
            points = np.frombuffer(get["points"]).reshape(len(ends), -1)
            queries = np.frombuffer(get["q_points"]).reshape(len(q_ids), -1)
            edges = np.frombuffer(get["edges"], np.int32).reshape(len(ends), -1)
            begins = ends - np.diff(ends, prepend=0)
            met, _ = beam_search(points, edges, queries, np.frombuffer(get["start"], np.int64), SEARCH_BEAM)
            out: list[list] = [[], [], [], []]
            for i, found in enumerate(met):
                found = found[found >= 0]
                score = np.sqrt(((points[found] - queries[i]) ** 2).sum(axis=1))
                # every node with all the ids that it keeps
                count = ends[found] - begins[found]
                at = np.repeat(begins[found] - np.cumsum(count) + count, count) + np.arange(count.sum())
                of, far = ids[at], np.repeat(score, count)
                of, far = of[of != q_ids[i]], far[of != q_ids[i]]
                best = np.lexsort((of, far))[:NEAREST]
                for column, values in zip(out, (np.full(len(best), q_ids[i]), np.full(len(best), q_keys[i]), of[best], far[best])):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "q_key", "vec_id", "score"])


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and ``v`` (doubles) of the rows that take part."""
    # adding zero makes one zero of both
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + 0.0)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


_KEYS = ["k1", "k2"]


def _keyed(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))


def distinct_nodes(vectors: DataFrame, keep: int = NEAREST + 1) -> DataFrame:
    """k1, k2, v and the ``keep`` smallest ids of every distinct vector."""
    # limited before the shuffle: a vector that most rows share sends a few rows for each task
    place = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("vec_id"))
    few = _keyed(vectors).withColumn("place", place).where(F.col("place") <= keep)
    return few.groupBy(*_KEYS).agg(F.first("v").alias("v"), F.collect_list("vec_id").alias("ids"))


def search(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the NEAREST found for each query; both tables as from ``usable``."""
    nodes = materialize(distinct_nodes(vectors), "nodes")
    shards = max(1, -(-nodes.count() // SHARD))
    dealt = nodes.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))
    graphs = materialize(
        dealt.groupBy("shard").applyInPandas(_graph, "shard int, ids binary, ends binary, points binary, edges binary, start binary"), "graphs")
    asked = materialize(_keyed(queries).dropDuplicates(["vec_id", *_KEYS]), "queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    packed = materialize(
        asked.groupBy(F.pmod(F.xxhash64("vec_id", "k1"), F.lit(blocks)).alias("block"))
        .applyInPandas(_block, "q_ids binary, q_keys binary, q_points binary"), "query-blocks")
    # every block meets every shard: the stated queries against all rows
    tasks = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = tasks.join(graphs.hint("shuffle_hash"), "shard").mapInArrow(_answers, "query_id long, q_key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_key").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= NEAREST).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
