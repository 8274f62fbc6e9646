"""Exact top-k search by block-at-a-time pruning.

Vectors become whole numbers, floor(256 x) of each component; terms are the
components. Candidates are dealt into document ranges at quantiles of vec_id, and
each range is cut into blocks of BLOCK neighbouring ids that keep a forward index
(one matrix) and the maximum and minimum of each term. For every query, the blocks
of a range are ordered by their bound, the sum over terms of the larger of
query x maximum and query x minimum, and scored until the next bound is below the
query's kth score; bounds equal to it are still scored, for ties. First each query
searches one range, the one its own id lies in, which sets its kth score from below;
then ranges and chunks of queries meet in pairs, with that score as the floor from
which blocks are pruned everywhere. A task holds RANGE candidates and CHUNK queries
at most, whatever the size of the table; the best k of each pair are merged.

Vectors that are null or hold null or non-finite components take no part, nor do
rows without vec_id. Vectors of other lengths are padded with 0. Candidates are
every row with another vec_id than the query's; repeated rows each count. Where a
vec_id stands on several rows, each distinct vector of it is a query of its own
and the best k over all of them are returned. Arithmetic is exact: 32-bit floats
where every sum is below 2^24, 64-bit where below 2^53, else Python integers;
scores beyond 64 bits are returned as the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SCALE, EVERY, K = 256, 50, 5
BLOCK, RANGE, CHUNK = 256, 16_384, 4_096


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and v, an array of whole doubles; rows that take no part are gone."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    out = np.zeros((n, width))
    flat, at = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
    if n and (at == at[0]).all():
        out[:, : at[0]] = flat.reshape(n, -1)
    else:
        start = 0
        for i, k in enumerate(at):
            out[i, :k] = flat[start : start + k]
            start += k
    return out


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def search(ids: np.ndarray, docs: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, vec_id, score) of the best k of each query, by score, then smaller vec_id, of those that reach its floor.

    ``scored`` gets the number of blocks that each query's bounds let through.
    """
    kind = _kind(docs, queries)
    if kind is object:
        docs, queries = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (docs, queries))
    else:
        docs, queries = docs.astype(kind), queries.astype(kind)
    order = np.argsort(ids, kind="stable")
    ids, docs = ids[order], docs[order]
    cuts = range(0, len(ids), BLOCK)
    blocks = [(ids[c : c + BLOCK], docs[c : c + BLOCK]) for c in cuts]
    high, low = (np.stack([f(b, axis=0) for _, b in blocks]) for f in (np.max, np.min))
    zero = queries * 0
    bounds = np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T
    ranked = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    best_s, best_i = np.full((n, k), -np.inf if kind is not object else float("-inf"), kind if kind is object else np.float64), np.full((n, k), np.iinfo(np.int64).max)
    floor = np.full(n, float("-inf"), best_s.dtype) if floors is None else floors.astype(best_s.dtype)
    live = np.arange(n)
    for step in range(len(blocks)):
        now = ranked[live, step]
        still = bounds[live, now] >= np.maximum(best_s[live, k - 1], floor[live])  # bounds fall from step to step
        live, now = live[still], now[still]
        if not len(live):
            break
        if scored is not None:
            scored.append(len(live))
        for b in np.unique(now):
            qs = live[now == b]
            bid, vec = blocks[b]
            s = queries[qs] @ vec.T
            s = s.astype(best_s.dtype)
            s[bid[None, :] == qids[qs][:, None]] = -np.inf
            if kind is not object and len(bid) > 4 * k:
                least = np.partition(s, len(bid) - k, axis=1)[:, len(bid) - k]
                keep = (s >= np.maximum(least, best_s[qs, k - 1])[:, None]).any(axis=0)
                s, bid = s[:, keep], bid[keep]
            all_s = np.concatenate([best_s[qs], s], axis=1)
            all_i = np.concatenate([best_i[qs], np.broadcast_to(bid, (len(qs), len(bid)))], axis=1)
            top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best_s[qs], best_i[qs] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
    q, r = np.nonzero((best_s.astype(float) > -np.inf) & (best_s >= floor[:, None]))
    return q, best_i[q, r], best_s[q, r]


def _clipped(x) -> int:
    return max(-(2**63), min(2**63 - 1, int(x)))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates (vec_id, v) of each query (vec_id, v)."""
    facts = candidates.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n_queries = queries.count()
    width = max(facts["d"] or 0, 1)
    ranges, chunks = max(1, -(-facts["n"] // RANGE)), max(1, -(-n_queries // CHUNK))
    cuts = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        cuts = candidates.agg(F.percentile_approx("vec_id", at, max(10_000, 20 * ranges)).alias("c")).first()["c"]
    lit = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>")

    def n_range(column: str) -> Column:
        return F.size(F.filter(lit, lambda c: c < F.col(column))) if cuts else F.lit(0)

    ranged = candidates.withColumn("range", n_range("vec_id"))
    # columns of their own: the queries may come from the same table
    queries = queries.select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"))

    def met(left: pa.Table, right: pa.Table, floors: np.ndarray | None) -> tuple:
        return search(left["vec_id"].to_numpy(), _matrix(left["v"], width), right["q_id"].to_numpy(), _matrix(right["q_v"], width), k, floors)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each query of this range with its kth score here, if there are k."""
        kth = [None] * right.num_rows
        if left.num_rows and right.num_rows:
            q, _, s = met(left, right, None)
            held = np.bincount(q, minlength=right.num_rows)
            ends = np.cumsum(held) - 1
            kth = [_clipped(s[e]) if n == k else None for n, e in zip(held, ends)]
        return pa.table({"q_id": right["q_id"], "q_v": right["q_v"], "floor": pa.array(kth, pa.int64())})

    with_floor = "q_id long, q_v array<double>, floor long"
    if ranges > 1:
        floored = ranged.groupBy("range").cogroup(queries.withColumn("range", n_range("q_id")).groupBy("range")).applyInArrow(first, with_floor)
    else:
        floored = queries.withColumn("floor", F.lit(None).cast("long"))
    docs = ranged.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asks = floored.withColumn("chunk", F.pmod(F.xxhash64("q_id"), F.lit(chunks)).cast("int")).withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        floors = np.array([float("-inf") if x is None else x for x in right["floor"].to_pylist()], object)
        q, i, s = met(left, right, floors)
        return pa.table({"query_id": pa.array(right["q_id"].to_numpy()[q], pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array([_clipped(x) for x in s], pa.int64())})

    found = docs.groupBy("range", "chunk").cogroup(asks.groupBy("range", "chunk")).applyInArrow(pair, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole(table(spark, sf_dir, "embeddings"))
    queries = vectors.where(F.col("vec_id") % EVERY == 0).dropDuplicates(["vec_id", "v"])
    return top_k(vectors, queries)


OP9_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
