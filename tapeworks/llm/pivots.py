"""Exact top-k search by inner product with a pivot table (operator 1).

Every vector's distances to PIVOTS vectors and to the origin are computed once and stored. By the triangle inequality the
largest difference between a query's and a candidate's row of that table is a lower bound of their distance, hence an
upper bound of their inner product (the origin's column alone is the bound by lengths). A task takes a block of queries
and a block of candidates, evaluates each query's candidates in the order of the bound (then of the id), and stops at the
first whose bound can't enter the best k. Where the bounds eliminate little (vectors spread evenly in many dimensions) it stops
reading pivots early and takes the remaining products together. The best k of the blocks are merged by query.

Queries are a stated set against all rows, in blocks: a vector is sent once for each block of queries. Nothing is broadcast
but the pivots.

Edge cases: a vector that is NULL, holds a NULL or non-finite component, or has a NULL id takes no part; a vector shorter
than the longest counts as ending in zeros, an empty one as zero; rows that repeat an id and its
vector count once, further vectors of an id are candidates and queries of their own (the best k of a query id are those of
all its vectors, as in the SQL; the SQL also repeats equal rows); equal scores go to the smaller id; an empty table gives no rows; other columns are ignored.
Scores are exact while every inner product stays below 2 ** 53 in size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.shared import stored

PIVOTS = 24
QUERY_BLOCK, ROW_BLOCK, TOGETHER = 2048, 8192, 64
STEP, WORTH = 6, 0.1  # pivots in a step; the share of the pairs left that a step must eliminate for the next one to be taken
DENSE = 0.2  # share of pairs left above which products are taken together
SAMPLE = 2000  # rows from which the pivots are picked


def grid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v): components floor(scale * x) of the vectors that take part, once for equal ids and vectors."""
    e = F.col(embedding)
    usable = e.isNotNull() & F.col(vec_id).isNotNull() & F.forall(e, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("_e"), whole.alias("v"))
    return rows.groupBy("vec_id", "_e").agg(F.first("v").alias("v")).select("vec_id", "v")


def matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows that end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), width))
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def spread_out(x: np.ndarray, n: int) -> np.ndarray:
    """The origin, and rows each as far as can be from those before."""
    out = [np.zeros(x.shape[1])]
    far = np.full(len(x), np.inf)
    while len(out) <= n and len(x):
        far = np.minimum(far, distances(x, out[-1][None])[:, 0])
        if far.max() <= 0:
            break
        out.append(x[int(far.argmax())])
    return np.array(out)


def _rows(pivots: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = distances(matrix(batch.column("v"), pivots.shape[1]), pivots)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), flat], names=["vec_id", "v", "d"])


def search_block(k: int, q_id: np.ndarray, q: np.ndarray, q_d: np.ndarray, ids: np.ndarray, x: np.ndarray, x_d: np.ndarray) -> tuple[list, list, list, int]:
    """The best k of each query among the rows: (query ids, ids, scores) and the number of products that were evaluated.

    Bounds by a few pivots name each query's most promising rows, whose products give it a floor; further pivots lower the bounds as
    long as each step still eliminates enough of the pairs. Where few are left, a query takes its candidates in the order of the
    bound; where most are, the rest of the products of all queries are one matrix product."""
    order = np.argsort(ids)
    ids, x, x_d = ids[order], x[order], x_d[order]
    x2, seen = (x * x).sum(1), 0
    out_q, out_i, out_s = [], [], []
    for a in range(0, len(q), TOGETHER):
        part, some = q_d[a : a + TOGETHER], q[a : a + TOGETHER]
        both = (some * some).sum(1)[:, None] + x2
        far, most, floor, alive, done = np.zeros(both.shape), None, np.full(len(part), -np.inf), 1.0, 0
        own = ids == q_id[a : a + TOGETHER, None]
        while done < part.shape[1]:
            for p in range(done, min(done + STEP, part.shape[1])):
                np.maximum(far, np.abs(part[:, p : p + 1] - x_d[:, p]), out=far)
            done += STEP
            most = np.floor((both - np.maximum(far - 1e-6, 0) ** 2) / 2 + 1e-9 * both + 1e-6)
            most[own] = -np.inf
            if done == STEP and len(ids) > 4 * k:
                first = np.argpartition(-most, 2 * k, axis=1)[:, : 2 * k]
                got = np.einsum("qd,qkd->qk", some, x[first])
                got[np.take_along_axis(own, first, 1)] = -np.inf
                floor, seen = np.partition(got, -k, axis=1)[:, -k], seen + first.size
            left = float((most >= floor[:, None]).mean())
            if left > (1 - WORTH) * alive:
                break
            alive = left
        if left > DENSE:
            scores = some @ x.T
            scores[own] = -np.inf
            seen += scores.size
        for b in range(len(part)):
            if left > DENSE:
                s = scores[b]
                kth = max(np.partition(s, -k)[-k] if len(s) > k else -np.inf, np.finfo(float).min)
                best_i, best_s = ids[s >= kth], s[s >= kth]
                keep = np.lexsort((best_i, -best_s))[:k]
                best_i, best_s = best_i[keep], best_s[keep]
            else:
                turn = np.flatnonzero(most[b] >= max(floor[b], np.finfo(float).min))
                turn = turn[np.argsort(-most[b][turn], kind="stable")]  # ids ascend within equal bounds
                best_i, best_s, at, step = ids[:0], x2[:0], 0, 128
                while at < len(turn):
                    first = turn[at]
                    if len(best_i) == k and (most[b, first] < best_s[-1] or (most[b, first] == best_s[-1] and ids[first] > best_i[-1])):
                        break
                    take = turn[at : at + step]
                    seen += len(take)
                    best_s = np.concatenate([best_s, x[take] @ some[b]])
                    best_i = np.concatenate([best_i, ids[take]])
                    keep = np.lexsort((best_i, -best_s))[:k]
                    best_i, best_s = best_i[keep], best_s[keep]
                    at, step = at + step, 2 * step
            out_q.append(np.full(len(best_i), q_id[a + b]))
            out_i.append(best_i)
            out_s.append(best_s)
    return out_q, out_i, out_s, seen


def _search(k: int, width: int, queries: pa.Table, rows: pa.Table) -> pa.Table:
    if not (queries.num_rows and rows.num_rows):
        return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
    side = [(t.column("vec_id").to_numpy(), matrix(t.column("v"), width), matrix(t.column("d"), len(t.column("d")[0]))) for t in (queries, rows)]
    q, i, s, _ = search_block(k, *side[0], *side[1])
    return pa.table({"query_id": np.concatenate(q), "vec_id": np.concatenate(i), "score": np.concatenate(s).astype(np.int64)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, a row for which `is_query` (on vec_id) holds."""
    rows = stored(grid(vectors, vec_id, embedding, scale))
    n, m, width = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    width = max(width or 0, 1)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toArrow()
    pivots = spread_out(matrix(sample.column("v"), width) if sample.num_rows else np.zeros((0, width)), PIVOTS)
    table = stored(rows.mapInArrow(partial(_rows, pivots), "vec_id long, v array<double>, d array<double>"))
    q_blocks, blocks = -(-m // QUERY_BLOCK) or 1, -(-n // ROW_BLOCK) or 1
    block = lambda count: F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = table.where(is_query).select("vec_id", "v", "d", block(q_blocks).alias("qb"), every(blocks).alias("rb"))
    others = table.select("vec_id", "v", "d", block(blocks).alias("rb"), every(q_blocks).alias("qb"))
    found = queries.groupBy("qb", "rb").cogroup(others.groupBy("qb", "rb")).applyInArrow(lambda q, r: _search(k, width, q, r), "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows of each block
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with g as (select vec_id, [floor(64 * cast(x as double)) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as (select q.vec_id as query_id, r.vec_id, cast(list_dot_product(q.v, r.v) as bigint) as score from g q join g r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from p
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
