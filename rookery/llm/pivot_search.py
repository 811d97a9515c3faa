"""Exact top-k inner products by pivot-table elimination.

Vectors of integers are lifted to one more dimension in which all have the
same length M: ``v -> (v, sqrt(M^2 - |v|^2))`` for candidates, ``q -> (q, 0)``
for queries.  Then ``|q - v|^2 = |q|^2 + M^2 - 2 q.v``, so the largest inner
product is the nearest neighbour, and the triangle inequality over a table
of distances to pivots, ``max_p |d(q, p) - d(v, p)|``, bounds each distance
from below.  A query's candidates are taken in the order of this bound, and
the search stops when no bound can beat the k-th score found.

Both sides are dealt into blocks by hash; a cell of the grid meets one block
of queries with one of candidates, keeps k rows for each query, and the
k best over the cells follow.  A row is written once for each block of the
other side, so large tables have large blocks: of ``block`` rows until there
are ``BLOCKS``, then fewer and larger ones up to ``CELL_NUMBERS`` components.
The pivots, a documented bounded sample, only
decide how much is skipped, never the result.

Edge cases: a vector that is null or holds a null or non-finite component,
and a row with a null id, take no part.  Vectors of different lengths are
not compared.  A query gets no row with its own id; of repeated query ids
the least vector asks; repeated candidate rows count each.  An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.common import map_rows, stored

PIVOTS = 24
PIVOT_SAMPLE = 2_000
#: Blocks of candidates and of queries before they grow, and the most components a block grows to.
BLOCKS, CELL_NUMBERS = (64, 8), (4_194_304, 1_048_576)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, dim, v``: floor(scale * x) of each usable vector, as integers."""
    x = F.col(vector_col)
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return vectors.filter(F.col(id_col).isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), whole.alias("v"))


def blocks_of(n: int, dim: int, size: int, side: int) -> int:
    """How many blocks ``n`` rows of ``dim`` components are dealt into; ``side`` is 0 for candidates, 1 for queries."""
    largest = max(size, CELL_NUMBERS[side] // max(1, dim))
    return max(1, -(-n // largest), min(-(-n // size), BLOCKS[side]))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first points of a sample: each next one is farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _lift(v: np.ndarray, top: float, query: bool) -> np.ndarray:
    last = np.zeros(len(v)) if query else np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0))
    return np.concatenate([v, last[:, None]], axis=1)


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * v @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def search_block(q_ids: np.ndarray, q: np.ndarray, dq: np.ndarray, ids: np.ndarray, v: np.ndarray, dv: np.ndarray, top: float, k: int, step: int = 512) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query ``(place, candidate places, scores)`` of its k best, ties to smaller ids."""
    for i in range(len(q)):
        bound = np.zeros(len(v))
        for p in range(dq.shape[1]):
            np.maximum(bound, np.abs(dv[:, p] - dq[i, p]), out=bound)
        # an upper bound of the score; a hundredth is far beyond the rounding of the distances
        best = (float(q[i] @ q[i]) + top - np.maximum(bound - 1e-3, 0.0) ** 2) / 2 + 0.01
        mine = ids == q_ids[i]
        if mine.any():
            best[mine] = -np.inf
        kept = np.zeros(0, np.int64)
        scores = np.zeros(0)
        at, size, order, waiting = 0, step, np.zeros(0, np.int64), np.ones(len(v), bool)
        while waiting.any():
            if at + size > len(order):
                # only what is not yet scored is put in order: equal bounds lie differently in another order
                rest = np.flatnonzero(waiting)
                reach = min(len(rest), 4 * size)
                order = rest[np.argpartition(-best[rest], reach - 1)[:reach]] if reach < len(rest) else rest
                order, at = order[np.argsort(-best[order], kind="stable")], 0
            if len(scores) >= k and best[order[at]] < scores[-1]:
                break  # no later candidate can reach the k-th score
            pick = order[at : at + size]
            waiting[pick] = False
            pick = pick[best[pick] > -np.inf]
            kept, scores = np.concatenate([kept, pick]), np.concatenate([scores, v[pick] @ q[i]])
            first = np.lexsort((ids[kept], -scores))[:k]
            kept, scores = kept[first], scores[first]
            at, size = at + size, size * 2
        yield i, kept, scores


def top_k(spark: SparkSession, vectors: DataFrame, *, k: int = 5, scale: int = 256, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 2048, block: int = 16_384, pivots: int = PIVOTS, pivot_sample: int = PIVOT_SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every query row; ``is_query`` is a condition on column ``id``."""
    rows = quantised(vectors, id_col, vector_col, scale)
    is_query = F.col("id") % 50 == 0 if is_query is None else is_query
    length = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    about = rows.groupBy("dim").agg(F.max(length).alias("top"), F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()  # a row for each length of vectors
    tops = {r["dim"]: float(r["top"]) for r in about}
    counts = {r["dim"]: (blocks_of(r["q"], r["dim"], query_block, 1), blocks_of(r["n"], r["dim"], block, 0)) for r in about}
    if not about:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tables: dict[int, np.ndarray] = {}
    for r in about:
        sample = rows.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("id"), "id").limit(pivot_sample).collect()
        lifted = _lift(np.array([s["v"] for s in sample], np.float64), tops[r["dim"]], False)
        tables[r["dim"]] = choose_pivots(lifted, pivots)

    def measured(query: bool):
        def run(batch):
            dims, flat = batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().astype(np.float64)
            ends, out = np.cumsum(dims), [b""] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = flat[(ends[at] - dim)[:, None] + np.arange(dim)[None, :]]
                for i, d in zip(at, _distances(_lift(v, tops[int(dim)], query), tables[int(dim)])):
                    out[i] = d.tobytes()
            return [batch.column(0), batch.column(1), batch.column(2), out]

        return run

    def by_dim(which: int):
        return F.element_at(F.create_map(*[x for d, c in counts.items() for x in (F.lit(d), F.lit(c[which]).cast("long"))]), F.col("dim"))

    schema = "id long, dim int, v array<bigint>, d binary"
    queries = rows.filter(is_query).groupBy("id", "dim").agg(F.min("v").alias("v"))
    q_side = map_rows(queries, schema, measured(True)).withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), by_dim(0))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), by_dim(1) - 1)))
    c_side = map_rows(rows, schema, measured(False)).withColumn("cb", F.pmod(F.xxhash64("id", "v", F.lit(2)), by_dim(1))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), by_dim(0) - 1)))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        def side(t: pa.Table):
            dim = t.column("dim")[0].as_py()
            flat = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            return dim, t.column("id").to_numpy(), flat, np.frombuffer(b"".join(t.column("d").to_pylist()), np.float64).reshape(len(flat), -1)

        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            dim, q_ids, q, dq = side(left)
            _, ids, v, dv = side(right)
            for i, kept, scores in search_block(q_ids, q, dq, ids, v, dv, tops[dim], k):
                out += [(int(q_ids[i]), int(ids[c]), int(s)) for c, s in zip(kept, scores)]
        ids_, vec, score = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(ids_, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})

    found = q_side.groupBy("dim", "qb", "cb").cogroup(c_side.groupBy("dim", "qb", "cb")).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return stored(spark, found, "found").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
