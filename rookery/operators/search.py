"""Exact nearest neighbours: squared L2, cosine and Hamming.

Queries of a checked size are broadcast and meet the rows in one pass, each
task keeping its k best; larger query sets are met block by block on a grid.
Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "hamming")
#: Queries beyond this many are searched on the grid.
BROADCAST_QUERIES = 256


def squared_l2(a: Column, b: Column) -> Column:
    """In doubles, without the root."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine similarity."""
    return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words, or of two words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sign_word(vector: Column) -> Column:
    """Signs of up to 64 components as one word, first component highest."""
    return F.aggregate(vector, F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR((x > 0).cast("bigint")))


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "hamming":
        return hamming(a, b)
    raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")


def ranked(pairs: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k nearest for each query, with ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(rows: DataFrame, queries: DataFrame, k: int = 10, *, metric: str = "l2", where: Column | str | None = None, id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query", output_fields: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, rank, id, distance`` and the output fields, for every query.

    ``where`` restricts the rows before the search.  A row equal to the query
    is not left out.
    """
    rows = rows if where is None else rows.filter(where)
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    if not few:
        return knn_grid(rows, queries, k, metric=metric, id_col=id_col, vector_col=vector_col, query_id=query_id, query_vector=query_vector, output_fields=output_fields)
    left = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("_q"))
    right = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("_v"), *[F.col(c).alias(f"_f_{c}") for c in output_fields])
    # the broadcast side is BROADCAST_QUERIES rows at most
    pairs = right.join(F.broadcast(left), F.size("_v") == F.size("_q"))
    pairs = pairs.select("query_id", "id", distance(metric, F.col("_q"), F.col("_v")).alias("distance"), *[f"_f_{c}" for c in output_fields])
    return ranked(pairs, k).select("query_id", "rank", "id", "distance", *[F.col(f"_f_{c}").alias(c) for c in output_fields])


def knn_grid(rows: DataFrame, queries: DataFrame, k: int = 10, *, metric: str = "l2", id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query", output_fields: tuple[str, ...] = (), query_block: int = 1024, block: int = 16_384) -> DataFrame:
    """As ``knn`` for any number of queries: blocks of both sides meet in cells, each by matrix products or bit counts."""
    import pyarrow as pa

    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")
    kind = "array<bigint>" if metric == "hamming" else "array<double>"
    n_q, n_r = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (rows, block)))
    # the grid knows one dimension: longer or shorter vectors are other searches
    left = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).cast(kind).alias("v"))
    left = left.withColumn("d", F.size("v")).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    right = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    right = right.withColumn("d", F.size("v")).withColumn("cb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_r)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))

    def cell(q: pa.Table, r: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if q.num_rows and r.num_rows:
            qi, ri = q.column("query_id").to_numpy(), r.column("id").to_numpy()
            qv, rv = (t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (q, r))
            rows_, cols, dist = [], [], []
            for at in range(0, len(qv), 64):
                part = qv[at : at + 64]
                if metric == "l2":
                    # products choose with room for their rounding, differences give the distance
                    d = (part * part).sum(axis=1)[:, None] + (rv * rv).sum(axis=1)[None, :] - 2 * part @ rv.T
                elif metric == "hamming":
                    d = np.zeros((len(part), len(rv)))
                    for word in range(part.shape[1]):
                        # of negative words numpy counts the bits of the absolute value
                        d += np.bitwise_count((part[:, word, None] ^ rv[None, :, word]).view(np.uint64))
                else:
                    d = 1 - part @ rv.T / np.sqrt((part * part).sum(axis=1)[:, None] * (rv * rv).sum(axis=1)[None, :])
                edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                i, j = np.nonzero(d <= (edge + 1e-9 * (1 + np.abs(edge)))[:, None])
                exact = ((part[i] - rv[j]) ** 2).sum(axis=1) if metric == "l2" else d[i, j]
                order = np.lexsort((ri[j], exact, i))
                i, j, exact = i[order], j[order], exact[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                rows_.append(qi[at + i[place < k]])
                cols.append(ri[j[place < k]])
                dist.append(exact[place < k])
            out = [np.concatenate(x) for x in (rows_, cols, dist)]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.float64())})

    found = left.groupBy("d", "qb", "cb").cogroup(right.groupBy("d", "qb", "cb")).applyInArrow(cell, "query_id long, id long, distance double")
    if metric == "hamming":
        found = found.withColumn("distance", F.col("distance").cast("int"))
    hits = ranked(found, k).select("query_id", "rank", "id", "distance")
    if output_fields:
        fields = rows.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"_f_{c}") for c in output_fields])
        hits = hits.join(fields, "id").select("query_id", "rank", "id", "distance", *[F.col(f"_f_{c}").alias(c) for c in output_fields])
    return hits


def block_pairs(rows: DataFrame, queries: DataFrame, *, id_col: str = "id", query_id: str = "query_id", query_block: int = 1024, block: int = 16_384) -> DataFrame:
    """Every query beside every row, once: blocks of both sides meet in cells, so that no side is broadcast."""
    n_q, n_r = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (rows, block)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("_qb", F.pmod(F.xxhash64(query_id), F.lit(n_q))).withColumn("_rb", every(n_r))
    right = rows.withColumn("_rb", F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(n_r))).withColumn("_qb", every(n_q))
    return right.join(left.hint("shuffle_hash"), ["_qb", "_rb"]).drop("_qb", "_rb")


def nested(hits: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, hits``: each query's hits in order, as an array of structs."""
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "distance", *fields))).alias("hits"))


def lookup_hits(hits: DataFrame, store: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits with the columns of another store of the same ids; order columns are kept."""
    more = [c for c in store.columns if c != id_col]
    return hits.join(store.select(F.col(id_col).alias("id"), *more), "id").select(*hits.columns, *more).orderBy("query_id", "rank")


def search_by_ids(rows: DataFrame, ids: list, id_col: str = "id", literal_most: int = 1000) -> DataFrame:
    """The rows with the ids; a long list becomes a semi join."""
    if len(ids) <= literal_most:
        return rows.filter(F.col(id_col).isin(list(ids))).limit(len(ids))
    wanted = rows.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    return rows.join(wanted.withColumnRenamed("id", id_col), id_col, "left_semi")


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def filter_expression(text: str) -> Column:
    """A store's boolean expression as a column: ``==``, ``&&``, ``||`` and ``in [..]`` are understood outside quotes."""
    import re

    def plain(part: str) -> str:
        part = part.replace("==", "=").replace("&&", " AND ").replace("||", " OR ")
        return re.sub(r"\bin\s*\[", " IN (", part, flags=re.I).replace("]", ")")

    pieces = re.split(r"""("[^"]*"|'[^']*')""", text)
    return F.expr("".join("'" + p[1:-1].replace("'", "\\'") + "'" if p[:1] in ("'", '"') else plain(p) for p in pieces))
