"""Exact top-k of query vectors against all rows.

Rows and queries are packed into blocks; a block of queries meets a block of rows in one kernel that returns the k best of
the block, and a window picks the best of all blocks (partial limits before the shuffle). The kernel picks candidates by a
matrix product, with room for its rounding, and sums only theirs from left to right. Ties go to the smaller ``ord``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simloom.functions.metrics import metric, unit_rows

BLOCK = 1024
#: Queries of at most this many components go to every task at once; more are dealt in groups of that size.
MOST = 1 << 23


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets))
    if len(set(size.tolist())) > 1 or column.null_count:
        raise ValueError("vectors must have one length")
    return np.asarray(column.flatten(), np.float64).reshape(len(size), -1)


def packed(df: DataFrame, id_col: str, ord_col: str, vec_col: str, prefix: str, block: int = BLOCK) -> DataFrame:
    """``df`` as blocks: binary ids, ordinals and rows."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                ids, ords = (np.asarray(part.column(k), np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids, ords, matrix(part.column(2)))], [f"{prefix}{c}" for c in ("ids", "ords", "rows")])

    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(ord_col).cast("long").alias("_ord"), F.col(vec_col).cast("array<double>").alias("_vec")).mapInArrow(run, ", ".join(f"{prefix}{c} binary" for c in ("ids", "ords", "rows")))


def summed(kind: str, q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows r of q to rows c of x, summed from left to right. Cosine takes unit rows."""
    out = np.zeros(len(r))
    for i in range(0, len(r), 1 << 16):
        a, b, part = q[r[i : i + (1 << 16)]].T, x[c[i : i + (1 << 16)]].T, out[i : i + (1 << 16)]
        for u, v in zip(a, b, strict=True):
            part += (u - v) ** 2 if kind == "l2" else u * v
    return out if kind == "l2" else 1 - out


def nearest(kind: str, q: np.ndarray, x: np.ndarray, k: int, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of x and distance of the k nearest rows of x, by query, nearest first; ties go to the earlier row.

    ``most``: a distance by query beyond which nothing is asked for; it may be that of a row in single precision.
    """
    if kind == "cosine":
        q, x = unit_rows(q), unit_rows(x)
    near = None
    if k < len(x):
        near = q @ x.T
        qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)
        near = qq + xx - 2 * near if kind == "l2" else -near
        slack = 1e-9 * (qq + xx.max(initial=0))
    if near is not None and k and np.isfinite(near).all():
        if most is None:
            limit = np.partition(near, k - 1, axis=1)[:, k - 1 : k] + slack
        else:
            limit = (most if kind == "l2" else most - 1)[:, None] + 1000 * slack
        r, c = np.nonzero(near <= limit)
    else:
        r, c = (v.ravel() for v in np.indices((len(q), len(x) if k else 0)))
    d = summed(kind, q, x, r, c)
    order = np.lexsort((c, d, r))
    r, c, d = r[order], c[order], d[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first], d[first]


def met(x: DataFrame, q: DataFrame, components: int) -> DataFrame:
    """Every block of rows with every block of queries: a stated query set against all rows.

    Queries of at most :data:`MOST` ``components`` are broadcast. More are dealt in groups; each group meets its own copy of
    the row blocks, so nothing that grows is broadcast.
    """
    if components <= MOST:
        return x.crossJoin(F.broadcast(q))
    groups = -(-components // MOST)
    q = q.withColumn("_g", F.pmod(F.xxhash64("qids"), F.lit(groups)))
    x = x.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return x.join(q, "_g").drop("_g")


def top_k(rows: DataFrame, queries: DataFrame, k: int, name: str = "l2", id_col: str = "id", vec_col: str = "vector", ord_col: str | None = None, query_id: str = "query_id", query_vec: str = "vector") -> DataFrame:
    """``query_id, rank, id, distance``: the k nearest rows of each query, or all if there are fewer. ``k = 0`` gives none."""
    kind = metric(name)
    if k < 0:
        raise ValueError("k must not be negative")
    x = packed(rows, id_col, ord_col or id_col, vec_col, "x")
    q = packed(queries, query_id, query_id, query_vec, "q").drop("qords")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                xi, xo, xr, qi, qr = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in enumerate((np.int64, np.int64, np.float64, np.int64, np.float64)))
                xr, qr = xr.reshape(len(xi), -1), qr.reshape(len(qi), -1)
                if xr.shape[1] != qr.shape[1]:
                    raise ValueError(f"queries have {qr.shape[1]} dimensions, rows {xr.shape[1]}")
                by = np.argsort(xo, kind="stable")
                r, c, d = nearest(kind, qr, xr[by], k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(xi[by][c]), pa.array(xo[by][c]), pa.array(d)], ["query_id", "id", "ord", "distance"])

    pairs = met(x, q, components(queries, query_vec)).select("xids", "xords", "xrows", "qids", "qrows")
    return best(pairs.mapInArrow(run, "query_id long, id long, ord long, distance double"), k)


def checked(hits: DataFrame, rows: DataFrame, queries: DataFrame, k: int, name: str = "l2", ord_col: str = "id") -> DataFrame:
    """``query_id, rank, id, distance``: the result of an approximate search made exact.

    ``hits`` is that result (:func:`best`); a query's k-th hit bounds what it asks of each block of ``rows`` (``id, vector``
    and ``ord_col``), so little beyond the hits is summed. A query with fewer hits has no bound.
    """
    kind = metric(name)
    far = hits.where(F.col("rank") == k).select("query_id", F.col("distance").alias("_most"))
    bound = F.array(F.coalesce("_most", F.lit(float("inf"))))  # goes along as a last component
    asked = queries.select("query_id", "vector").join(far, "query_id", "left").select("query_id", F.concat(F.col("vector").cast("array<double>"), bound).alias("vector"))
    x = packed(rows, "id", ord_col, "vector", "x")
    q = packed(asked, "query_id", "query_id", "vector", "q").drop("qords")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                xi, xo, xr, qi, qr = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in enumerate((np.int64, np.int64, np.float64, np.int64, np.float64)))
                xr, qr = xr.reshape(len(xi), -1), qr.reshape(len(qi), -1)
                by = np.argsort(xo, kind="stable")
                r, c, d = nearest(kind, np.ascontiguousarray(qr[:, :-1]), xr[by], k, qr[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(xi[by][c]), pa.array(xo[by][c]), pa.array(d)], ["query_id", "id", "ord", "distance"])

    pairs = met(x, q, components(queries, "vector")).select("xids", "xords", "xrows", "qids", "qrows")
    return best(pairs.mapInArrow(run, "query_id long, id long, ord long, distance double"), k)


def components(queries: DataFrame, vec_col: str) -> int:
    return queries.agg(F.sum(F.size(vec_col))).first()[0] or 0


def best(hits: DataFrame, k: int, order: str = "ord") -> DataFrame:
    """``query_id, rank, id, distance``: the k nearest of the hits of each query."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")


def padded(hits: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """Exactly k rows a query: missing ranks have id -1 and an infinite distance."""
    grid = queries.select(F.col(query_id).alias("query_id")).distinct().withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))))
    return grid.join(hits, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("id", F.lit(-1).cast("long")).alias("id"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def restricted(rows: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Rows that an allow list or a deny list leaves; both at once are an error."""
    if allow is not None and deny is not None:
        raise ValueError("give ids to allow or ids to deny, not both")
    return allowed(rows, allow, id_col) if allow is not None else denied(rows, deny, id_col) if deny is not None else rows


def allowed(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of the given ids. Ids that are unknown are dropped silently."""
    return rows.join(ids.select(ids.columns[0]).distinct().toDF(id_col), id_col, "left_semi")


def denied(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of all but the given ids."""
    return rows.join(ids.select(ids.columns[0]).distinct().toDF(id_col), id_col, "left_anti")
