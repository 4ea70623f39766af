"""Exact top-k inner products by pivot-table elimination.

With one more component, ``sqrt(M^2 - |x|^2)`` for candidates and 0 for queries (M: the longest candidate), the largest
inner product is the smallest distance. Distances of every candidate to the pivots are computed once, in blocks; for a
query, ``max_p |d(q, p) - d(x, p)|`` bounds its distance from below, so its score from above. Candidates are evaluated
in the order of their bounds until the next bound is below the k-th score: the rest cannot enter, not even by a tie.

Queries go in groups, candidates in blocks; a task holds one group and streams a lane of blocks, keeping the best so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept

_BLOCK = "g int, lane int, kind int, own binary, ids binary, rows binary, far binary"
_FIELDS = ["g", "lane", "kind", "own", "ids", "rows", "far"]


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``id, v``: ``floor(scale * x)`` of vectors that have neither a null nor a non-finite component. Rows without id or vector go."""
    x = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers; shorter vectors are padded with zeros."""
    flat, off = column.flatten(), np.asarray(column.offsets)
    size = np.diff(off)
    out = np.zeros((len(size), dim), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], size)] = np.asarray(flat)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a b': doubles hold the sums while they stay below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most >= 2**63:
        raise OverflowError("an inner product may exceed 64 bits")
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Of a bounded sample the rows that lie far apart: each next one is farthest from those before."""
    picked, x = [0], sample.astype(np.float64)
    gap = ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(count, len(x)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _best(own, ids, scores, k):
    order = np.lexsort((own, ids, -scores))[:k]
    return own[order], ids[order], scores[order]


def top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, pivots: int = 24, sample: int = 512, group: int = 2048, block: int = 4096, lanes: int | None = None) -> DataFrame:
    """``query_id, rank, id, score`` of the k best candidates for each row that ``queries`` (over ``id``) picks.

    Ties go to the smaller id. A query's own row is no candidate; of rows that repeat an id each is a query and a candidate
    by itself, also of its twins. Vectors that are null or hold a null or non-finite component take no part; shorter ones
    are padded with zeros. An empty table gives no rows; other columns are not read. Pivots come from a bounded sample; they
    change what is evaluated, never what is returned.
    """
    spark = vectors.sparkSession
    base = kept(integers(vectors, id_col, vec_col, scale).withColumn("own", F.monotonically_increasing_id()), "vectors")
    stats = base.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e)).alias("m2"), F.count("*").alias("n"), F.count(F.when(queries, 1)).alias("q"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    dim, m2 = stats["dim"] or 0, float(stats["m2"] or 0.0)
    dtype = next((t for t in (np.int16, np.int32) if (stats["most"] or 0) <= np.iinfo(t).max), np.int64)  # what travels
    lanes = lanes or int(max(1, min(-(-stats["n"] // block), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    groups = max(1, -(-stats["q"] // group))
    first = base.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    piv = _pivots(_matrix(first, dim), pivots) if len(first) else np.zeros((0, dim), np.int64)

    def far(x: np.ndarray, own: np.ndarray, lift: bool) -> np.ndarray:
        """Distances to the pivots; ``lift`` gives rows the added component that candidates have."""
        p2 = (piv.astype(np.float64) ** 2).sum(1)
        dots = _products(x, piv).astype(np.float64) + (np.sqrt(np.maximum(m2 - own, 0))[:, None] * np.sqrt(np.maximum(m2 - p2, 0)) if lift else 0)
        return np.sqrt(np.maximum((m2 if lift else own[:, None]) + m2 - 2 * dots, 0)).astype(np.float32)

    def packed(kind: int, size: int):
        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, size):
                    part = batch.slice(i, size)
                    x, ids, own = _matrix(part.column(1), dim), np.asarray(part.column(0), np.int64), np.asarray(part.column(2), np.int64)
                    d = far(x, (x.astype(np.float64) ** 2).sum(1), kind == 1)
                    at = int(ids[0]) & 0x7FFFFFFF
                    for j in range(lanes if kind == 0 else groups):
                        g, lane = (at % groups, j) if kind == 0 else (j, at // 7 % lanes)
                        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (g, lane, kind)] + [pa.array([b.tobytes()], pa.binary()) for b in (own, ids, x.astype(dtype), d)], _FIELDS)

        return run

    def search(batches):
        rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
        key, held = None, []
        for g, lane, kind, own, ids, x, d in rows:
            if (g, lane) != key:
                yield from out(held)
                key, held = (g, lane), []
            own, ids, x = np.frombuffer(own, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(x, dtype).reshape(len(own) // 8, dim).astype(np.int64)
            d = np.frombuffer(d, np.float32).reshape(len(ids), -1)
            if kind == 0:
                held.append((own, ids, x, d, (x.astype(np.float64) ** 2).sum(1), [(ids[:0], ids[:0], ids[:0])] * len(ids)))
            else:
                for q in held:
                    eliminate(q, own, ids, x, d)
        yield from out(held)

    def eliminate(q, own, ids, x, d):
        qown, _, qx, qd, q2, top = q
        for i in range(0, len(qown), 64):
            low = np.zeros((len(qd[i : i + 64]), len(ids)), np.float32)
            for p in range(qd.shape[1]):
                np.maximum(low, np.abs(qd[i : i + 64, p, None] - d[None, :, p]), out=low)
            slack = 1 + 1e-6 * (q2[i : i + 64, None] + m2)
            high = (q2[i : i + 64, None] + m2 - low.astype(np.float64) ** 2) / 2 + slack
            for r in range(len(high)):
                bo, bi, bs = top[i + r]
                bound = high[r]
                may = np.flatnonzero(bound >= bs[-1]) if len(bs) == k else np.arange(len(ids))
                may = may[np.argsort(-bound[may], kind="stable")]
                at, step = 0, 128
                while at < len(may) and (len(bs) < k or bound[may[at]] >= bs[-1]):
                    some = may[at : at + step]
                    some = some[own[some] != qown[i + r]]
                    s = _products(qx[i + r : i + r + 1], x[some])[0]
                    bo, bi, bs = _best(np.concatenate([bo, own[some]]), np.concatenate([bi, ids[some]]), np.concatenate([bs, s]), k)
                    at, step = at + step, step * 4
                top[i + r] = bo, bi, bs

    def out(held):
        for own, qid, _, _, _, top in held:
            n = [len(t[0]) for t in top]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.repeat(qid, n)), *(pa.array(np.concatenate([t[c] for t in top])) for c in range(3))], ["query", "query_id", "own", "id", "score"])

    blocks = base.where(queries).mapInArrow(packed(0, 512), _BLOCK).union(base.mapInArrow(packed(1, block), _BLOCK))
    best = blocks.repartition(groups * lanes, "g", "lane").sortWithinPartitions("g", "lane", "kind").mapInArrow(search, "query long, query_id long, own long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id", "own"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
