"""Approximate top-k: graphs by shard, built once and searched often, and a scan of 8-bit codes with exact re-ranking."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simloom.functions import levels, sq8
from simloom.functions.metrics import dot, l2sq, metric, normalize, unit_rows

from .hnsw import Hnsw
from .topk import MOST, best, components, matrix, met, nearest, packed, summed

#: A graph: its rows' ids, ordinals and vectors, the longest of these, and a checksum of all that.
GRAPHS = "shard int, graph binary, ids binary, ords binary, x binary, longest double, crc long"
CODES = "xids binary, xords binary, xcodes binary"


def shard_of(id_col: str, shards: int):
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(shards)).cast("int")


def shards_for(rows: int, shard_rows: int, cores: int) -> int:
    """As many shards as hold ``shard_rows`` each, and for small tables enough that cores share them, 512 rows or more each."""
    return max(1, -(-rows // shard_rows), min(cores, rows // 512))


def _checksum(*parts: bytes) -> int:
    crc = 0
    for p in parts:
        crc = zlib.crc32(p, crc)
    return crc


def build_graphs(rows: DataFrame, name: str = "l2", id_col: str = "id", vec_col: str = "vector", ord_col: str | None = None, m: int = 16, ef_construction: int = 200, seed: int = 42, use_heuristic: bool = True, shard_rows: int = 16384, shards: int | None = None) -> DataFrame:
    """A graph for each shard of at most about ``shard_rows`` rows (:data:`GRAPHS`); a table to write once.

    Graphs hold unit rows; added components make their order that of the metric within a shard. Levels are drawn by id and
    ``seed``, so a rebuild gives the same graph.
    """
    kind = metric(name)
    shards = shards or shards_for(rows.count(), shard_rows, rows.sparkSession.sparkContext.defaultParallelism)
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ord_col or id_col).cast("long").alias("ord"), F.col(vec_col).cast("array<float>").alias("v"), shard_of(id_col, shards).alias("shard"))

    def build(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("id")
        x = np.stack(batch["v"].to_numpy()).astype(np.float32)
        x64, ids = x.astype(np.float64), batch["id"].to_numpy(np.int64)
        longest = float(np.sqrt((x64 * x64).sum(1).max(initial=0))) or 1.0
        if kind == "l2":  # q x - |x|^2 / 2 orders as the distance does
            lift = np.column_stack([x64, (x64 * x64).sum(1) / longest])
        else:
            lift = unit_rows(x64) if kind == "cosine" else x64
        n2 = (lift * lift).sum(1)
        unit = unit_rows(np.column_stack([lift, np.sqrt(np.maximum(n2.max(initial=0) - n2, 0))]))
        raw = Hnsw(unit, m, ef_construction, level=levels.draw(ids, seed, m), heuristic=use_heuristic).dump()
        parts = [raw, ids.tobytes(), batch["ord"].to_numpy(np.int64).tobytes(), x.tobytes()]
        return pd.DataFrame({"shard": [int(key[0])]} | {c: [v] for c, v in zip(("graph", "ids", "ords", "x"), parts, strict=True)} | {"longest": [longest], "crc": [_checksum(*parts)]})

    return base.groupBy("shard").applyInPandas(build, GRAPHS)


def search_graphs(graphs: DataFrame, queries: DataFrame, k: int, name: str = "l2", ef: int = 64, allowed: DataFrame | None = None, query_id: str = "query_id", query_vec: str = "vector") -> DataFrame:
    """``query_id, id, ord, distance``: of each graph the k best rows for each query; distances are exact.

    ``allowed`` (``shard, keep``: ids as arrays) restricts rows; a beam that holds too few of these is widened. A graph is
    read and unpacked once for all queries, or all of a group of at most :data:`topk.MOST` components. A damaged graph raises.
    """
    kind = metric(name)
    held = graphs.select("shard", "graph", "ids", "ords", "x", "longest", "crc")
    held = held.withColumn("keep", F.lit(None).cast("array<bigint>")) if allowed is None else held.join(allowed, "shard")
    asked = packed(queries, query_id, query_id, query_vec, "q").select("qids", "qrows")
    with_filter = allowed is not None

    def search(batches):
        last, g, ids, ords, x = None, None, None, None, None
        for b in batches:
            for i in range(b.num_rows):
                shard, raw, ri, ro, rx, longest, crc, keep, qi, q = (b.column(c)[i] for c in range(10))
                if shard.as_py() != last:
                    parts = [v.as_py() for v in (raw, ri, ro, rx)]
                    if _checksum(*parts) != crc.as_py():
                        raise ValueError(f"the graph of shard {shard.as_py()} is damaged")
                    last, g, ids, ords = shard.as_py(), Hnsw.load(parts[0]), np.frombuffer(parts[1], np.int64), np.frombuffer(parts[2], np.int64)
                    x = np.frombuffer(parts[3], np.float32).reshape(len(ids), -1).astype(np.float64)
                qi = np.frombuffer(b"".join(qi.as_py()), np.int64)
                q = np.frombuffer(b"".join(q.as_py()), np.float64).reshape(len(qi), -1)
                more = [np.full(len(q), -longest.as_py() / 2)] if kind == "l2" else []
                unit = unit_rows(np.column_stack([q, *more, np.zeros(len(q))]))
                wide = max(ef, k)
                near = g.search_allowed(unit, wide, np.isin(ids, np.asarray(keep.values))) if with_filter else g.search(unit, wide)[0]
                r, c = np.nonzero(near >= 0)
                c = near[r, c]
                d = summed(kind, *((unit_rows(q), unit_rows(x)) if kind == "cosine" else (q, x)), r, c)
                order = np.lexsort((ords[c], d, r))
                r, c, d = r[order], c[order], d[order]
                first = np.arange(len(r)) - np.searchsorted(r, r) < k
                r, c = r[first], c[first]
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(ids[c]), pa.array(ords[c]), pa.array(d[first])], ["query_id", "id", "ord", "distance"])

    groups = max(1, -(-components(queries, query_vec) // MOST))
    asked = asked.withColumn("_g", F.pmod(F.xxhash64("qids"), F.lit(groups))).groupBy("_g").agg(F.collect_list("qids").alias("qids"), F.collect_list("qrows").alias("qrows"))
    each = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))
    pairs = held.crossJoin(F.broadcast(asked)) if groups == 1 else held.withColumn("_g", F.explode(each)).join(asked, "_g")
    pairs = pairs.select("shard", "graph", "ids", "ords", "x", "longest", "crc", "keep", "qids", "qrows")
    return pairs.mapInArrow(search, "query_id long, id long, ord long, distance double")


def graph_stats(graphs: DataFrame) -> dict:
    """``max_level``, mean ``degree`` on the lowest layer and ``memory`` in bytes of a table of graphs."""

    def run(batches):
        for b in batches:
            for raw, ids, x in zip(*(b.column(c) for c in range(3)), strict=True):
                g = Hnsw.load(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (g.top, int((g.links[0] >= 0).sum()), len(g.x), len(raw.as_py()) + len(ids.as_py()) + len(x.as_py()))], ["top", "links", "n", "size"])

    one = graphs.select("graph", "ids", "x").mapInArrow(run, "top long, links long, n long, size long").agg(F.max("top").alias("top"), F.sum("links").alias("links"), F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    return {"max_level": one["top"] or 0, "degree": (one["links"] or 0) / max(1, one["n"] or 0), "memory": one["size"] or 0}


def graph_top_k(rows: DataFrame, queries: DataFrame, k: int, name: str = "l2", id_col: str = "id", vec_col: str = "vector", query_id: str = "query_id", query_vec: str = "vector", ef: int = 64, **options) -> DataFrame:
    """``query_id, rank, id, distance`` by graphs that are built for this search; collections keep theirs."""
    return best(search_graphs(build_graphs(rows, name, id_col, vec_col, **options), queries, k, name, ef, None, query_id, query_vec), k)


def packed_codes(rows: DataFrame, mins: list[float], scales: list[float], id_col: str = "id", ord_col: str = "id", vec_col: str = "vector", block: int = 4096) -> DataFrame:
    """``rows`` as blocks of 8-bit codes (:data:`CODES`)."""
    lo, step = np.array(mins), np.array(scales)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                ids, ords = (np.asarray(part.column(c), np.int64) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids, ords, sq8.coded_rows(matrix(part.column(2)), lo, step))], ["xids", "xords", "xcodes"])

    return rows.select(F.col(id_col).cast("long").alias("_id"), F.col(ord_col).cast("long").alias("_ord"), F.col(vec_col).cast("array<double>").alias("_v")).mapInArrow(run, CODES)


def unpacked_codes(codes: DataFrame, mins: list[float], scales: list[float]) -> DataFrame:
    """``id, ord, vector`` of blocks of codes: what is left of vectors that were dropped."""
    lo, step = np.array(mins), np.array(scales)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, ords = (np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in (0, 1))
                x = sq8.decoded_rows(np.frombuffer(b.column(2)[i].as_py(), np.uint8).reshape(len(ids), -1), lo, step)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ords), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["id", "ord", "vector"])

    return codes.select("xids", "xords", "xcodes").mapInArrow(run, "id long, ord long, vector array<double>")


def search_codes(codes: DataFrame, queries: DataFrame, k: int, name: str, mins: list[float], scales: list[float], query_id: str = "query_id", query_vec: str = "vector") -> DataFrame:
    """``query_id, id, ord, distance`` of full queries to codes; of each block the k nearest. Cosine takes unit vectors on both sides as given."""
    kind = "l2" if metric(name) == "l2" else "ip"
    lo, step = np.array(mins), np.array(scales)
    asked = packed(queries, query_id, query_id, query_vec, "q").select("qids", "qrows")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                xi, xo, xc, qi, qr = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in enumerate((np.int64, np.int64, np.uint8, np.int64, np.float64)))
                by = np.argsort(xo, kind="stable")
                r, c, d = nearest(kind, qr.reshape(len(qi), -1), sq8.decoded_rows(xc.reshape(len(xi), -1)[by], lo, step), k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(xi[by][c]), pa.array(xo[by][c]), pa.array(d)], ["query_id", "id", "ord", "distance"])

    return met(codes.select("xids", "xords", "xcodes"), asked, components(queries, query_vec)).mapInArrow(run, "query_id long, id long, ord long, distance double")


def reranked(hits: DataFrame, rows: DataFrame, queries: DataFrame, k: int, name: str) -> DataFrame:
    """``query_id, id, ord, distance``: hits with distances of the full vectors; only the hits' rows are read beyond their ids."""
    full = hits.select("query_id", "id", "ord").join(rows.select("id", F.col("vector").alias("v")), "id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    d = l2sq(F.col("q"), F.col("v")) if metric(name) == "l2" else 1 - dot(F.col("q"), F.col("v"))
    return full.select("query_id", "id", "ord", d.alias("distance"))


def coded_top_k(rows: DataFrame, queries: DataFrame, k: int, name: str = "l2", ef: int = 64, rerank: bool = True, id_col: str = "id", vec_col: str = "vector", query_id: str = "query_id", query_vec: str = "vector") -> DataFrame:
    """Codes are ranked first; with ``rerank`` the ``max(ef, k)`` best are ranked again by their full vectors."""
    kind = metric(name)
    unit = (lambda c: normalize(F.col(c))) if kind == "cosine" else (lambda c: F.col(c).cast("array<double>"))
    x = rows.select(F.col(id_col).cast("long").alias("id"), unit(vec_col).alias("vector"))
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), unit(query_vec).alias("vector"))
    mins, scales = sq8.collected(sq8.ranges(x, "vector")).first()
    wide = max(ef, k) if rerank else k
    hits = search_codes(packed_codes(x, mins, scales), q, wide, kind, mins, scales)
    if not rerank:
        return best(hits, k)
    few = hits.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "ord"))).where(F.col("_r") <= wide)
    return best(reranked(few, x, q, k, kind), k)
