"""Embedding near-duplicates: an HNSW graph per shard, all vectors queried on every shard, links verified, components joined.

Equal vectors are one class with a count. Classes are dealt into shards of bounded size by a hash; each shard's graph is
built once and written to the shared folder. A search task holds one graph and streams blocks of query vectors past it;
tasks are as few as keep all cores busy, up to ``per_task`` blocks each, so that graphs are copied seldom. Vectors travel as
they came, single precision where they are that, and are divided by their lengths in the task.
Beams full of linked rows are widened for their query; every block is audited: some of its vectors are compared with the
whole shard, and while the audit misses a link the block is searched again with wider beams. A link counts only by its
cosine in double precision. A task returns how many links each vector has, and a spanning forest of them, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.operators.hnsw import Hnsw

from .common import forget, hot_join, kept, only
from .graph import components

_MARGIN = 1e-5  # what single precision may be off


def _rows(column: pa.Array, dtype: type) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets))
    x = np.zeros((len(size), int(size.max(initial=0))), dtype)
    flat = np.asarray(column.flatten(), dtype)
    x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of doubles divided by their norms."""
    x = x.astype(np.float64)
    x /= np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-300)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges node-root that connect what the given edges connect, at most one for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    on = root != np.arange(len(nodes))
    return nodes[on], nodes[root[on]]


def search_block(graph: Hnsw, x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, least: float, ef: int, audit: int, recall: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (row of q, row of x) of a block on one shard, and the beam width with which the audit passed."""
    some = np.unique(np.linspace(0, len(q) - 1, audit).astype(np.int64))
    truth = q[some] @ x.T >= least
    truth &= ids != qids[some][:, None]
    while True:
        a, b = graph.within(q, least - _MARGIN, ef)
        ok = qids[a] != ids[b]
        a, b = a[ok], b[ok]
        ok = np.einsum("ij,ij->i", q[a], x[b]) >= least if len(a) < 1 << 18 else np.concatenate([np.einsum("ij,ij->i", q[a[s : s + (1 << 18)]], x[b[s : s + (1 << 18)]]) >= least for s in range(0, len(a), 1 << 18)])
        a, b = a[ok], b[ok]
        found = int(np.isin(a, some).sum())
        if found >= recall * truth.sum() or ef >= len(x):
            return a, b, ef
        ef *= 2


def near_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, shard_rows: int | None = None, block: int = 1024, ef: int = 24, m: int = 16, ef_build: int = 40, audit: int = 32, recall: float = 1.0, per_task: int = 256) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    A vector that is null, empty, zero, or holds a null or non-finite component links with nothing. Vectors of different
    lengths compare as if padded with zeros. Rows that repeat an id are rows of their own; equal vectors link. A row of
    null id keeps its links, but no id to stay under: it counts for others, and a component of such rows only is null. An
    empty table gives none; other columns are not read. A shard has ``shard_rows`` vectors, or as many as have two million
    components together: every vector is searched for on every shard, so larger ones cost less.
    """
    spark = vectors.sparkSession
    single = vectors.select(vec_col).dtypes[0][1] == "array<float>"
    dtype, kind = (np.float32, "array<float>") if single else (np.float64, "array<double>")
    x = F.col(vec_col).cast(kind)
    ok = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0), F.lit(False))
    key = F.transform(x, lambda e: e + F.lit(0.0).cast("float" if single else "double"))  # -0.0 is 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(ok, key).alias("v"))
    rows = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.xxhash64("v", F.lit(1))})
    rows = kept(rows, "vectors")
    classes = rows.where("v is not null").groupBy("h1", "h2").agg(F.count("*").alias("c"), F.any_value("v").alias("v"))
    n = rows.where("v is not null").select("h1", "h2").distinct().count()
    if shard_rows is None:  # 32,768 vectors of 64 components; longer ones are fewer to a graph
        shard_rows = max(4096, (1 << 21) // max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1))
    shards = max(1, -(-n // shard_rows))
    # h1 names a class from here on; the shard comes from h2
    classes = kept(classes.withColumn("shard", F.pmod(F.col("h2"), F.lit(shards)).cast("int")), "classes")

    def build(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("h1")
        v = _rows(pa.array(batch["v"].tolist(), pa.list_(pa.float64())), dtype)
        graph = Hnsw(_unit(v), m, ef_build)
        graph.x = graph.x[:, :0]  # comes from the vectors again
        return pd.DataFrame({"shard": [int(key[0])], "graph": [graph.dump()], "ids": [batch["h1"].to_numpy(np.int64).tobytes()], "x": [v.tobytes()], "c": [batch["c"].to_numpy(np.int64).tobytes()]})

    graphs = kept(classes.groupBy("shard").applyInPandas(build, "shard int, graph binary, ids binary, x binary, c binary"), "graphs")

    def pack(batches):
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (np.asarray(part.column(0), np.int64).tobytes(), _rows(part.column(1), dtype).tobytes())] + [pa.array([int(np.asarray(part.column(0))[0]) & 0x7FFFFFFF], pa.int64())], ["ids", "x", "block"])

    blocks = kept(classes.select("h1", "v").mapInArrow(pack, "ids binary, x binary, block long"), "blocks")
    count = blocks.count()
    salts = max(1, -(-count // max(4, min(per_task, -(-count * shards // (3 * spark.sparkContext.defaultParallelism))))))
    # every block meets every shard: a stated query set in blocks; each graph is copied ``salts`` times
    none = F.lit(None).cast("binary")
    tasks = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "graph", "ids", "x", "c")
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod("block", F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), none.alias("graph"), "ids", "x", none.alias("c"))

    def search(batches):
        only()
        held = None
        for b in batches:
            for i in range(b.num_rows):
                kind, graph, ids, raw, c = (b.column(k)[i] for k in range(2, 7))
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                rows_ = _unit(np.frombuffer(raw.as_buffer(), dtype).reshape(len(ids), -1))
                if kind.as_py() == 0:
                    held = None
                    g = Hnsw.load(graph.as_py())
                    g.x = np.ascontiguousarray(rows_, np.float32)
                    held = (g, rows_, ids.copy(), np.frombuffer(c.as_py(), np.int64), ef)
                    continue
                g, x_, own, count, wide = held
                dim = max(x_.shape[1], rows_.shape[1])
                if x_.shape[1] < dim:
                    x_ = np.pad(x_, ((0, 0), (0, dim - x_.shape[1])))
                    g.x = np.ascontiguousarray(x_, np.float32)
                q = np.pad(rows_, ((0, 0), (0, dim - rows_.shape[1])))
                left, right, wide = search_block(g, x_, own, q, ids, least, wide, audit, recall)
                held = (g, x_, own, count, wide)
                if len(left):
                    links = np.bincount(left, weights=count[right], minlength=len(ids)).astype(np.int64)
                    some = np.flatnonzero(links)
                    u, v = _forest(ids[left], own[right])
                    z = np.zeros(len(some), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in ((ids[some], u), (z, v), (links[some], np.zeros(len(u), np.int64)))], ["a", "b", "n"])

    met = tasks.union(asked).repartition(shards * salts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    found = kept(met.mapInArrow(search, "a long, b long, n long"), "found")
    roots = components(found.where("n = 0"), "a", "b").select(F.col("node").alias("h1"), "root")
    forget(graphs, blocks, classes)
    links = found.where("n > 0").groupBy(F.col("a").alias("h1")).agg(F.sum("n").alias("n"))
    least_id = rows.where("v is not null").groupBy("h1").agg(F.min("vec_id").alias("least"), F.count("*").alias("c"))
    least_id = least_id.join(roots, "h1", "left").join(links, "h1", "left").withColumn("root", F.coalesce("root", "h1"))
    least_id = kept(least_id, "classes")
    forget(found)
    by_root = least_id.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    named = hot_join(least_id.drop("c"), by_root.drop("c"), by_root, "root", "h1", n).join(least_id.select("h1", "c"), "h1")
    named = kept(named.select("h1", "component_id", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links")), "named")
    met = hot_join(rows.where("v is not null").select("vec_id", "h1"), named, least_id.select("h1", "c"), "h1", "vec_id", rows.count())
    met = met.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
