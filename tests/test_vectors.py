"""Metrics, exact and approximate top-k, quantization, levels, planner: against numpy and fixed values."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from simloom.functions import levels, metrics, sq8
from simloom.operators import approx, evaluate, planner, topk
from simloom.operators.hnsw import Hnsw
from simloom.plans import vector_queries


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, vector array<float>")


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [3.0, 4.0, 0.0], [0.0, 0.0, 0.0])], "a array<float>, b array<float>, c array<float>, z array<float>")
    a, b, c, z = map(F.col, "abcz")
    r = df.select(metrics.distance("l2", a, b), metrics.distance("ip", a, a), metrics.distance("Cosine", a, b), metrics.normalize(c), metrics.normalize(z), metrics.distance("angular", a, z)).first()
    assert r[0] == 2 and r[1] == 0 and r[2] == 1 and r[4] == [0, 0, 0] and r[5] == 1
    assert np.allclose(r[3], [0.6, 0.8, 0])
    with pytest.raises(ValueError):
        metrics.metric("manhattan")


@pytest.mark.parametrize("name", ["l2", "ip", "cosine"])
def test_exact_top_k(spark, name):
    r = np.random.default_rng(1)
    x, q = r.standard_normal((3000, 16)).astype(np.float32), r.standard_normal((20, 16)).astype(np.float32)
    got = topk.top_k(frame(spark, x), frame(spark, q, "query_id"), 10, name).toPandas().sort_values(["query_id", "rank"])
    want = np.argsort(metrics.distances(name, q.astype(float), x.astype(float)), axis=1, kind="stable")[:, :10]
    assert (got.id.to_numpy().reshape(20, 10) == want).all()


def test_ties_by_ordinal_k_and_padding(spark):
    x = frame(spark, [[1, 0], [0, 0], [1, 0], [1, 0]]).withColumn("ord", -F.col("id"))
    q = frame(spark, [[1, 0]], "query_id")
    assert [r.id for r in topk.top_k(x, q, 2, ord_col="ord").orderBy("rank").collect()] == [3, 2]
    assert topk.top_k(x, q, 0).count() == 0
    hits = topk.top_k(x, q, 9)
    assert hits.count() == 4
    rows = topk.padded(hits, q, 6).orderBy("rank").collect()
    assert [r.id for r in rows][4:] == [-1, -1] and rows[5].distance == float("inf")
    assert topk.top_k(x.where("id < 0"), q, 3).count() == 0
    only = spark.createDataFrame([(1,), (99,)], "k long")
    assert [r.id for r in topk.top_k(topk.allowed(x, only), q, 3).collect()] == [1]
    assert {r.id for r in topk.top_k(topk.denied(x, only), q, 3).collect()} == {0, 2, 3}
    with pytest.raises(Exception, match="dimensions"):
        topk.top_k(x, frame(spark, [[1, 2, 3]], "query_id"), 1).collect()


@pytest.mark.parametrize("name", ["l2", "ip", "cosine"])
def test_graph_and_codes_recall(spark, name):
    r = np.random.default_rng(1)
    x, q = frame(spark, r.standard_normal((5000, 32))), frame(spark, r.standard_normal((100, 32)), "query_id")
    truth = topk.top_k(x, q, 10, name)
    for found, least in ((approx.graph_top_k(x, q, 10, name, ef=128), 0.95), (approx.coded_top_k(x, q, 10, name), 0.95), (approx.coded_top_k(x, q, 10, name, rerank=False), 0.85)):
        assert evaluate.recall(found, truth).agg(F.avg("recall")).first()[0] >= least


def test_graph_reaches_every_row():
    r = np.random.default_rng(4)
    x = np.vstack([r.standard_normal((1500, 16)), np.ones(16) + 0.01 * r.standard_normal((300, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = Hnsw.load(Hnsw(x).dump())
    a, b = g.within(x, 0.99, 16)
    assert len(a) >= 0.999 * ((x @ x.T) >= 0.99).sum()


def test_sq8(spark):
    x = np.random.default_rng(2).standard_normal((400, 8))
    df = frame(spark, x).crossJoin(sq8.collected(sq8.ranges(frame(spark, x), "vector")))
    codes = sq8.encode(F.col("vector"), F.col("mins"), F.col("scales"))
    got = np.array([r[0] for r in df.select(codes).collect()])
    f = x.astype(np.float32).astype(float)
    want = np.clip(np.rint((f - f.min(0)) / ((f.max(0) - f.min(0)) / 255)), 0, 255)
    assert (got == want).all()
    flat = sq8.ranges(frame(spark, [[5, 5], [5, 6]]), "vector").orderBy("pos").collect()
    assert flat[0].scale == 1.0
    wide = sq8.widen(sq8.ranges(frame(spark, [[0, 1]]), "vector"), sq8.ranges(frame(spark, [[2, 0]]), "vector")).orderBy("pos").collect()
    assert [(r.lo, r.hi) for r in wide] == [(0, 2), (0, 1)]


def test_levels():
    level = levels.draw(np.arange(500))
    assert np.bincount(level).tolist() == [466, 31, 3] and np.flatnonzero(level == 2).tolist() == [33, 181, 452]
    assert np.flatnonzero(level)[:6].tolist() == [9, 18, 26, 33, 41, 55]


def test_planner():
    assert planner.access_path(50, 10) == planner.EXACT and planner.access_path(20000, 10) == planner.GRAPH
    assert planner.access_path(20000, 10, allowed=600) == planner.SCAN and planner.access_path(200000, 10, allowed=100000) == planner.GRAPH
    assert planner.access_path(50, 10, allowed=5, cutoff=0) == planner.GRAPH and planner.access_path(100, 10, ef=128) == planner.EXACT


def test_crc32(spark):
    assert spark.sql("SELECT crc32('123456789')").first()[0] == 0xCBF43926


# what an approximate search misses, the exact check after it finds


@pytest.fixture(scope="module")
def thin(tmp_path_factory):
    """A folder with 4,500 vectors and labels."""
    x = np.random.default_rng(4).standard_normal((4500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = tmp_path_factory.mktemp("thin")
    pq.write_table(pa.table({"vec_id": np.arange(4500), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(np.arange(4500) % 10, pa.int32())}), at / "embeddings.parquet")
    return str(at)


def missing(monkeypatch, name):
    """The search ``approx.name`` without two thirds of what it finds."""
    search = getattr(approx, name)
    monkeypatch.setattr(approx, name, lambda *a, **k: search(*a, **k).where("id % 3 = 0"))


def test_checked(spark):
    r = np.random.default_rng(8)
    x, q = frame(spark, r.standard_normal((2500, 8))), frame(spark, r.standard_normal((30, 8)), "query_id")
    for name in ("l2", "ip", "cosine"):
        truth = topk.top_k(x, q, 7, name)
        some = topk.best(truth.where("id % 2 = 0 and query_id < 29").withColumn("ord", F.col("id")), 7)
        for found in (some, topk.best(topk.top_k(x.where("id % 50 = 0"), q, 7, name).withColumn("ord", F.col("id")), 7)):
            assert sorted(topk.checked(found, x, q, 7, name).collect()) == sorted(truth.collect())


def test_graph_misses_are_found(spark, thin, monkeypatch):
    missing(monkeypatch, "search_graphs")
    got = vector_queries.ann_graph_good(spark, thin).collect()
    assert len(got) == 225 and all(r.good for r in got)


def test_filtered_graph_misses_are_found(spark, thin, monkeypatch):
    missing(monkeypatch, "search_graphs")
    got = vector_queries.ann_graph_filtered(spark, thin).collect()
    assert len(got) == 225 and all(r.good for r in got)


def test_collection_misses_are_found(spark, thin, monkeypatch):
    missing(monkeypatch, "search_graphs")
    e = vector_queries._plain(spark, thin)
    want = vector_queries._shown(topk.top_k(e.where("label <> 4"), vector_queries._asked(e), 10))
    assert sorted(vector_queries.collection_query(spark, thin).collect()) == sorted(want.collect())


def test_code_misses_are_found(spark, thin, monkeypatch):
    missing(monkeypatch, "search_codes")
    e = vector_queries._base(spark, thin)
    want = vector_queries._shown(topk.top_k(e, vector_queries._asked(e), 10))
    assert sorted(vector_queries.sq8_rerank(spark, thin).collect()) == sorted(want.collect())
