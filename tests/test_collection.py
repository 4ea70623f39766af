"""Filters, collections, recovery, catalog and streams."""

import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simloom.functions.terms import key, terms, tokens
from simloom.operators import approx, evaluate, filters, topk
from simloom.sources.catalog import Catalog, envelope
from simloom.sources.collection import Collection
from simloom.streaming.ingest import upserts


def rows(spark, ids, dim=4, meta=None, seed=1):
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(int(i), [float(v) for v in r.standard_normal(dim)], None if meta is None else json.dumps(meta(i)), n) for n, i in enumerate(ids)], "id long, vector array<float>, metadata string, pos long")


def book(i):
    """A shelf of 70: seven rows a shelf, three kinds, prices that are whole or not, two or three languages, sometimes a note."""
    return {"kind": ("map", "song", "tale")[i % 3], "shelf": i // 7, "price": i / 2, "langs": ["la", "grc"][: 1 + i % 2] + [f"x{i % 4}"]} | ({"note": None} if i % 10 == 9 else {})


FILTERS = [
    "", {}, {"kind": "song"}, {"kind": {"$ne": "song"}}, {"shelf": {"$in": [0, 9, 77]}}, {"shelf": {"$nin": [0, 1, 2]}}, {"langs": "grc"}, {"langs": {"$ne": "x2"}},
    {"price": 3}, {"price": 3.0}, {"price": 3.5}, {"price": "3"}, {"note": None}, {"note": {"$ne": None}}, {"nowhere": "x"}, {"nowhere": {"$nin": ["x"]}},
    {"kind": "map", "langs": {"$in": ["x0", "x1"]}}, {"$or": [{"shelf": 4}, {"price": {"$eq": 1}}]}, {"$and": [{"kind": {"$ne": "map"}}, {"$or": [{"langs": "x3"}, {"shelf": 0}]}]},
]


def test_filter_counts(spark):
    df = rows(spark, range(70), meta=book).withColumn("terms", terms(F.col("metadata"))).cache()
    for where in FILTERS:
        assert {r.id for r in df.where(filters.compiled(where, F.col("terms"))).select("id").collect()} == {i for i in range(70) if passes(where or {}, book(i))}, where


@pytest.mark.parametrize("bad", ["not json", "[1]", {"bucket": {"$gt": 1}}, {"a": {"$regex": "x"}}, {"$not": []}, {"f": [1]}, {"f": {"$in": 3}}, {"$and": []}, {"$or": [1]}])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        filters.compiled(bad, F.lit(None))


def test_terms():
    assert key(3.0) == key(3) == "3" and key("3") != "3" and key(True) == "true" and key(None) == "null"
    assert tokens('{"a": [1, [2], {"b": 3}, "x"], "c": {"d": 1}, "é": 1e300}') == tokens('{"a": [1, "x"], "é": 1e300}')
    with pytest.raises(ValueError):
        tokens("[1]")


scalars = st.one_of(st.integers(0, 3), st.sampled_from(["a", "b"]), st.booleans(), st.none())
leaves = st.dictionaries(st.sampled_from("xyz"), st.one_of(scalars, st.builds(lambda o, v: {o: v}, st.sampled_from(["$eq", "$ne"]), scalars), st.builds(lambda o, v: {o: v}, st.sampled_from(["$in", "$nin"]), st.lists(scalars, max_size=3))), max_size=2)
trees = st.recursive(leaves, lambda t: st.builds(lambda o, v: {o: v}, st.sampled_from(["$and", "$or"]), st.lists(t, min_size=1, max_size=3)), max_leaves=5)


def passes(where, doc):
    def has(f, v):
        found = doc.get(f, ...)
        return any(key(w) == key(v) for w in (found if isinstance(found, list) else [found]) if w is not ...)

    def op(f, o, a):
        return {"$eq": lambda: has(f, a), "$ne": lambda: not has(f, a), "$in": lambda: any(has(f, v) for v in a), "$nin": lambda: not any(has(f, v) for v in a)}[o]()

    out = []
    for f, v in where.items():
        if f in ("$and", "$or"):
            out.append((all if f == "$and" else any)(passes(w, doc) for w in v))
        else:
            out += [op(f, o, a) for o, a in v.items()] if isinstance(v, dict) else [has(f, v)]
    return all(out)


@given(trees)
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_filter_algebra(spark, where):
    docs = [{}, {"x": 1}, {"x": [1, "a"], "y": None}, {"y": True, "z": "b"}, {"x": "1", "z": [0, 2]}, {"y": 1.0}]
    df = spark.createDataFrame([(i, tokens(json.dumps(d))) for i, d in enumerate(docs)], "i int, terms array<string>")
    assert {r.i for r in df.where(filters.compiled(where, F.col("terms"))).collect()} == {i for i, d in enumerate(docs) if passes(where, d)}


def asked(spark, x):
    return spark.createDataFrame([(n, [float(v) for v in q]) for n, q in enumerate(x)], "query_id long, vector array<float>")


def test_collection_life(spark, tmp_path):
    path = str(tmp_path / "c")
    c = Collection.create(spark, path, 4, metric="l2")
    for wrong in (lambda: Collection.create(spark, path, 4), lambda: Collection.open(spark, str(tmp_path / "none")), lambda: Collection.create(spark, str(tmp_path / "d"), 4, depth=3)):
        with pytest.raises(ValueError):
            wrong()
    c.upsert(rows(spark, range(70), meta=book))
    c.checkpoint()
    assert c.stats()["wal_bytes"] == 0 and c.stats()["max_level"] >= 0 and c.stats()["memory_bytes"] > 0
    c.upsert(rows(spark, range(60, 90), meta=book, seed=2))
    assert c.delete(spark.createDataFrame([(3,), (3,), (89,), (500,)], "id long")) == 3
    c = Collection.open(spark, path)
    s = c.stats()
    assert (s["size"], s["nodes"], s["deleted"], s["snapshot_seq"], s["last_seq"]) == (88, 100, 12, 1, 3) and not c.contains(89) and c.contains(88)
    hits = c.query(asked(spark, [[0.0] * 4]), 300, {"kind": "tale"}).collect()
    want = {i for i in range(90) if i % 3 == 2 and i not in (3, 89)}
    assert {h.id for h in hits} == want and all(json.loads(h.metadata)["kind"] == "tale" for h in hits)
    assert envelope(c.query(asked(spark, [[0.0] * 4]), 3)).count() == 1 and c.access_path(5, {"shelf": 2}) == "id_scan"
    c.upsert(rows(spark, [61, 61]))  # no metadata: cleared; last wins
    assert c.get(61).first().metadata == "{}" and c.size() == 88 and len(c.get_vector(61)) == 4
    with pytest.raises(KeyError):
        c.get_vector(500)
    c.upsert(rows(spark, []))
    assert c.last_seq == 4 and c.delete(spark.createDataFrame([], "id long")) == 0 and c.last_seq == 4
    for bad in (rows(spark, [-1]), rows(spark, [1], dim=3), rows(spark, [1]).withColumn("metadata", F.lit("[1]"))):
        with pytest.raises(ValueError):
            c.upsert(bad)
    assert c.last_seq == 4 and [r.id for r in c.ids().limit(4).collect()] == [0, 1, 2, 4]
    few = spark.createDataFrame([(1,), (2,), (77777,)], "id long")
    assert {h.id for h in c.query(asked(spark, [[0.0] * 4]), 9, filter_ids=few).collect()} == {1, 2}
    assert not {h.id for h in c.query(asked(spark, [[0.0] * 4]), 90, exclude_ids=few).collect()} & {1, 2}
    with pytest.raises(ValueError):
        c.query(asked(spark, [[0.0] * 4]), 9, filter_ids=few, exclude_ids=few)
    c.compact()
    assert (c.size(), c.nodes, c.snapshot_seq) == (88, 88, 4)
    c.compact()
    assert c.snapshot_seq == 4


def test_add_arrays(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), 3, metric="ip")
    assert c.add(np.ones(3)) == [0] and c.add([[1, 2, 3], [4, 5, 6]], metadata=[{"a": 1}, {}]) == [1, 2] and c.add(np.zeros((1, 3)), ids=[40]) == [40]
    assert c.add(np.zeros((0, 3))) == [] and c.size() == 4 and c.get_vector(2) == [4.0, 5.0, 6.0]
    for x, ids in (([1, 2], None), ([[1, 2, 3]], [1, 2])):
        with pytest.raises(ValueError):
            c.add(x, ids)


def test_graph_queries(spark, tmp_path):
    """Beyond the cutoff queries go over the snapshot's graphs; the log adds, replaces and hides rows."""
    r = np.random.default_rng(8)
    x, q = r.standard_normal((3000, 16)).astype(np.float32), r.standard_normal((30, 16)).astype(np.float32)
    for name in ("l2", "cosine"):
        c = Collection.create(spark, str(tmp_path / name), 16, metric=name, shard_rows=1200, ef_construction=64)
        c.add(x[:2500], metadata=[{"half": i % 2} for i in range(2500)])
        c.checkpoint()
        c = Collection.open(spark, str(tmp_path / name))
        c.flat_search_cutoff = 0
        assert c.access_path(10) == "graph" and c.about["shards"] >= 3

        def exact(where=None):
            return by_query(topk.top_k(c.rows().where(filters.compiled(where, F.col("terms"))), asked(spark, q), 10, name))  # noqa: B023

        def recall(where=None):
            found = by_query(c.query(asked(spark, q), 10, where, False, ef=128))  # noqa: B023
            return np.mean([len({h.id for h in a} & {h.id for h in b}) / 10 for a, b in zip(found, exact(where), strict=True)])

        assert recall() >= 0.95 and recall({"half": 1}) >= 0.93
        c.add(x[2500:])
        c.add(-x[:100], ids=range(100))
        c.delete(spark.range(100, 400))
        assert recall() >= 0.95 and not {h.id for hits in by_query(c.query(asked(spark, q), 10, None, False)) for h in hits} & set(range(100, 400))
        wider = [sum(len({h.id for h in a} & {h.id for h in b}) for a, b in zip(by_query(c.query(asked(spark, q), 10, None, False, ef=e)), exact(), strict=True)) for e in (10, 200)]
        assert wider[0] <= wider[1]  # the beam counts


def by_query(hits):
    out = {}
    for h in hits.orderBy("query_id", "rank").collect():
        out.setdefault(h.query_id, []).append(h)
    return [out[k] for k in sorted(out)]


def test_saved_graphs(spark, tmp_path):
    r = np.random.default_rng(2)
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.standard_normal((800, 8)).astype(np.float32))], "id long, vector array<float>")
    q = asked(spark, r.standard_normal((20, 8)))
    approx.build_graphs(x, "l2", shards=2).write.parquet(str(tmp_path / "g"))
    saved = spark.read.schema(approx.GRAPHS).parquet(str(tmp_path / "g"))
    rows_of = lambda g: topk.best(approx.search_graphs(g, q, 5, "l2"), 5).orderBy("query_id", "rank").collect()
    assert rows_of(saved) == rows_of(approx.build_graphs(x.repartition(5), "l2", shards=2))  # a rebuild is the same
    assert approx.graph_stats(saved)["degree"] > 4
    flipped = saved.withColumn("x", F.concat(F.expr("substring(x, 1, 10)"), F.lit(b"?"), F.expr("substring(x, 12)")))
    with pytest.raises(Exception, match="damaged"):
        rows_of(flipped)
    plain = approx.build_graphs(x, "l2", shards=1, use_heuristic=False)
    assert evaluate.recall(approx.search_graphs(plain, q, 10, "l2", 200), topk.top_k(x, q, 10, "l2")).agg(F.avg("recall")).first()[0] >= 0.9


@pytest.mark.parametrize("name,rerank", [("l2", True), ("cosine", False)])
def test_coded_collections(spark, tmp_path, name, rerank):
    """Ranges widen up to a thousand vectors, then stay; codes alone give nearly the true neighbours, vectors may go."""
    r = np.random.default_rng(6)
    x, q = r.standard_normal((2400, 24)).astype(np.float32), r.standard_normal((20, 24)).astype(np.float32)
    c = Collection.create(spark, str(tmp_path / "c"), 24, metric=name, quantization="int8", rerank=rerank)
    c.add(x[:500])
    first = c.ranges
    c.add(2 * x[500:1200])
    wide = c.ranges
    assert all(b <= a for a, b in zip(first[0], wide[0], strict=True)) and (name == "cosine" or first != wide)
    c.add(9 * x[1200:])
    assert c.ranges == wide  # frozen: later ones are clamped
    c.add(x, ids=range(2400))
    c.checkpoint()
    c = Collection.open(spark, str(tmp_path / "c"))
    assert c.about["dropped"] == (not rerank) and c.ranges == wide
    full = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    truth = topk.top_k(full, asked(spark, q), 10, name)
    found = c.query(asked(spark, q), 10, include_metadata=False)
    assert evaluate.recall(found, truth).agg(F.avg("recall")).first()[0] >= (0.95 if rerank else 0.85)
    if rerank:
        both = found.alias("a").join(truth.alias("b"), ["query_id", "id"]).select(F.max(F.abs(F.col("a.distance") - F.col("b.distance")))).first()[0]
        assert both < 1e-4
    else:
        unit = x[7] / np.linalg.norm(x[7])
        assert np.abs(np.array(c.get_vector(7)) - unit).max() < 0.02
    c.add(x[:3], ids=[0, 1, 5000])
    c.delete(spark.range(10, 20))
    hits = c.query(asked(spark, x[2:3]), 1, include_metadata=False).collect()
    assert hits[0].id in (2, 5000) and c.size() == 2391


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", range(1, 9))
def test_crashes(spark, tmp_path, step):
    """Whatever step of a checkpoint or an upsert is the last, opening finds all that was committed, and writing goes on."""
    c = Collection.create(spark, str(tmp_path / "c"), 4)
    c.upsert(rows(spark, range(10)))
    c.checkpoint()
    c.upsert(rows(spark, range(5, 20)))
    for what, least, most in ((c.checkpoint, 20, 20), (lambda: c.upsert(rows(spark, range(20, 25))), 20, 25)):
        left = [step]

        def stop(real):
            def run(*a):
                left[0] -= 1  # noqa: B023
                if left[0] == 0:  # noqa: B023
                    raise Crash
                return real(*a)

            return run

        for name in ("rename", "delete", "write"):
            setattr(c.files, name, stop(getattr(c.files, name)))
        try:
            what()
        except Crash:
            pass
        c = Collection.open(spark, str(tmp_path / "c"))
        assert least <= c.size() <= most and c.size() in (20, 25)
    c.upsert(rows(spark, range(20, 30)))
    c.checkpoint()
    assert Collection.open(spark, str(tmp_path / "c")).size() == 30


def test_readers_keep_what_they_read(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), 4)
    c.upsert(rows(spark, range(10)))
    held = c.rows()
    c.checkpoint()
    c.upsert(rows(spark, range(10, 15)))
    later = Collection.open(spark, str(tmp_path / "c")).rows()
    assert held.count() == 10 and later.count() == 15
    before = sorted(p.name for p in (tmp_path / "c").rglob("*"))
    Collection.open(spark, str(tmp_path / "c")).query(asked(spark, [[0.0] * 4]), 3).collect()
    assert sorted(p.name for p in (tmp_path / "c").rglob("*")) == before  # opening and reading change nothing


def test_torn_log(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), 4)
    for i in range(3):
        c.upsert(rows(spark, [i]))
    torn = next((tmp_path / "c" / "log" / f"{3:020d}").glob("part-*"))
    torn.write_bytes(torn.read_bytes()[:40])
    c = Collection.open(spark, str(tmp_path / "c"))
    assert (c.size(), c.last_seq) == (2, 2)


def test_auto_checkpoint(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), 4, checkpoint_wal_bytes=4096)
    for i in range(4):
        c.upsert(rows(spark, [i]))
    assert c.snapshot_seq > 0 and c.size() == 4 and c.wal_bytes() <= 4096


def test_catalog(spark, tmp_path):
    k = Catalog(spark, str(tmp_path / "root"))
    k.create("a-1", 4)
    with pytest.raises(FileExistsError):
        k.create("a-1", 4)
    with pytest.raises(ValueError):
        k.create("a/b", 4)
    with pytest.raises(KeyError):
        k.get("b")
    assert k.names() == ["a-1"]
    k.drop("a-1")
    assert k.names() == []


def test_stream(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), 4)
    rows(spark, range(20)).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = upserts(spark.readStream.schema("id long, vector array<float>, metadata string, pos long").parquet(str(tmp_path / "in")), c, str(tmp_path / "cp"))
        q.awaitTermination()
    assert c.size() == 20 and c.last_seq == 1 and c.stream == 0
    c = Collection.open(spark, str(tmp_path / "c"))  # a new checkpoint folder: the batch's number is known all the same
    upserts(spark.readStream.schema("id long, vector array<float>, metadata string, pos long").parquet(str(tmp_path / "in")), c, str(tmp_path / "cp2")).awaitTermination()
    assert c.last_seq == 1
    c.checkpoint()
    assert Collection.open(spark, str(tmp_path / "c")).stream == 0
