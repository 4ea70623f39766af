"""Durable collections: Parquet snapshots with their graphs or codes, and an ordered log of batches.

``config.json``; ``log/<seq>/``, one batch each; ``snap-<seq>/`` with ``rows``, ``graphs`` or ``codes``, and ``_about.json``.
A batch and a snapshot are written beside and then renamed to a name that does not exist: that rename commits them, and
nothing is ever written over. The newest snapshot is the current one. Current rows are the snapshot and the contiguous run
of batches after it, latest per id; a batch that was torn ends the run. Opening deletes nothing: the next write removes what
is left over. One writer; readers keep the snapshot they began with as long as the next one but one is not made.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simloom.functions import sq8
from simloom.functions.metrics import metric, normalize
from simloom.functions.terms import terms
from simloom.operators import approx, filters, planner, topk
from simloom.operators.current import existing, latest

from .files import Files

SCHEMA = "op string, id long, seq long, pos long, vector array<float>, metadata string, terms array<string>"
_COLUMNS = ["vector", "metadata", "terms"]
_DEFAULTS = {"metric": "cosine", "M": 16, "ef_construction": 200, "seed": 42, "use_heuristic": True, "quantization": "none", "rerank": True, "checkpoint_wal_bytes": 64 << 20, "shard_rows": 16384}
#: Accepted quantization names (fixed).
_QUANTIZATION = {"": "none", "none": "none", "f32": "none", "float32": "none", "sq8": "sq8", "int8": "sq8", "uint8": "sq8"}
#: Below this many vectors the ranges of a quantizer still widen (fixed).
TRAINING = 1000
_FOOTER = b"PAR1"


def _seq(n: int) -> str:
    return f"{n:020d}"


class Collection:
    def __init__(self, spark: SparkSession, path: str, config: dict):
        self.spark, self.files, self.config = spark, Files(spark, path), config
        self.ef_search, self.flat_search_cutoff, self.about, self._counted = 64, 2048, {}, (-1, 0)
        self.refresh()

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, **options) -> Collection:
        """A new collection; one that exists is never overwritten."""
        files = Files(spark, path)
        if files.exists("config.json"):
            raise ValueError(f"{path} holds a collection already")
        unknown = set(options) - set(_DEFAULTS) - {"name"}
        if unknown or dim < 1:
            raise ValueError(f"bad options: {sorted(unknown) or 'dim'}")
        config = _DEFAULTS | options | {"dim": dim}
        config["metric"] = metric(config["metric"])
        try:
            config["quantization"] = _QUANTIZATION[str(config["quantization"]).lower()]
        except KeyError:
            raise ValueError(f"unknown quantization {config['quantization']!r}") from None
        files.mkdirs("log")
        files.write("config.json", json.dumps(config))
        return cls(spark, path, config)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Collection:
        files = Files(spark, path)
        if not files.exists("config.json"):
            raise ValueError(f"{path} holds no collection")
        return cls(spark, path, _DEFAULTS | json.loads(files.read("config.json")))

    # state

    def refresh(self) -> None:
        """Takes up what is committed: the newest snapshot and the batches that follow it without a gap."""
        snaps = [n for n in self.files.names() if n.startswith("snap-") and n[5:].isdigit()]
        self.snapshot_seq, self.before = (int(snaps[-1][5:]) if snaps else 0), (int(snaps[-2][5:]) if len(snaps) > 1 else 0)
        self.about = json.loads(self.files.read(f"{snaps[-1]}/_about.json")) if snaps else {"nodes": 0, "stream": -1, "ranges": None, "shards": 0}
        self.ef_search, self.flat_search_cutoff = self.about.get("ef_search", self.ef_search), self.about.get("flat_search_cutoff", self.flat_search_cutoff)
        self.stream, self.ranges, self.nodes = self.about["stream"], self.about["ranges"], self.about["nodes"]
        have, self.last_seq = {int(n) for n in self.files.names("log") if n.isdigit()}, self.snapshot_seq
        while self.last_seq + 1 in have and self._whole(self.last_seq + 1):
            self.last_seq += 1
            note = json.loads(self.files.read(f"log/{_seq(self.last_seq)}/_about.json"))
            self.stream, self.ranges, self.nodes = max(self.stream, note["stream"]), note["ranges"], self.nodes + note["nodes"]

    def _whole(self, seq: int) -> bool:
        """Whether a batch has all its files with all their bytes. What cannot be read for other reasons raises."""
        at = f"log/{_seq(seq)}"
        sizes = self.files.sizes(at)
        if "_about.json" not in sizes:
            return False
        want = json.loads(self.files.read(f"{at}/_about.json"))["files"]
        return all(sizes.get(n) == size and self.files.tail(f"{at}/{n}", 4) == _FOOTER for n, size in want.items())

    def _commit(self, batch: DataFrame, note: dict) -> None:
        seq = self.last_seq + 1
        for n in self.files.names("log"):  # left over by a crash: torn, unfinished, or older than both snapshots
            if not n.isdigit() or int(n) > self.last_seq or int(n) <= self.before:
                self.files.delete(f"log/{n}")
        name = f"log/{_seq(seq)}"
        batch.withColumn("seq", F.lit(seq).cast("long")).select("op", "id", "seq", "pos", *_COLUMNS).write.parquet(self.files.at(f"{name}.tmp"))
        note = {"nodes": 0, "stream": -1, "ranges": self.ranges} | note
        parts = {n: size for n, size in self.files.sizes(f"{name}.tmp").items() if n.endswith(".parquet")}
        self.files.write(f"{name}.tmp/_about.json", json.dumps(note | {"files": parts}))
        self.files.rename(f"{name}.tmp", name)
        self.last_seq, self.stream, self.ranges, self.nodes = seq, max(self.stream, note["stream"]), note["ranges"], self.nodes + note["nodes"]
        if self.wal_bytes() > self.config["checkpoint_wal_bytes"]:
            self.checkpoint()

    def wal_bytes(self) -> int:
        """Bytes of the batches that no snapshot holds."""
        return sum(self.files.size(f"log/{_seq(s)}") for s in range(self.snapshot_seq + 1, self.last_seq + 1))

    def _snapshot(self, part: str) -> str:
        return self.files.at(f"snap-{_seq(self.snapshot_seq)}/{part}")

    def _log(self) -> DataFrame | None:
        parts = [self.files.at(f"log/{_seq(s)}") for s in range(self.snapshot_seq + 1, self.last_seq + 1)]
        return self.spark.read.schema(SCHEMA).parquet(*parts) if parts else None

    def _stored(self) -> DataFrame | None:
        """The snapshot's rows; vectors that were dropped come from their codes."""
        if not self.snapshot_seq:
            return None
        rows = self.spark.read.schema(SCHEMA).parquet(self._snapshot("rows"))
        if self.about.get("dropped"):
            left = approx.unpacked_codes(self.spark.read.schema(approx.CODES).parquet(self._snapshot("codes")), *self._quantizer(self.about["ranges"]))
            rows = rows.drop("vector").join(left.select("id", F.col("vector").cast("array<float>").alias("vector")), "id").select("op", "id", "seq", "pos", *_COLUMNS)
        return rows

    def rows(self) -> DataFrame:
        """Current rows: ``id, seq, pos, vector, metadata, terms``."""
        parts = [p for p in (self._stored(), self._log()) if p is not None]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA).drop("op")
        return latest(parts[0] if len(parts) == 1 else parts[0].union(parts[1]), _COLUMNS)

    @property
    def coded(self) -> bool:
        return self.config["quantization"] == "sq8"

    @staticmethod
    def _quantizer(ranges: list) -> tuple[list[float], list[float]]:
        lo, hi = np.array(ranges[0]), np.array(ranges[1])
        return lo.tolist(), np.where(hi > lo, (hi - lo) / 255, 1.0).tolist()

    def _unit(self, v: str = "vector"):
        return normalize(F.col(v)) if self.config["metric"] == "cosine" else F.col(v).cast("array<double>")

    # writing

    def upsert(self, batch: DataFrame, stream: int = -1) -> int:
        """Adds or replaces the rows of ``batch`` (``id, vector``, perhaps ``metadata`` and ``pos``) and returns their number.

        Of rows that repeat an id the last by ``pos`` wins. A row without metadata has ``{}``: what it had before is gone.
        Rows are validated before anything is written; an empty batch uses no seq. ``stream`` is the number of a stream's
        batch, committed with it; one that is not above the last is skipped.
        """
        if 0 <= stream <= self.stream:
            return 0
        if "metadata" not in batch.columns:
            batch = batch.withColumn("metadata", F.lit(None).cast("string"))
        if "pos" not in batch.columns:
            batch = batch.withColumn("pos", F.monotonically_increasing_id())
        batch = batch.select(F.col("id").cast("long").alias("id"), F.col("pos").cast("long").alias("pos"), F.col("vector").cast("array<float>").alias("vector"), F.coalesce(F.when(F.col("metadata") != "", F.col("metadata")), F.lit("{}")).alias("metadata")).persist()
        try:
            bad = F.col("id").isNull() | (F.col("id") < 0) | F.col("vector").isNull() | (F.size("vector") != self.config["dim"]) | F.exists("vector", lambda x: x.isNull())
            n, wrong, nodes = batch.agg(F.count("*"), F.count_if(bad), F.countDistinct("id")).first()
            if wrong:
                raise ValueError(f"{wrong} rows have a bad id or not {self.config['dim']} dimensions")
            if not n:
                return 0
            note = {"nodes": nodes, "stream": stream}
            if self.coded and self.nodes < TRAINING:  # before the batch: the ranges widen, later ones are clamped to them
                found = sq8.ranges(batch.select(self._unit().alias("vector")), "vector").orderBy("pos").collect()
                lo, hi = [r.lo for r in found], [r.hi for r in found]
                note["ranges"] = [list(map(min, lo, self.ranges[0])), list(map(max, hi, self.ranges[1]))] if self.ranges else [lo, hi]
            try:
                self._commit(batch.withColumns({"op": F.lit("upsert"), "terms": terms(F.col("metadata"))}), note)
            except Exception as e:
                if "JSON" in str(e) or "Expecting" in str(e):
                    raise ValueError("metadata must be a JSON object") from None
                raise
            return n
        finally:
            batch.unpersist()

    def add(self, vectors, ids=None, metadata: list[dict] | None = None) -> list[int]:
        """Upserts a numpy array or list, one vector or rows of them; without ``ids`` these go on from the number of nodes."""
        x = np.atleast_2d(np.asarray(vectors, np.float32))
        if x.ndim != 2 or x.shape[1] != self.config["dim"]:
            raise ValueError(f"vectors must have {self.config['dim']} dimensions")
        ids = list(range(self.nodes, self.nodes + len(x))) if ids is None else [int(i) for i in np.atleast_1d(ids)]
        if len(ids) != len(x) or (metadata is not None and len(metadata) != len(x)):
            raise ValueError("ids, vectors and metadata differ in length")
        meta = [None] * len(x) if metadata is None else list(map(json.dumps, metadata))
        if ids:
            self.upsert(self.spark.createDataFrame([(i, v.tolist(), m, n) for n, (i, v, m) in enumerate(zip(ids, x, meta, strict=True))], "id long, vector array<float>, metadata string, pos long"))
        return ids

    def delete(self, ids: DataFrame) -> int:
        """Deletes ids and returns how many existed (an id given twice counts twice). Unknown ids use a seq too; no ids, none."""
        ids = ids.select(F.col(ids.columns[0]).cast("long").alias("id"))
        if not ids.limit(1).count():
            return 0
        n = existing(self.rows(), ids)
        none = {"pos": F.lit(0).cast("long"), "op": F.lit("delete"), "vector": F.lit(None).cast("array<float>"), "metadata": F.lit(None).cast("string"), "terms": F.lit(None).cast("array<string>")}
        self._commit(ids.distinct().withColumns(none), {})
        return n

    def checkpoint(self) -> None:
        """Writes current rows as a snapshot with its graphs or codes, then drops what the snapshot before it made obsolete."""
        if self.last_seq == self.snapshot_seq and self.snapshot_seq:
            return
        seq, old = self.last_seq, self.snapshot_seq
        name, tmp = f"snap-{_seq(seq)}", f"snap-{_seq(seq)}.tmp"
        self.files.delete(tmp)
        now = self.rows().withColumn("op", F.lit("upsert")).select("op", "id", "seq", "pos", *_COLUMNS)
        frozen = self.coded and self.nodes >= TRAINING
        drop = frozen and not self.config["rerank"]
        (now.withColumn("vector", F.lit(None).cast("array<float>")) if drop else now).write.parquet(self.files.at(f"{tmp}/rows"))
        about = {"seq": seq, "ef_search": self.ef_search, "flat_search_cutoff": self.flat_search_cutoff, "stream": self.stream, "ranges": self.ranges, "dropped": drop, "shards": 0, "max_level": 0, "degree": 0.0, "memory": 0}
        source = now if drop else self.spark.read.schema(SCHEMA).parquet(self.files.at(f"{tmp}/rows"))
        about["nodes"] = self.spark.read.parquet(self.files.at(f"{tmp}/rows")).count()
        by = source.select("id", (F.col("seq") * F.lit(1 << 40) + F.col("pos")).alias("ord"), self._unit().alias("vector"))
        if self.coded:
            if self.ranges:
                approx.packed_codes(by, *self._quantizer(self.ranges), ord_col="ord").write.parquet(self.files.at(f"{tmp}/codes"))
        elif about["nodes"]:
            about["shards"] = approx.shards_for(about["nodes"], self.config["shard_rows"], self.spark.sparkContext.defaultParallelism)
            c = self.config
            approx.build_graphs(by, c["metric"], ord_col="ord", m=c["M"], ef_construction=c["ef_construction"], seed=c["seed"], use_heuristic=c["use_heuristic"], shards=about["shards"]).write.parquet(self.files.at(f"{tmp}/graphs"))
            about |= approx.graph_stats(self.spark.read.parquet(self.files.at(f"{tmp}/graphs")))
        self.files.write(f"{tmp}/_about.json", json.dumps(about))
        self.files.rename(tmp, name)  # the commit
        self.refresh()
        # readers may still hold the snapshot before and the batches after it; what is older goes
        for n in self.files.names("log"):
            if n.isdigit() and int(n) <= old:
                self.files.delete(f"log/{n}")
        for n in self.files.names():
            if n.startswith("snap-") and n[5:].isdigit() and int(n[5:]) < old:
                self.files.delete(n)

    def compact(self) -> None:
        """Rewrites the snapshot without rows that were replaced or deleted, ranges of codes stay; nothing to do if there are none."""
        if self.nodes > self.size():
            self.checkpoint()

    # reading

    def access_path(self, k: int, where: str | dict | None = None, ef: int = 0) -> str:
        some = self.rows().where(filters.compiled(where, F.col("terms"))).count() if filters.parse(where) else None
        return planner.access_path(self.size(), k, ef, self.ef_search, some, self.config["M"], self.flat_search_cutoff)

    def query(self, queries: DataFrame, k: int = 10, where: str | dict | None = None, include_metadata: bool = True, ef: int = 0, filter_ids: DataFrame | None = None, exclude_ids: DataFrame | None = None, check: bool = False) -> DataFrame:
        """``query_id, rank, id, distance`` (and ``metadata``) of the k nearest rows that pass the filter, which comes first.

        The planner chooses by counts: all rows, the rows that pass, or the graphs of the snapshot. Rows of the log are always
        scanned, and hide what the graphs hold of their ids. With codes, these are scanned and, with ``rerank``, the best
        ``max(ef, k)`` ranked again by their vectors. Graphs and codes may miss a neighbour; ``check`` adds what they missed.
        """
        rows = topk.restricted(self.rows().where(filters.compiled(where, F.col("terms"))), filter_ids, exclude_ids)
        by = rows.withColumn("ord", F.col("seq") * F.lit(1 << 40) + F.col("pos"))
        wide = max(ef or self.ef_search, k)
        if self.coded and self.ranges:
            whole = not filters.parse(where) and filter_ids is None and exclude_ids is None and self.last_seq == self.snapshot_seq
            hits = self._coded_hits(by, queries, k, wide, whole)
        else:
            allow = bool(filters.parse(where)) or filter_ids is not None
            some = rows.count() if allow else None
            path = planner.access_path(self.size(), k, ef, self.ef_search, some, self.config["M"], self.flat_search_cutoff)
            graph = path == planner.GRAPH and self.about["shards"] and k
            hits = self._graph_hits(by, queries, k, wide, allow or exclude_ids is not None) if graph else topk.top_k(by, queries, k, self.config["metric"], ord_col="ord")
            check = check and graph
        if check:
            hits = topk.checked(hits, by, queries, k, self.config["metric"], "ord")
        return hits.join(rows.select("id", F.coalesce("metadata", F.lit("{}")).alias("metadata")), "id").select("query_id", "rank", "id", "distance", "metadata") if include_metadata else hits

    def _graph_hits(self, by: DataFrame, queries: DataFrame, k: int, wide: int, filtered: bool) -> DataFrame:
        log, keep = self._log(), None
        old = by.where(F.col("seq") <= self.snapshot_seq)
        if filtered or log is not None:  # ids by shard: at most a shard's rows in one array
            keep = old.select("id", approx.shard_of("id", self.about["shards"]).alias("shard")).groupBy("shard").agg(F.collect_list("id").alias("keep"))
        unit = queries.select("query_id", self._unit().alias("vector"))
        hits = approx.search_graphs(self.spark.read.schema(approx.GRAPHS).parquet(self._snapshot("graphs")), unit, k, self.config["metric"], wide, keep)
        if log is not None:
            new = topk.top_k(by.where(F.col("seq") > self.snapshot_seq), queries, k, self.config["metric"], ord_col="ord")
            hits = hits.union(new.join(by.select("id", "ord"), "id").select("query_id", "id", "ord", "distance"))
        return topk.best(hits, k)

    def _coded_hits(self, by: DataFrame, queries: DataFrame, k: int, wide: int, whole: bool) -> DataFrame:
        """``whole``: the snapshot's codes are all there is to scan."""
        mins, scales = self._quantizer(self.ranges)
        unit = queries.select("query_id", self._unit().alias("vector"))
        x = by.select("id", "ord", self._unit().alias("vector"))
        wide = wide if self.config["rerank"] else k
        codes = self.spark.read.schema(approx.CODES).parquet(self._snapshot("codes")) if whole else approx.packed_codes(x, mins, scales, ord_col="ord")
        hits = approx.search_codes(codes, unit, wide, self.config["metric"], mins, scales)
        if not self.config["rerank"]:
            return topk.best(hits, k)
        few = hits.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "ord"))).where(F.col("_r") <= wide)
        return topk.best(approx.reranked(few, x, unit, k, self.config["metric"]), k)

    def get(self, id_: int) -> DataFrame:
        """The row of an id, if there is one; cosine collections give the vector at unit length."""
        return self.rows().where(F.col("id") == id_).select("id", self._unit().alias("vector"), "metadata")

    def get_vector(self, id_: int) -> list[float]:
        """The stored vector of an id; KeyError if there is none."""
        row = self.get(id_).first()
        if row is None:
            raise KeyError(id_)
        return row.vector

    def contains(self, id_: int) -> bool:
        return bool(self.rows().where(F.col("id") == id_).limit(1).count())

    def ids(self) -> DataFrame:
        return self.rows().select("id").orderBy("id")

    def size(self) -> int:
        """Live rows; counted once for each state."""
        if self._counted[0] != self.last_seq:
            self._counted = self.last_seq, self.rows().count()
        return self._counted[1]

    def stats(self) -> dict:
        """Config and counts. ``nodes`` counts rows that were replaced or deleted since the snapshot too; degree, level and
        memory are those of the snapshot's graphs."""
        size = self.size()
        graphs = {"capacity": self.nodes, "max_level": self.about.get("max_level", 0), "mean_degree_level0": self.about.get("degree", 0.0), "memory_bytes": self.about.get("memory", 0)}
        return self.config | {"size": size, "nodes": self.nodes, "deleted": self.nodes - size, "ef_search": self.ef_search, "flat_search_cutoff": self.flat_search_cutoff, "last_seq": self.last_seq, "snapshot_seq": self.snapshot_seq, "wal_bytes": self.wal_bytes()} | graphs
