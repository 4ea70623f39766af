"""What the operators of this subpackage share: shared folders, text buffers, word hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one pass of the vectorised kernels takes at a time; a longer text goes alone.
CHUNK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer partitions than that (a small table in one file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> SparkSession:
    """Texts go to Python workers at most ``rows`` and about ``size`` bytes at a time, so that a batch of long ones stays small.

    Plans run after they are made, so the session keeps these settings; smaller ones of the caller stay.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints", f"simloom-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes tables of :func:`kept` that nothing will read any more."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (then a shuffled join serves)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def learned(sample: DataFrame, make: Callable[[pa.Table | None], object]):
    """What ``make`` makes of a bounded sample (None if it is empty), in one task: the driver holds neither texts nor what
    learning from them takes, only the model."""

    def run(batches):
        only()
        held = list(batches)
        out = pickle.dumps(make(pa.Table.from_batches(held) if held else None))
        del held
        pa.default_memory_pool().release_unused()
        _trim()
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["model"])

    row = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row[0]) if row else make(None)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be none of ``columns`` (without regard to case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def hot_join(rows: DataFrame, one: DataFrame, counts: DataFrame, key: str, deal: str, total: int) -> DataFrame:
    """``rows`` with what ``one`` (a row a key) has for their ``key``; no task gets all rows of a hot key.

    ``counts`` (``key``, ``c``) says how many of the ``total`` rows each key has. A key of over ``most`` rows is dealt by
    a hash of the column ``deal`` over as many parts as it needs, and its row of ``one`` is copied to each. At most
    ``total / most``, that is 10,000 keys, are hot: their list is broadcast.
    """
    most = max(1000, -(-total // 10_000))
    hot = F.broadcast(counts.where(F.col("c") > most).select(key, (F.col("c") / most).cast("int").alias("_last")))
    last = F.coalesce("_last", F.lit(0))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.when(last > 0, F.pmod(F.xxhash64(deal), last + 1)).otherwise(0).cast("int")).drop("_last")
    copies = one.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), last))).drop("_last")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column, without copying them. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # what lies under a null is undefined
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if (lengths != np.diff(offsets)).any():
            return buffers(column.fill_null(b"" if pa.types.is_binary(column.type) else ""))
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one longer text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
    if n:
        _trim()


def spans(data: np.ndarray, offsets: np.ndarray, limit: int = 8 * CHUNK) -> Iterator[np.ndarray]:
    """The texts of a chunk in pieces: offsets of at most about ``limit`` bytes, that end where a text does or, within a long
    one, before a blank after something else (so within a word longer than that nowhere)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi - lo <= limit:
        yield offsets
        return
    cuts = [lo]
    while hi - cuts[-1] > limit:
        at = cuts[-1] + limit
        while at < hi:  # the next blank from there on that begins a gap
            here = data[at - 1 : min(hi, at + limit)]
            gap = np.flatnonzero((here[1:] == 32) & ((here[:-1] | 32) >= 97) & ((here[:-1] | 32) <= 122))
            if len(gap):
                at += int(gap[0])
                break
            at += limit
        if at >= hi:
            break
        cuts.append(at)
    cuts.append(hi)
    for a, b in zip(cuts, cuts[1:]):  # noqa: B905
        inside = offsets[(offsets > a) & (offsets < b)]
        yield np.concatenate([[a], inside, [b]])


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can: a Python worker outlives its tasks."""
    global _libc
    if _libc is None:
        try:
            _libc = ctypes.CDLL(None)
            _libc.malloc_trim(0)
        except (OSError, AttributeError):
            _libc = False
    elif _libc:
        _libc.malloc_trim(0)


_libc = None
_models: dict = {}


def model(key, build):
    """What ``build`` makes, kept in a Python worker over its tasks; one thing at a time: other keys' go."""
    if key not in _models:
        only()
        _models[key] = build()
    return _models[key]


def only(*keys) -> None:
    """Lets go of the models of other operators that ran in this worker before."""
    if any(k not in keys for k in _models):
        for k in [k for k in _models if k not in keys]:
            del _models[k]
        gc.collect()
        _trim()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(1 << 18, 1 << int(n).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts ``data[offsets[i]:offsets[i+1]]``: starts and ends of words in data, and n + 1 offsets into these by text."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if lo == hi:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[data[lo:hi]]
    first = np.zeros(hi - lo + 1, bool)
    first[offsets - lo] = True
    before = np.empty(hi - lo, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(hi - lo, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts + lo, ends + lo, np.searchsorted(starts + lo, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = _LOWER) -> np.ndarray:
    """A 64-bit hash of each word ``fold[data[start:end]]``: polynomial over random byte values, then mixed."""
    out = np.empty(len(starts), np.uint64)
    values = _VALUES[fold]
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 17), side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers_to(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * power[: hi - lo], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * inverse[s]
        i = j
    return mixed(out)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text (of all its words, if fewer), and n + 1 offsets. Not distinct yet."""
    starts, ends, first = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    lead = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
    short = np.repeat(counts < width, n)
    out = h[lead] if len(lead) else np.zeros(0, np.uint64)
    last = max(len(h) - 1, 0)
    length = np.repeat(np.minimum(counts, width), n)
    for k in range(1, width):
        out = out * np.uint64(_BASE) ^ (out >> np.uint64(29))
        step = h[np.minimum(lead + k, last)] if len(lead) else out
        out = out + (np.where(length > k, step, np.uint64(k)) if short.any() else step)
    return mixed(out), at


def distinct_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    s, at = shingles(data, offsets, width)
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        x = np.sort(s[i:j])
        if j - i > 1:
            keep = np.empty(j - i, bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            x = x[keep]
        out.append(x)
    return out
