"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every word from both sides.

Ids: the most frequent words of the corpus (counts of all its words), the rest in buckets by hash. The two words before
and the two after go through their vectors and a hidden layer; a word's probability is that of its class times that within
its class. Training takes the whole corpus: in each round every partition runs over its share of the documents from the
same parameters, and the parameters become the mean over partitions, weighted by words. A document's score is the sum of
log p(word | its window) over all its words.

The network's classes are the frequent words and the buckets. A word in a bucket has the bucket's probability times its
share of the bucket's words in the corpus: counts of all words stay in a table that grows with the corpus and meet the
documents' words by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, kept, only, word_bounds, word_hashes

SIDE, DIM, HIDDEN, CLASSES, EACH = 2, 8, 16, 32, 64
SIZE, BUCKETS = CLASSES * EACH, 64
_PAD = SIZE


class Vocabulary:
    """Ids of words by hash. Ranks go round the classes, so that these are even; the last ranks are the buckets."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.rank = np.argsort(hashes)

    def ids(self, h: np.ndarray) -> np.ndarray:
        rank = (SIZE - BUCKETS + (h % np.uint64(BUCKETS))).astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            rank = np.where(self.sorted[at] == h, self.rank[at], rank)
        return rank % CLASSES * EACH + rank // CLASSES


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), first


def start(seed: int = 17) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
    return {"e": np.vstack([f(SIZE, DIM), np.zeros((1, DIM), np.float32)]), "w": f(2 * SIDE * DIM, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "c": f(HIDDEN, CLASSES), "cb": np.zeros(CLASSES, np.float32), "o": f(CLASSES, HIDDEN, EACH), "ob": np.zeros((CLASSES, EACH), np.float32)}


def windows(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The 2 * SIDE neighbours of every word; none beyond its text."""
    n = np.diff(first)
    place = np.arange(len(ids)) - np.repeat(first[:-1] - first[0], n)
    left = np.repeat(n, n) - 1 - place
    out = np.full((len(ids), 2 * SIDE), _PAD, np.int64)
    for k in range(1, SIDE + 1):
        ok = np.flatnonzero(place >= k)
        out[ok, SIDE - k] = ids[ok - k]
        ok = np.flatnonzero(left >= k)
        out[ok, SIDE + k - 1] = ids[ok + k]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _forward(p: dict, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = p["e"].take(ctx, axis=0).reshape(len(ctx), -1)
    h = np.tanh(x @ p["w"] + p["b"])
    return x, h, _softmax(h @ p["c"] + p["cb"])


def log_probabilities(p: dict, ctx: np.ndarray, ids: np.ndarray, batch: int = 16384) -> np.ndarray:
    out = np.empty(len(ids))
    for i in range(0, len(ids), batch):
        y = ids[i : i + batch]
        cls, within = y // EACH, y % EACH
        _, h, pc = _forward(p, ctx[i : i + batch])
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        pw = np.empty(len(y), np.float32)
        for c in range(CLASSES):
            s = order[cut[c] : cut[c + 1]]
            if len(s):
                pw[s] = _softmax(h[s] @ p["o"][c] + p["ob"][c])[np.arange(len(s)), within[s]]
        out[i : i + batch] = np.log(pc[np.arange(len(y)), cls].astype(np.float64) + 1e-30) + np.log(pw.astype(np.float64) + 1e-30)
    return out


def train_on(p: dict, g2: dict, ctx: np.ndarray, ids: np.ndarray, rate: float, batch: int = 8192) -> None:
    """One pass of adaptive gradient steps, in place."""
    for i in range(0, len(ids), batch):
        y, near = ids[i : i + batch], ctx[i : i + batch]
        n = len(y)
        cls, within = y // EACH, y % EACH
        x, h, pc = _forward(p, near)
        pc[np.arange(n), cls] -= 1
        dh = pc @ p["c"].T
        g = {"c": h.T @ pc, "cb": pc.sum(0), "o": np.zeros_like(p["o"]), "ob": np.zeros_like(p["ob"])}
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            s = order[cut[c] : cut[c + 1]]
            if len(s):
                hs = h[s]
                d = _softmax(hs @ p["o"][c] + p["ob"][c])
                d[np.arange(len(s)), within[s]] -= 1
                g["o"][c], g["ob"][c] = hs.T @ d, d.sum(0)
                dh[s] += d @ p["o"][c].T
        da = dh * (1 - h * h)
        g["w"], g["b"] = x.T @ da, da.sum(0)
        dx = (da @ p["w"].T).reshape(-1, DIM)
        flat = near.ravel()
        g["e"] = np.column_stack([np.bincount(flat, weights=dx[:, k], minlength=SIZE + 1) for k in range(DIM)]).astype(np.float32)
        g["e"][_PAD] = 0
        for k, v in p.items():
            gk = g[k] / n
            g2[k] += gk * gk
            v -= rate * gk / (np.sqrt(g2[k]) + 1e-4)


def _batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    only()
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for i, j in chunks(offsets):
            h, first = _words(data, offsets[i : j + 1])
            yield vocabulary.ids(h), first


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``key, c``: every word of the documents by hash, and how often it occurs."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for i, j in chunks(offsets, 1 << 22):
                key, count = np.unique(_words(data, offsets[i : j + 1])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["key", "c"])

    return docs.select(text_col).mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words, by counts over all documents; ties by hash."""
    return Vocabulary(counts.orderBy(F.desc("c"), "key").limit(SIZE - BUCKETS).toPandas()["key"].to_numpy(np.int64).view(np.uint64))


def fit(docs: DataFrame, text_col: str, id_col: str, rounds: int = 2, rate: float = 0.1, sums: int = 64, counts: DataFrame | None = None) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """Vocabulary and parameters learned from all documents: each is in one round's share by a hash of its id.

    A partition gives one row of a fixed size, however large it is. These are summed in ``sums`` tasks, a row at a time, and
    the driver gets one row of each. How documents lie in partitions has a part in the result.
    """
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(vocabulary(word_counts(docs, text_col) if counts is None else counts))
    p = start()
    names = list(p)
    cuts = np.cumsum([0, *(p[k].size for k in names)])
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def run(batches, shared=shared):
            own = {k: v.copy() for k, v in shared.value.items()}
            g2, n = {k: np.full_like(v, 1e-8) for k, v in own.items()}, 0
            for ids, first in _batches(batches, words.value):
                if len(ids):
                    order = np.random.default_rng(len(ids)).permutation(len(ids))
                    train_on(own, g2, windows(ids, first)[order], ids[order], rate)
                    n += len(ids)
            if n:
                flat = np.concatenate([own[k].ravel() for k in names]).astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["s", "n"])

        def add(batches):
            total, n = np.zeros(cuts[-1]), 0
            for batch in batches:
                for raw, count in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    total += np.frombuffer(raw.as_buffer(), np.float64)
                    n += count
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["s", "n"])

        share = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(rounds)) == turn).select(text_col)
        parts = share.mapInArrow(run, "s binary, n long").repartition(sums).mapInArrow(add, "s binary, n long").collect()
        if parts:
            flat = (sum(np.frombuffer(r["s"], np.float64) for r in sorted(parts, key=lambda r: bytes(r["s"]))) / sum(r["n"] for r in parts)).astype(np.float32)
            p = {k: flat[a:b].reshape(p[k].shape) for k, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)}
    return words.value, p


def scored(docs: DataFrame, model: tuple[Vocabulary, dict[str, np.ndarray]], text: Column) -> Column:
    """struct of n_tokens and sum_logprob. A null or blank text has no token and the sum 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<n_tokens: long, sum_logprob: double>")
    def run(column: pa.Array) -> pa.Array:
        words, p = shared.value
        data, offsets = buffers(column)
        counts, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, j in chunks(offsets):
            h, first = _words(data, offsets[i : j + 1])
            ids = words.ids(h)
            lp = np.concatenate([[0.0], np.cumsum(log_probabilities(p, windows(ids, first), ids))])
            counts.append(np.diff(first))
            sums.append(lp[first[1:]] - lp[first[:-1]])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(np.concatenate(sums))], ["n_tokens", "sum_logprob"])

    return run(text)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """``docs`` with ``_pll`` (see :func:`scored`; a column of that name is replaced), by a network trained on all of them.
    Every row stays, repeated ones too.

    These are the probabilities of the network's classes; :func:`word_likelihood` has those of words.
    """
    return docs.withColumn("_pll", scored(docs, fit(docs, text_col, id_col, rounds), F.col(text_col)))


def _bucketed(docs: DataFrame, words: Vocabulary, text: Column) -> Column:
    """The words in buckets of a text: arrays of their hashes and of how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(words.sorted)

    @F.arrow_udf("struct<key: array<long>, n: array<int>>")
    def run(column: pa.Array) -> pa.Array:
        known = shared.value
        data, offsets = buffers(column)
        keys, counts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for i, j in chunks(offsets):
            h, first = _words(data, offsets[i : j + 1])
            text = np.repeat(np.arange(j - i), np.diff(first))
            if len(known) and len(h):
                rest = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] != h
                h, text = h[rest], text[rest]
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            lead = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.zeros(0, np.int64)
            keys.append(h[lead])
            counts.append(np.diff(np.append(lead, len(h))))
            sizes.append(np.bincount(text[lead], minlength=j - i))
        at = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(np.concatenate(keys).view(np.int64))), pa.ListArray.from_arrays(at, pa.array(np.concatenate(counts).astype(np.int32)))], ["key", "n"])

    return run(text)


def word_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all) of ``docs`` with ``_pll``: as :func:`pseudo_likelihood`, but with the probability of every word.

    Over the words of the corpus these probabilities sum to one. Every row stays. The columns are written in between: name
    those that are needed.
    """
    columns = docs.columns if columns is None else columns
    counts = kept(word_counts(docs, text_col), "words")
    words, p = fit(docs, text_col, id_col, rounds, counts=counts)
    frequent = docs.sparkSession.createDataFrame([(int(k),) for k in words.sorted.view(np.int64)], "key long")
    rare = counts.join(F.broadcast(frequent), "key", "left_anti").withColumn("bucket", F.col("key").bitwiseAND(F.lit(BUCKETS - 1)))
    totals = rare.groupBy("bucket").agg(F.sum("c").alias("total"))
    share = rare.join(F.broadcast(totals), "bucket").select("key", F.log(F.col("c") / F.col("total")).alias("share"))
    rows = docs.withColumns({"_pll": scored(docs, (words, p), F.col(text_col)), "_rare": _bucketed(docs, words, F.col(text_col))})
    rows = kept(rows.select(*columns, "_pll", "_rare", F.monotonically_increasing_id().alias("_row")), "scored")
    pairs = rows.select("_row", F.explode(F.arrays_zip("_rare.key", "_rare.n")).alias("x")).select("_row", "x.key", "x.n")
    cost = pairs.join(share, "key").groupBy("_row").agg(F.sum(F.col("n") * F.col("share")).alias("_cost"))
    total = F.col("_pll.sum_logprob") + F.coalesce("_cost", F.lit(0.0))
    return rows.join(cost, "_row", "left").withColumn("_pll", F.struct(F.col("_pll.n_tokens").alias("n_tokens"), total.alias("sum_logprob"))).select(*columns, "_pll")
