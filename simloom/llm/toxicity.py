"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector (a known word) beside the mean vector of its hashed character n-grams. Both directions
run over windows of ``SPAN`` words that start every ``STRIDE`` words, so windows overlap and the last one ends with the
text; attention pools a window's states into a logit. A text's score comes from the logits of all its windows: the
largest, the mean of the two largest, and how many windows there are, through a logistic fit.

Only texts have labels, so windows are learned in rounds: first those whose words the labels favour most, then those the
network itself scores highest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, buffers, chunks, learned, only, spans, word_bounds, word_hashes
from .langid import _FOLD, _GAP, _grams, held_out

SPAN, STRIDE = 24, 12
_D, _H, _CHARS, _VOCAB = 8, 8, 8192, 8192


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, n + 1 offsets of texts into them, char n-grams, and where each word's begin."""
    hashes, grams, sizes, at = [], [], [], []
    for piece in spans(data, offsets):
        starts, ends, _ = word_bounds(data, piece, _GAP)
        gram, begin, _ = _grams(data, piece)
        hashes.append(word_hashes(data, starts, ends, _FOLD))
        grams.append((gram & (_CHARS - 1)).astype(np.uint16))
        sizes.append(np.diff(np.append(begin, len(gram))))
        at.append(starts)
    size = np.concatenate(sizes)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(at), offsets), np.concatenate(grams), np.cumsum(size) - size


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of every window; a text without words has one of length 0."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - SPAN) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * STRIDE, np.maximum(n[owner] - SPAN, 0)) + first[:-1][owner]
    return start, np.minimum(n[owner], SPAN), owner


class Net:
    """Parameters, forward and backward pass."""

    def __init__(self, vocab: np.ndarray, lean: np.ndarray, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        self.vocab = vocab  # sorted hashes of known words
        word = f(len(vocab) + 1, _D, k=0.1)
        word[1:, 0] = lean  # what the labels say of a word alone
        word[0] = 0
        self.p = {"word": word, "char": f(_CHARS, _D, k=0.1), "wx": f(2 * _D, 6 * _H), "bx": np.zeros(6 * _H, np.float32), "uf": f(_H, 3 * _H), "ub": f(_H, 3 * _H), "v": f(2 * _H), "w": f(2 * _H), "b": np.zeros(1, np.float32)}
        self.mean, self.fit = None, None

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocab) or not len(h):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + 1, 0)

    def inputs(self, ids: np.ndarray, gram: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(np.append(begin, len(gram)))
        chars = np.add.reduceat(self.p["char"][gram], begin, axis=0) / size[:, None].astype(np.float32) if len(begin) else np.zeros((0, _D), np.float32)
        return np.hstack([self.p["word"][ids], chars]), size

    def run(self, xp: np.ndarray, at: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows whose rows of ``xp`` are ``at`` (T by B); ``keep`` also returns what the backward pass needs."""
        T, B = at.shape
        mask = np.arange(T)[:, None] < length
        whole = bool(mask.all())
        states, saved = [], []
        for d, u in ((0, self.p["uf"]), (1, self.p["ub"])):
            h, out, steps = np.zeros((B, _H), np.float32), np.empty((T, B, _H), np.float32), []
            cols = slice(3 * _H * d, 3 * _H * (d + 1))
            own = xp[:, cols]
            for t in range(T) if d == 0 else range(T - 1, -1, -1):
                x, g = own[at[t]], h @ u
                zr = _sig(x[:, : 2 * _H] + g[:, : 2 * _H])
                z, r, m = zr[:, :_H], zr[:, _H:], g[:, 2 * _H :]
                c = np.tanh(x[:, 2 * _H :] + r * m)
                new = h + z * (c - h)
                if not whole:
                    new = np.where(mask[t][:, None], new, h)
                if keep:
                    steps.append((t, h, z, r, m, c))
                h = out[t] = new
            states.append(out)
            saved.append(steps)
        hs = np.concatenate(states, axis=2)
        score = hs @ self.p["v"]
        if not whole:
            score = np.where(mask, score, np.float32(-1e9))
        a = np.exp(score - score.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, hs)
        logit = pooled @ self.p["w"] + self.p["b"][0]
        return (logit, hs, a, pooled, mask, saved) if keep else logit

    def step(self, xp, at, length, y, weight):
        """Gradients of the weighted log loss: of xp's rows (by window and place) and of the other parameters."""
        logit, hs, a, pooled, mask, saved = self.run(xp, at, length, keep=True)
        T, B = at.shape
        d = (weight * (_sig(logit) - y) / weight.sum()).astype(np.float32)
        g = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        dp = d[:, None] * self.p["w"]
        dots = np.einsum("tbh,bh->tb", hs, dp)
        ds = a * (dots - (a * dots).sum(0))
        g["v"] = np.einsum("tb,tbh->h", ds, hs)
        dh_all = a[:, :, None] * dp + ds[:, :, None] * self.p["v"]
        dx = np.zeros((T, B, 6 * _H), np.float32)
        for k, name in ((0, "uf"), (1, "ub")):
            u, gu, dh = self.p[name], np.zeros_like(self.p[name]), np.zeros((B, _H), np.float32)
            for t, h, z, r, m, c in reversed(saved[k]):
                dn = dh + dh_all[t, :, _H * k : _H * (k + 1)]
                on = dn * mask[t][:, None]
                dz, dc = on * (c - h) * z * (1 - z), on * z * (1 - c * c)
                dr, dm = dc * m * r * (1 - r), dc * r
                gates = np.hstack([dz, dr, dm])
                dx[t, :, 3 * _H * k : 3 * _H * (k + 1)] = np.hstack([dz, dr, dc])
                gu += h.T @ gates
                dh = dn - on * z + gates @ u.T
            g[name] = gu
        return dx, g

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Logit, text and (start, length) of all windows of the texts, so many windows at a time."""
        h, first, gram, begin = _words(data, offsets)
        ids, upto = self.ids(h), np.append(begin, len(gram))
        start, length, owner = _windows(first)
        out = np.empty(len(start), np.float32)
        step = np.arange(SPAN)[:, None]
        for w0 in range(0, len(start), 16384):
            own = np.arange(w0, min(w0 + 16384, len(start)))
            a, b = int(start[own[0]]), int((start[own] + length[own]).max())  # windows are in the order of their words
            x, _ = self.inputs(ids[a:b], gram[upto[a] : upto[b]], begin[a:b] - upto[a])
            xp = np.vstack([x @ self.p["wx"] + self.p["bx"], np.zeros((1, 6 * _H), np.float32)])
            full = length[own] == SPAN
            for part in (own[full], own[~full]):
                for i in range(0, len(part), 2048):
                    w = part[i : i + 2048]
                    out[w] = self.run(xp, np.where(step < length[w], start[w] - a + step, len(xp) - 1), length[w])
        return out, owner, (start, length)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """By text: the largest logit, the mean of the two largest, log of the number of windows."""
        logit, owner, _ = self.logits(data, offsets)
        n = len(offsets) - 1
        order = np.lexsort((-logit, owner))
        lead = np.searchsorted(owner, np.arange(n))
        count = np.diff(np.append(lead, len(owner)))
        top = logit[order][lead]
        second = np.where(count > 1, logit[order][np.minimum(lead + 1, len(logit) - 1)], top)
        return np.column_stack([top, (top + second) / 2, np.log(count)]).astype(np.float64)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.fit is None:
            return np.full(len(offsets) - 1, 0.0)
        return _sig(np.clip(self.features(data, offsets), -25, 25) @ self.fit[:-1] + self.fit[-1])


def _lean(hashes: np.ndarray, owner: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of at least two texts, by hash, and each one's smoothed log odds of the label."""
    order = np.lexsort((owner, hashes))
    word, text = hashes[order], owner[order]
    lead = np.concatenate([[True], (word[1:] != word[:-1]) | (text[1:] != text[:-1])]) if len(word) else np.zeros(0, bool)
    word, text = word[lead], text[lead]  # once a text
    words, at, n = np.unique(word, return_inverse=True, return_counts=True)
    pos = np.bincount(at, weights=y[text], minlength=len(words))
    rate = y.mean()
    lean = np.log((pos + 3 * rate) / (n - pos + 3 * (1 - rate))) - np.log(rate / (1 - rate))
    keep = np.flatnonzero(n >= 2)
    keep = np.sort(keep[np.argsort(-np.abs(lean[keep]) * np.log1p(n[keep]), kind="stable")[:_VOCAB]])
    return words[keep], np.clip(lean[keep], -4, 4).astype(np.float32)


def train(texts: pa.Array, y: np.ndarray, prior: float, rounds: int = 3, epochs: int = 2, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Net:
    """Fits the network to labelled texts, of which ``prior`` are positive where they come from."""
    rng = np.random.default_rng(seed)
    data, offsets = buffers(texts)
    parts = []
    for i, j in chunks(offsets):  # small pieces in narrow types: the sample need not fit in memory many times over
        h, first, gram, begin = _words(data, offsets[i : j + 1])
        parts.append((h, np.diff(first).astype(np.int32), gram.astype(np.uint16), np.diff(np.append(begin, len(gram))).astype(np.int32)))
    h, counts, gram, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    first = np.concatenate([[0], np.cumsum(counts)])
    begin = (np.cumsum(size, dtype=np.int64) - size).astype(np.int32)
    owner_w = np.repeat(np.arange(len(y), dtype=np.int32), counts)
    net = Net(*_lean(h, owner_w, y))
    ids = np.concatenate([net.ids(x) for x in np.array_split(h, 64)]).astype(np.int32)
    del h, owner_w
    start, length, owner = _windows(first)
    ok = length > 0
    start, length, owner = start[ok], length[ok], owner[ok]
    sums = np.concatenate([[0], np.cumsum(np.where(ids > 0, np.maximum(net.p["word"][ids, 0], 0), 0))])
    key = sums[start + length] - sums[start]
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    weight_of = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    weight_of = np.where(y == 1, np.sqrt(weight_of.max() / np.maximum(weight_of, 1e-9)) * weight_of, weight_of)
    for turn in range(rounds):
        if turn:
            key = np.concatenate([net.logits(data, offsets[i : j + 1])[0] for i, j in chunks(offsets)])[ok]
        order = np.lexsort((rng.random(len(key)), -key, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        picked = order[rank < 2]
        other = rng.permutation(np.flatnonzero(y[owner] == 0))[: len(picked)]
        picked = np.concatenate([picked, other])
        for _ in range(epochs):
            for w in np.array_split(rng.permutation(picked), max(1, len(picked) // batch)):
                at = np.minimum(start[w] + np.arange(SPAN)[:, None], start[w] + length[w] - 1)
                used, back = np.unique(at, return_inverse=True)
                lens = size[used].astype(np.int64)
                pick = np.repeat(begin[used] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
                grams, at_w = gram[pick], np.repeat(np.arange(len(used)), lens)
                x, _ = net.inputs(ids[used], grams, np.cumsum(lens) - lens)
                xp = x @ net.p["wx"] + net.p["bx"]
                back = back.reshape(at.shape)
                dx, g = net.step(xp, back, length[w], y[owner[w]], weight_of[owner[w]])
                dxp = np.zeros_like(xp)
                np.add.at(dxp, back.ravel(), dx.reshape(-1, 6 * _H))
                g["wx"], g["bx"] = x.T @ dxp, dxp.sum(0)
                dinput = dxp @ net.p["wx"].T
                g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
                np.add.at(g["word"], ids[used], dinput[:, :_D])
                g["word"][0] = 0
                np.add.at(g["char"], grams, (dinput[:, _D:] / lens[:, None])[at_w])
                step += 1
                lr = rate * min(1, step / 20) * (0.3 if turn == rounds - 1 else 1)
                for k, x_ in net.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    x_ -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    f = np.vstack([np.clip(net.features(data, offsets[i : j + 1]), -25, 25) for i, j in chunks(offsets)])
    a, b = np.column_stack([f, np.ones(len(f))]), np.zeros(4)
    true = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    for _ in range(30):  # Newton steps
        s = _sig(a @ b)
        grad = a.T @ (true * (s - y)) + 1e-2 * b
        b = b - np.linalg.solve(a.T @ (a * (true * s * (1 - s))[:, None]) + 1e-2 * np.eye(4), grad)
    net.fit = b
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2500, most_bytes: int = 1 << 24) -> Net:
    """Learns from at most about ``per_class`` labelled texts and ``most_bytes`` of a class (documented bounds), drawn by hashes.

    Conflicting or repeated labels of an id: toxic wins; a text that repeats under its id counts once. Without labels of
    both classes every score is 0.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    y = y.withColumn("_h", F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 20)))
    counts = {r["_y"]: r["count"] for r in y.groupBy("_y").count().collect()}
    if set(counts) != {0, 1}:
        return Net(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    share = lambda by, rate: F.col(by) < F.when(F.col("_y") == 1, int(min(1, rate[1]) * (1 << 20))).otherwise(int(min(1, rate[0]) * (1 << 20)))
    some = y.where(share("_h", {c: per_class / n for c, n in counts.items()}))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_d"), F.col(text_col).alias("t")).join(F.broadcast(some), F.col("_d") == F.col("_id"))
    rows = rows.withColumn("_k", F.pmod(F.xxhash64("_id", "t"), F.lit(1 << 20)))
    found = {r["_y"]: (r["n"], r["b"]) for r in rows.groupBy("_y").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).collect()}
    rate = {c: min(1.5 * per_class / n, most_bytes / max(1, b)) for c, (n, b) in found.items()} | {c: 1.0 for c in counts if c not in found}
    sample = rows.where(share("_k", rate)).groupBy("_id", "_y", "t").count().select("_id", "t", "_y")
    return learned(sample, lambda got: _trained(got, counts[1] / (counts[0] + counts[1])))


def _trained(got: pa.Table | None, prior: float) -> Net:
    if got is None or len(set(got.column("_y").to_pylist())) < 2:
        return Net(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    got = got.sort_by([("_id", "ascending"), ("t", "ascending")])
    return train(got.column("t"), np.array(got.column("_y").to_pylist(), np.float64), prior)


def scored(net: Net, docs: DataFrame, text: Column) -> Column:
    """double, 0 to 1. Null and empty texts have a score too, that of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        only()
        data, offsets = buffers(column)
        return pa.array(np.concatenate([np.zeros(0), *(shared.value.score(data, offsets[i : j + 1]) for i, j in chunks(offsets, CHUNK))]))

    return run(text)


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2500) -> DataFrame:
    """``docs`` with ``_toxic`` (the score; a column of that name is replaced), learned from labels of ids that are not held
    out. Every row stays, repeated ones too; null and blank texts are scored as texts without words."""
    net = fit(docs, labels.where(~held_out(id_col, 5, 0)), id_col, text_col, label_col, per_class)
    return docs.withColumn("_toxic", scored(net, docs, F.col(text_col)))
