"""Adaptive context-mixing range coder for token ids.

A block holds whole documents and is reset: nothing in it depends on another block. Its ids are dealt to ``LANES`` lanes
that are coded side by side, each with a range coder of its own, while all lanes share and teach one model:

* order 2 and order 1: the id that last followed these two ids, or this id, and how often it was right in a row;
* order 0: adaptive counts of ids;
* the three opinions on the candidate are mixed in the logistic domain by weights that learn from every step; the mixed
  probability codes whether the candidate comes, and after a miss the id is coded by the order-0 counts.

All arithmetic is in integers, so what one machine wrote another one reads. Layout of a block, little-endian: ``SLB1``,
documents u32, ids u64, crc32 of the ids u32, lanes u32, then doc ids i64, null flags u8, lengths u32, words by lane u32,
words u16.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"SLB1"
LANES = 16384
_U = np.uint64
_TOP = _U(48)
_LOW48 = _U((1 << 48) - 1)
_B2 = 17
#: ln(p / (1 - p)) of p in 4096ths, in 256ths, and its inverse, rounded to integers.
_STRETCH = np.array([round(256 * float(np.log((i + 0.5) / (4095.5 - i)))) for i in range(4096)], np.int64)
_SQUASH = np.array([min(4095 * 16, max(16, round(65536 / (1 + float(np.exp(-(i - 3072) / 256)))))) for i in range(6145)], np.int64)
#: How sure a context is after a miss (first eight) or a hit, from how sure it was.
_AFTER = np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7], np.int64)


class _Model:
    """What coder and decoder both know after the same steps. Ids are below ``size``."""

    def __init__(self, lanes: int, size: int):
        self.size = size
        self.pred2, self.sure2 = np.zeros(1 << _B2, np.int64), np.zeros(1 << _B2, np.int64)
        self.pred1, self.sure1 = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.hits, self.seen = np.ones(128, np.int64), np.full(128, 4, np.int64)
        self.weights = np.array([20000, 20000, 12000], np.int64)
        self.count = np.ones(size, np.int64)
        self.a, self.b = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step, self.due, self.fresh = 0, 1, []
        self._sum()

    def _sum(self) -> None:
        self.cum = np.zeros(self.size + 1, np.int64)
        np.cumsum(self.count, out=self.cum[1:])
        self.total = int(self.cum[-1])
        self.odds0 = _STRETCH[np.minimum((self.count << 12) // self.total, 4095)]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ids start in the order-0 counts, and how wide they are."""
        return self.cum.take(x).view(_U), self.count.take(x).view(_U)

    def guess(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidate of each lane and its probability in 65536ths."""
        self.i2 = (self.a * 40503 + self.b * 60493) & ((1 << _B2) - 1)
        self.i1 = self.b
        self.p2, self.p1 = self.pred2.take(self.i2), self.pred1.take(self.i1)
        self.c2, self.s1 = self.sure2.take(self.i2), self.sure1.take(self.i1)
        self.cand = np.where(self.c2 > 0, self.p2, self.p1)
        self.c1 = self.s1 + np.where(self.p1 == self.cand, 72, 56)
        odds = _STRETCH[np.minimum((self.hits << 12) // self.seen, 4095)]
        self.o2, self.o1, self.o0 = odds.take(self.c2), odds.take(self.c1), self.odds0.take(self.cand)
        dot = self.o2 * self.weights[2]
        dot += self.o1 * self.weights[1]
        dot += self.o0 * self.weights[0]
        dot >>= 16
        self.p = _SQUASH.take(dot + 3072, mode="clip")
        return self.cand, self.p

    def learn(self, x: np.ndarray, hit: np.ndarray) -> None:
        right2, right1 = self.p2 == x, self.p1 == x
        err, n = (hit.astype(np.int64) << 16) - self.p, len(x)
        for k, o in ((2, self.o2), (1, self.o1), (0, self.o0)):
            self.weights[k] = min(80000, max(-20000, int(self.weights[k]) + int(np.dot(o, err)) // (n * 512)))
        for c, right in ((self.c2, right2), (self.c1, right1)):
            met = np.bincount(c + (right << 7), minlength=256).reshape(2, 128)
            self.seen += met[0] + met[1]
            self.hits += met[1]
        if self.step % 16 == 15:  # old times fade
            self.seen, self.hits = (self.seen >> 1) + 4, (self.hits >> 1) + 1
        for pred, sure, at, same, had in ((self.pred2, self.sure2, self.i2, right2, self.c2), (self.pred1, self.sure1, self.i1, right1, self.s1)):
            sure[at] = _AFTER.take(had + (same << 3))
            new = np.flatnonzero((had < 2) > same)  # missed, and not sure before
            pred[at.take(new)] = x.take(new)
        self.fresh.append(x)
        self.step += 1
        if self.step >= self.due:
            self.count += np.bincount(np.concatenate(self.fresh), minlength=self.size) << 5
            self.fresh = []
            self._sum()
            self.due = self.step + min(16, max(1, self.step // 2))
        self.a, self.b = self.b, x


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 64))
    return lanes, -(-n // lanes)


def _full(low: np.ndarray, span: np.ndarray, of: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lanes that must give a word: their top 16 bits are settled, or the span got too small."""
    same = (low ^ (low + span)) <= _LOW48
    go = np.flatnonzero(same | (span <= _LOW48))
    return go if of is None else of.take(go), low.take(go), span.take(go), same.take(go)


def encode(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of all lanes, one lane after another, and how many each has."""
    lanes, steps = _shape(len(ids))
    x = np.zeros(lanes * steps, np.int64)
    x[: len(ids)] = ids
    x = np.ascontiguousarray(x.reshape(lanes, steps).T)
    m = _Model(lanes, size)
    low, span = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    room = 4 * steps + 8
    out, first = np.zeros(lanes * room, np.uint16), np.arange(lanes) * room
    at = first.copy()
    for s in range(steps):
        now = x[s]
        cand, p = m.guess()
        hit = cand == now
        pu = p.astype(_U)
        unit = span >> _U(16)
        cut = unit * pu
        miss = unit * (_U(65536) - pu) // _U(m.total)
        start, wide = m.place(now)
        low += (cut + miss * start) * ~hit
        span = np.where(hit, cut, miss * wide)
        todo, l_, r_, same = _full(low, span, None)
        while len(todo):
            r_ = np.where(same, r_, (_U(0) - l_) & _LOW48)
            i = at.take(todo)
            out[i] = l_ >> _TOP
            at[todo] = i + 1
            l_, r_ = l_ << _U(16), r_ << _U(16)
            low[todo], span[todo] = l_, r_
            todo, l_, r_, same = _full(l_, r_, todo)
        m.learn(now, hit)
    out[at] = (low + _LOW48) >> _TOP
    count = at + 1 - first
    return np.concatenate([out[i : i + k] for i, k in zip(first.tolist(), count.tolist(), strict=True)]), count


def decode(words: np.ndarray, count: np.ndarray, n: int, size: int) -> np.ndarray:
    lanes, steps = _shape(n)
    m = _Model(lanes, size)
    data = np.concatenate([words, np.zeros(8, np.uint16)])
    end = np.cumsum(count)
    at = end - count
    low, span, code = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U), np.zeros(lanes, _U)

    def word(i: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.where(i < last, data[np.minimum(i, len(data) - 1)], 0).astype(_U)

    for _ in range(4):
        code = (code << _U(16)) | word(at, end)
        at = at + 1
    x = np.empty((steps, lanes), np.int64)
    for s in range(steps):
        cand, p = m.guess()
        pu = p.astype(_U)
        unit = span >> _U(16)
        cut = unit * pu
        v = code - low
        hit = v < cut
        now = cand.copy()
        miss = unit * (_U(65536) - pu) // _U(m.total)
        lost = np.flatnonzero(~hit)
        goal = np.minimum((v.take(lost) - cut.take(lost)) // miss.take(lost), _U(m.total - 1)).view(np.int64)
        order = np.argsort(goal)  # sorted goals are found faster
        now[lost[order]] = np.searchsorted(m.cum, goal[order], side="right") - 1
        x[s] = now
        start, wide = m.place(now)
        low += (cut + miss * start) * ~hit
        span = np.where(hit, cut, miss * wide)
        todo, l_, r_, same = _full(low, span, None)
        while len(todo):
            r_ = np.where(same, r_, (_U(0) - l_) & _LOW48)
            i = at.take(todo)
            code[todo] = (code.take(todo) << _U(16)) | word(i, end.take(todo))
            at[todo] = i + 1
            l_, r_ = l_ << _U(16), r_ << _U(16)
            low[todo], span[todo] = l_, r_
            todo, l_, r_, same = _full(l_, r_, todo)
        m.learn(now, hit)
    return x.T.ravel()[:n]


def pack(doc_ids: list[int | None], ids: list[np.ndarray], size: int) -> bytes:
    """A block of whole documents."""
    flat = np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4")
    words, count = encode(flat, size) if len(flat) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
    head = MAGIC + np.array([len(doc_ids)], "<u4").tobytes() + np.array([len(flat)], "<u8").tobytes() + np.array([zlib.crc32(flat.tobytes()), len(count)], "<u4").tobytes()
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return head + keys + np.array([len(x) for x in ids], "<u4").tobytes() + count.astype("<u4").tobytes() + words.astype("<u2").tobytes()


def unpack(raw: bytes, size: int) -> tuple[list[int | None], list[np.ndarray]]:
    """The documents of a block; ValueError if it is not whole."""
    if raw[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs = int(np.frombuffer(raw, "<u4", 1, 4)[0])
    n = int(np.frombuffer(raw, "<u8", 1, 8)[0])
    crc, lanes = (int(v) for v in np.frombuffer(raw, "<u4", 2, 16))
    at = 24
    keys, at = np.frombuffer(raw, "<i8", docs, at), at + 8 * docs
    null, at = np.frombuffer(raw, np.uint8, docs, at), at + docs
    lengths, at = np.frombuffer(raw, "<u4", docs, at).astype(np.int64), at + 4 * docs
    count, at = np.frombuffer(raw, "<u4", lanes, at).astype(np.int64), at + 4 * lanes
    words = np.frombuffer(raw, "<u2", int(count.sum()), at)
    flat = (decode(words, count, n, size) if n else np.zeros(0, np.int64)).astype("<u4")
    if zlib.crc32(flat.tobytes()) != crc or lengths.sum() != n:
        raise ValueError("a block of token ids is damaged")
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], np.split(flat, np.cumsum(lengths)[:-1]) if docs else []
