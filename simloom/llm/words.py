"""Texts of byte-level BPE as words: the split of whole buffers in numpy, and a bounded table of the words met so far.

What stands on both sides of a word's bounds never merges, so a text's ids are those of its words, one after another, and
each distinct word has to be encoded once. Words are told apart by a 64-bit hash of their bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import regex

from .common import spans, word_hashes

#: How byte-level BPE files split words (fixed).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _SPACE, _NUMBER = range(4)
_BLANK, _QUOTE = 32, 39
_AS_IS = np.arange(256, dtype=np.uint8)


@cache
def _kinds() -> np.ndarray:
    """Of every code point whether it is a letter, white space, a number or something else."""
    every, out = "".join(map(chr, range(0x110000))), np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def _characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each begins."""
    if not (raw >= 0x80).any():
        return raw, np.arange(len(raw))
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    code = raw[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    lead, p, last = code[wide], at[wide], len(raw) - 1
    b = [raw[np.minimum(p + k, last)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
    two, three = (lead & 0x1F) << 6 | b[0], (lead & 0x0F) << 12 | b[0] << 6 | b[1]
    four = (lead & 0x07) << 18 | b[0] << 12 | b[1] << 6 | b[2]
    code[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, np.minimum(four, 0x10FFFF)))
    return code, at


class Splitter:
    """Splits texts as :data:`PATTERN` does, around the texts of special tokens, which stay whole."""

    def __init__(self, special: list[str]):
        self.special = [t.encode() for t in sorted(special, key=len, reverse=True)]
        self.cut = regex.compile(b"|".join(map(regex.escape, self.special))) if special else None

    def _specials(self, raw: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        if self.cut is None or not any(t in raw for t in self.special):
            return []
        return [m.span() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.cut.finditer(raw, i, j)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts ``data[offsets[i]:offsets[i+1]]``: starts and ends of words in data, and n + 1 offsets into these.

        Long texts go in pieces that begin with a blank after a letter: there a word ends, whatever stands around.
        """
        parts = [self._starts(data, x) for x in spans(data, offsets)]
        starts = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return starts, np.append(starts[1:], offsets[-1]) if len(starts) else starts, np.searchsorted(starts, offsets)

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        lo, hi = int(offsets[0]), int(offsets[-1])
        if lo == hi:
            return np.zeros(0, np.int64)
        raw = data[lo:hi]
        spans = self._specials(raw.tobytes(), offsets - lo)
        code, at = _characters(raw)
        n = len(code)
        kind = _kinds()[code]
        edge = np.zeros(n + 1, bool)  # where a text, or a piece beside a special token, begins
        edge[np.searchsorted(at, np.concatenate([offsets - lo, *map(np.array, spans)]))] = True
        start = edge[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # the last blank before a word goes with it; the white space before that, or other white space, is a word
        space = kind == _SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n])
        start[last] = True
        start[last[code[last] == _BLANK] + 1] = False
        self._contractions(code, kind, edge, start)
        for a, b in spans:
            i, j = np.searchsorted(at, [a, b])
            start[i + 1 : j] = False
        return at[np.flatnonzero(start)] + lo

    @staticmethod
    def _contractions(code: np.ndarray, kind: np.ndarray, edge: np.ndarray, start: np.ndarray) -> None:
        """A quote that begins a word takes s, t, m, d, re, ve or ll after it; what follows these is a new word."""
        n = len(code)
        q = np.flatnonzero((code[:-1] == _QUOTE) & start[:-1] & ~edge[1:n] & (kind[1:] == _LETTER))
        if not len(q):
            return
        a = code[q + 1]
        b = np.where((q + 2 < n) & ~edge[np.minimum(q + 2, n)], code[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[q[one | two] + 1] = False
        after = np.concatenate([q[one] + 2, q[two] + 3])
        start[after[after < n]] = True


def _longer(buffer: np.ndarray, size: int, more: np.ndarray) -> np.ndarray:
    """``buffer`` with ``more`` after its first ``size`` elements; it doubles when it is full."""
    if size + len(more) > len(buffer):
        buffer = np.concatenate([buffer[:size], np.empty(max(size, len(more)), buffer.dtype)])
    buffer[size : size + len(more)] = more
    return buffer


class Table:
    """Ids of words, by hash. ``learn`` gives the ids of words that are new: how many each has, and all of them in a row.

    Past ``limit`` words it starts anew, so memory is bounded (some 60 bytes a word) and results never change.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type = np.uint32, limit: int = 1 << 20):
        self.learn, self.dtype, self.limit, self.bits = learn, dtype, limit, (2 * limit - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.numbers, self.size = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 0
        self.counts, self.begins, self.flat, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.dtype), 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out, todo, slot = np.full(len(h), -1, np.int32), np.arange(len(h)), self._slots(h)
        while len(todo):
            number = self.numbers[slot]
            hit = (self.keys[slot] == h[todo]) & (number >= 0)
            out[todo[hit]] = number[hit]
            on = (number >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def _put(self, h: np.ndarray, words: list[str]) -> None:
        counts, ids = self.learn(words)
        self.counts = _longer(self.counts, self.size, counts)
        self.begins = _longer(self.begins, self.size, self.used + np.cumsum(counts) - counts)
        self.flat = _longer(self.flat, self.used, ids)
        number, slot = np.arange(self.size, self.size + len(h), dtype=np.int32), self._slots(h)
        self.size, self.used = self.size + len(h), self.used + len(ids)
        while len(h):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = number[free]
            won = self.numbers[slot] == number
            self.keys[slot[won]] = h[won]
            h, number, slot = h[~won], number[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = word_hashes(data, starts, ends, _AS_IS)
        out = self._find(h)
        if (out < 0).any():
            miss = np.flatnonzero(out < 0)
            new, lead = np.unique(h[miss], return_index=True)
            if self.size and self.size + len(new) > self.limit:
                self._clear()
                return self._numbers(data, starts, ends)
            if len(new) > self.limit:
                raise ValueError(f"more than {self.limit} words at a time")
            at = miss[lead]
            self._put(new, [data[s:e].tobytes().decode("utf-8", "surrogatepass") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            out[miss] = self._find(h[miss])
        return out

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words ``data[start:end]`` in a row, and for n words n + 1 offsets into them."""
        every, ends_of = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        for i in range(0, len(starts), self.limit):  # a piece never has more new words than the table holds
            number = self._numbers(data, starts[i : i + self.limit], ends[i : i + self.limit])
            counts = self.counts[number].astype(np.int64)
            upto = np.cumsum(counts)
            every.append(self.flat[np.repeat(self.begins[number] - upto + counts, counts) + np.arange(upto[-1])])
            ends_of.append(upto + ends_of[-1][-1])
        return np.concatenate(every), np.concatenate(ends_of)
