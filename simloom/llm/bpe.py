"""BPE by prefix-sharing trie traversal.

A word's encoding ends in one token; so does that of each of its prefixes. The last token of a prefix is the suffix token
whose left neighbour, the last token of what precedes it, may stand before it (two tokens may stand side by side if no
merge would join across them first). The distinct words of a block of text are inserted into a trie; its nodes are
visited depth first (words in byte order: the stack is the path), and each node's state is found once from its parents'.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK, buffers, chunks, model
from .words import Splitter, Table

_NEVER = 1 << 60


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in the files: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A byte-level BPE of the tokenizers library, read from its JSON text."""

    def __init__(self, text: str, limit: int = 1 << 20):
        spec = json.loads(text)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are read")
        byte = _byte_of()
        self.bytes: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in model["vocab"].items()}
        ids = {b: i for i, b in self.bytes.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merge: dict[int, int] = {}  # left << 20 | right: rank
        self.made: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for rank, m in enumerate(model["merges"]):
            a, b = (bytes(byte[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            left, right = ids[a], ids[b]
            self.merge.setdefault(left << 20 | right, rank)
            self.made.setdefault(ids[a + b], (left, right, rank))
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.text = {i: str(i).encode() for i in self.bytes}
        self.split = Splitter(list(self.special))
        self.table = Table(self.learn, np.uint16 if max(self.bytes) < 1 << 16 else np.uint32, limit)
        self.pairs: dict[int, bool] = {}
        self.ends: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self._automaton(ids)

    def _automaton(self, ids: dict[bytes, int]) -> None:
        """States are the prefixes of tokens; of each state the tokens that are its suffixes, longest first."""
        step: dict[int, int] = {}
        token: list[int] = [-1]
        for b, i in ids.items():
            s = 0
            for c in b:
                key = s << 8 | c
                s = step.get(key, 0)
                if not s:
                    s = step[key] = len(token)
                    token.append(-1)
            token[s] = i
        fail, out, order = [0] * len(token), [()] * len(token), sorted(step.items(), key=lambda x: x[1])
        depth = [0] * len(token)
        for key, s in order:
            depth[s] = depth[key >> 8] + 1
        for key, s in sorted(order, key=lambda x: depth[x[1]]):
            p, c = key >> 8, key & 255
            f = fail[p]
            while p:
                if (t := step.get(f << 8 | c)) is not None:
                    fail[s] = t
                    break
                if not f:
                    break
                f = fail[f]
            own = ((token[s], depth[s]),) if token[s] >= 0 else ()
            out[s] = own + out[fail[s]]
        self.step, self.fail, self.out = step, fail, out

    def _next(self, s: int, c: int) -> int:
        key = s << 8 | c
        t = self.step.get(key)
        if t is None:
            t = self._next(self.fail[s], c) if s else 0
            if len(self.step) < 600_000:
                self.step[key] = t
        return t

    def _edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """The tokens on t's right (1) or left (0) edge as it grew, each with the rank of the merge that took it up."""
        found = self.ends[side].get(t)
        if found is None:
            found, x, taken = [], t, _NEVER
            while True:
                found.append((x, taken))
                if x not in self.made:
                    break
                taken = self.made[x][2]
                x = self.made[x][side]
            self.ends[side][t] = found
        return found

    def _beside(self, a: int, b: int) -> bool:
        """Whether no merge joins across a and b before both are whole. Of merges of equal rank the left one is first."""
        merge = self.merge
        for x, dx in self._edge(a, 1):
            for y, dy in self._edge(b, 0):
                r = merge.get(x << 20 | y)
                if r is not None and r < dx and r <= dy:
                    return False
        return True

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Inserts new words into a trie and encodes all of them in one depth-first traversal.

        How many ids each word has, and the ids of all words in a row.
        """
        pairs, step, out, beside = self.pairs, self.step, self.out, self._beside
        if len(pairs) > 500_000:
            pairs.clear()
        states, last, width = [0], [-1], [0]
        before = b""
        found: dict[str, list[int]] = {t: [i] for t, i in self.special.items()}
        for word in sorted(set(words) - found.keys()):  # the order of code points is that of UTF-8
            raw = word.encode("utf-8", "surrogatepass")
            n, d = len(raw), 0
            for x, y in zip(before, raw):  # noqa: B905  what they share stays on the stack
                if x != y:
                    break
                d += 1
            del states[d + 1 :], last[d + 1 :], width[d + 1 :]
            s = states[d]
            for i in range(d, n):
                s2 = step.get(s << 8 | raw[i])
                s = self._next(s, raw[i]) if s2 is None else s2
                for t, k in out[s]:
                    if k > i:  # the whole prefix
                        break
                    p = last[i + 1 - k]
                    key = p << 20 | t
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = beside(p, t)
                    if ok:
                        break
                states.append(s)
                last.append(t)
                width.append(k)
            ids, i = [], n
            while i:
                ids.append(last[i])
                i -= width[i]
            ids.reverse()
            found[word] = ids
            before = raw
        every = [found[word] for word in words]
        counts = np.fromiter(map(len, every), np.int32, len(every))
        return counts, np.fromiter(chain.from_iterable(every), np.int64, int(counts.sum()))

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and n + 1 offsets of texts into them."""
        starts, ends, first = self.split(data, offsets)
        ids, upto = self.table.ids(data, starts, ends)
        return ids, upto[first]


def _model(shared) -> Bpe:
    """One model a Python worker, whatever tasks it runs."""
    text = shared.value
    return model(("bpe", hash(text)), lambda: Bpe(text))


def read(spark: SparkSession, path: str):
    """The tokenizer file at the driver's ``path``, shared with the executors."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(model: Bpe, column: pa.Array, limit: int = 4 * CHUNK) -> Iterable[np.ndarray]:
    """The ids of each text. A null is an empty text."""
    data, offsets = buffers(column)
    for i, j in chunks(offsets, limit):
        ids, first = model.encoded(data, offsets[i : j + 1])
        first = first.tolist()
        for a, b in zip(first, first[1:]):  # noqa: B905
            yield ids[a:b]


def ids_column(shared, text: Column) -> Column:
    """array<int>: the ids of a text (null: none)."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([x.astype(np.int32) for x in _encoded(_model(shared), column)], pa.list_(pa.int32()))

    return run(text)


def decoded_column(shared, ids: Column) -> Column:
    """string: the text of ids; bytes that are no UTF-8 become U+FFFD. Null ids: null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        get = _model(shared).bytes.__getitem__
        return pa.array([None if x is None else b"".join(map(get, x)).decode("utf-8", "replace") for x in column.to_pylist()], pa.string())

    return run(ids)


def digest_column(shared, text: Column) -> Column:
    """struct of n_tokens, ids_sha256, decoded_sha256: the round trip's digests, so that no ids leave the worker."""

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def run(column: pa.Array) -> pa.Array:
        model, counts, a, b = _model(shared), [], [], []
        decimal, raw = model.text.__getitem__, model.bytes.__getitem__
        for x in _encoded(model, column):
            ids = x.tolist()
            counts.append(len(ids))
            a.append(hashlib.sha256(b",".join(map(decimal, ids))).hexdigest())
            b.append(hashlib.sha256(b"".join(map(raw, ids)).decode("utf-8", "replace").encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row. Null and empty texts have no ids."""
    shared = read(docs.sparkSession, path)
    got = docs.select(F.col(id_col).alias("doc_id"), digest_column(shared, F.col(text_col)).alias("_r"))
    return got.select("doc_id", "_r.n_tokens", "_r.ids_sha256", "_r.decoded_sha256")
