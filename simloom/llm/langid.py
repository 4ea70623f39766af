"""Language identification as mixture inference.

Words draw their language from the document's proportions; a word's likelihood under a language is the product of its
byte n-grams' (hashed, smoothed, estimated from labelled documents). Expectation-maximisation estimates the proportions.
Among the nested sets of languages, largest proportion first, the one with the best likelihood less a penalty for each
language is chosen; the prediction is the largest in it and the score its proportion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, buffers, chunks, learned, only, spans, word_bounds

_ORDER, _BITS = 4, 16
_FOLD = np.full(256, 32, np.uint8)  # letters and bytes above ASCII stand for themselves, the rest parts words
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_GAP = _FOLD == 32
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # 2^bits by language

    @property
    def size(self) -> int:
        return len(self.langs)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each byte of a word, where words begin among them, and n + 1 offsets into words."""
    starts, ends, first = word_bounds(data, offsets, _GAP)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, first
    size = ends - starts
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    at = np.repeat(starts, size) + place
    code = _FOLD[data[at]].astype(np.uint64)
    key = code.copy()
    for k in range(1, _ORDER):
        before = np.empty_like(code)
        before[:k] = 32
        before[k:] = code[:-k]
        key |= np.where(place >= k, before, np.uint64(32)) << np.uint64(8 * k)
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64), begin, first


def fit(docs: DataFrame, text_col: str, lang_col: str, id_col: str, per_lang: int = 1500, smoothing: float = 0.5, most_bytes: int = 1 << 25) -> Model:
    """Learns from at most about ``per_lang`` labelled documents and ``most_bytes`` of a language (documented bounds), drawn
    by a hash of id and text; a text that repeats under its id counts once.

    ``docs`` holds only rows that may be learned from; those of null text or language are left out.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(1 << 20)).alias("h"))
    sums = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()
    counts = {r["lang"]: max(r["n"], r["b"] * per_lang / most_bytes) for r in sums}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((1 << _BITS, 0), np.float32))
    rate = F.coalesce(*(F.when(F.col("lang") == x, F.lit(int(min(1.0, per_lang / counts[x]) * (1 << 20)))) for x in langs))
    sample = rows.where(F.col("h") < rate).groupBy("h", "text", "lang").count().select("text", "lang")
    return learned(sample, lambda table: _counted(table, langs, smoothing))


def _counted(table: pa.Table | None, langs: list[str], smoothing: float) -> Model:
    freq = np.zeros((1 << _BITS, len(langs)))
    if table is not None:
        code = {x: i for i, x in enumerate(langs)}
        owner = np.array([code[x] for x in table.column("lang").to_pylist()], np.int64)
        data, offsets = buffers(table.column("text"))
        for i, j in chunks(offsets):
            gram, begin, first = _grams(data, offsets[i : j + 1])
            if len(gram):
                doc = np.repeat(np.arange(i, j), np.diff(np.append(begin, len(gram))[first]))
                freq += np.bincount(gram * len(langs) + owner[doc], minlength=freq.size).reshape(freq.shape)
    logp = np.log((freq + smoothing) / (freq.sum(0) + smoothing * len(freq)))
    return Model(langs, logp.astype(np.float32))


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows by document; a document may have none."""
    out = np.zeros((len(first) - 1, *x.shape[1:]))
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.add.reduceat(x, first[some], axis=0)
    return out


def _em(p: np.ndarray, first: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``rounds`` steps, and the log-likelihood (up to what all sets share) they have."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = np.maximum(np.diff(first), 1)[:, None]
    for _ in range(rounds):
        r = p * pi[owner].astype(np.float32)
        r /= r.sum(1, keepdims=True) + np.float32(1e-30)
        pi = _sums(r, first) / n
    return pi, _sums(np.log((p * pi[owner].astype(np.float32)).sum(1) + 1e-30), first)


def infer(model: Model, data: np.ndarray, offsets: np.ndarray, penalty: float = 3.0, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen set by document and language, and the number of words. No word: all zero."""
    parts, n = [], np.zeros(len(offsets) - 1, np.int64)
    for piece in spans(data, offsets):
        gram, begin, first = _grams(data, piece)
        n += np.bincount(np.clip(np.searchsorted(offsets, piece[:-1], side="right") - 1, 0, max(0, len(n) - 1)), weights=np.diff(first), minlength=len(n)).astype(np.int64)
        if len(begin):
            parts.append(np.add.reduceat(model.logp[gram], begin, axis=0))
    if not parts or not model.size:
        return np.zeros((len(n), model.size)), n
    ll, first = np.concatenate(parts), np.concatenate([[0], np.cumsum(n)])
    p = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -20.0))
    alone = _sums(np.log(p), first)
    best, docs = alone.argmax(1), np.arange(len(n))
    out = np.zeros((len(n), model.size))
    out[docs, best] = 1.0
    score = alone[docs, best] - penalty
    pi, full = _em(p, first, np.full(out.shape, 1.0 / model.size), rounds)
    rank = np.argsort(-pi, axis=1, kind="stable")
    open_ = np.flatnonzero((full - 2 * penalty > score) & (n > 0))  # for the rest no larger set can win
    for size in range(2, model.size + 1):
        if not len(open_):
            break
        of = np.repeat(np.isin(np.arange(len(n)), open_), n)
        f = np.concatenate([[0], np.cumsum(n[open_])])
        start = np.zeros((len(open_), model.size))
        np.put_along_axis(start, rank[open_, :size], np.take_along_axis(pi[open_], rank[open_, :size], 1) + 1e-3, axis=1)
        got, like = _em(p[of], f, start / start.sum(1, keepdims=True), rounds)
        wins = like - size * penalty > score[open_]
        out[open_[wins]] = got[wins]
        score[open_[wins]] = (like - size * penalty)[wins]
    out[n == 0] = 0
    return out, n


def predict(model: Model, docs: DataFrame, text: Column, penalty: float = 3.0) -> Column:
    """struct of lang, score and proportions. A text that is null or has no letter: ``und``, 0 and none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, proportions: array<double>>")
    def run(column: pa.Array) -> pa.Array:
        m = shared.value
        only()
        data, offsets = buffers(column)
        langs, scores, parts = [], [], []
        for i, j in chunks(offsets, CHUNK):
            pi, _ = infer(m, data, offsets[i : j + 1], penalty)
            texts = column.slice(i, j - i)
            for k in range(j - i):
                t = texts[k].as_py()
                if t is None or not _LETTER.search(t):
                    langs.append("und"), scores.append(0.0), parts.append([])
                elif m.size:
                    b = int(pi[k].argmax())
                    langs.append(m.langs[b]), scores.append(float(min(1.0, pi[k][b]))), parts.append(pi[k].tolist())
                else:
                    langs.append("und"), scores.append(0.0), parts.append([])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(parts, pa.list_(pa.float64()))], ["lang", "score", "proportions"])

    return run(text)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Rows whose crc32 of the id as text has remainder ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1500, penalty: float = 3.0) -> DataFrame:
    """``docs`` with ``_lid`` (see :func:`predict`; a column of that name is replaced); learned from labelled rows that are
    not held out. Every row stays, repeated ones too; an empty table gives none."""
    model = fit(docs.where(~held_out(id_col, 4, 2)), text_col, lang_col, id_col, per_lang)
    return docs.withColumn("_lid", predict(model, docs, F.col(text_col), penalty))
