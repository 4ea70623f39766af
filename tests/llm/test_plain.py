"""Trained operators and the source mix against plain loops that follow the definitions; the SQL of this subpackage's queries."""

import math
import os
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simloom.llm import common, langid, masked_lm, mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


def column(texts):
    return common.buffers(pa.array(texts))


# 1: proportions by expectation-maximisation, sets by penalised likelihood


def plain_mixture(model, text, penalty=3.0, rounds=8):
    words, now = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            now += c
        elif now:
            words.append(now)
            now = ""

    def grams(word):
        for i in range(len(word)):
            part = ("   " + word)[i : i + 4]
            key = sum(ord(c) << (8 * (3 - j)) for j, c in enumerate(part))
            yield ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 48

    k = len(model.langs)
    like = []
    for w in words:
        ll = [sum(float(model.logp[g][i]) for g in grams(w)) for i in range(k)]
        like.append([math.exp(max(x - max(ll), -20)) for x in ll])

    def em(pi):
        for _ in range(rounds):
            shares = [[p * q for p, q in zip(row, pi, strict=True)] for row in like]
            pi = [sum(row[i] / (sum(row) + 1e-30) for row in shares) / len(like) for i in range(k)]
        return pi, sum(math.log(sum(p * q for p, q in zip(row, pi, strict=True)) + 1e-30) for row in like)

    alone = [sum(math.log(row[i]) for row in like) for i in range(k)]
    best = max(range(k), key=lambda i: alone[i])
    out, score = [float(i == best) for i in range(k)], alone[best] - penalty
    pi, _ = em([1 / k] * k)
    order = sorted(range(k), key=lambda i: -pi[i])
    for size in range(2, k + 1):
        start = [pi[i] + 1e-3 if i in order[:size] else 0.0 for i in range(k)]
        got, full = em([x / sum(start) for x in start])
        if full - size * penalty > score:
            out, score = got, full - size * penalty
    return out


def test_mixture_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, "text", "lang", "doc_id")
    by = {r.lang: r.text for r in docs.where("length(text) > 800").orderBy("doc_id").collect()}
    texts = [t[:300] for t in by.values()] + [by["en"][:200] + " " + by["de"][:200], "a", "the und le"]
    texts = ["".join(c if c.isascii() else "e" for c in t) for t in texts]
    got, _ = langid.infer(model, *column(texts))
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain_mixture(model, text), atol=2e-3), text[:50]


# 3: a word's probability from both sides


def test_window_network_against_loops():
    p, r = masked_lm.start(5), np.random.default_rng(1)
    ids = r.integers(0, masked_lm.SIZE, 9)
    ctx = masked_lm.windows(ids, np.array([0, 4, 4, 9]))
    texts = [ids[:4].tolist(), [], ids[4:].tolist()]
    want = []
    for t in texts:
        for i, y in enumerate(t):
            near = [t[j] if 0 <= j < len(t) else masked_lm.SIZE for j in (i - 2, i - 1, i + 1, i + 2)]
            x = [float(v) for j in near for v in p["e"][j]]
            h = [math.tanh(sum(a * float(p["w"][k][u]) for k, a in enumerate(x)) + float(p["b"][u])) for u in range(masked_lm.HIDDEN)]

            def log_softmax(w, b, at):
                z = [sum(a * float(w[k][u]) for k, a in enumerate(h)) + float(b[u]) for u in range(w.shape[1])]  # noqa: B023
                return z[at] - math.log(sum(map(math.exp, z)))

            c = y // masked_lm.EACH
            want.append(log_softmax(p["c"], p["cb"], c) + log_softmax(p["o"][c], p["ob"][c], y % masked_lm.EACH))
    assert np.allclose(masked_lm.log_probabilities(p, ctx, ids), want, atol=1e-4)


# 5: the recurrent network forward, and its gradient by differences


def plain_logit(net, x, length):
    p, H = {k: v.astype(float) for k, v in net.p.items()}, toxicity._H
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((length, 2 * H))
    for d, u in ((0, p["uf"]), (1, p["ub"])):
        h = np.zeros(H)
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            a, g = x[t, 3 * H * d : 3 * H * (d + 1)], h @ u
            z, r = sig(a[:H] + g[:H]), sig(a[H : 2 * H] + g[H : 2 * H])
            h = (1 - z) * h + z * np.tanh(a[2 * H :] + r * g[2 * H :])
            states[t, H * d : H * (d + 1)] = h
    e = np.exp(states @ p["v"] - (states @ p["v"]).max())
    return (e / e.sum()) @ states @ p["w"] + p["b"][0]


def test_recurrent_network_against_loops():
    r = np.random.default_rng(2)
    net = toxicity.Net(np.zeros(0, np.uint64), np.zeros(0, np.float32), seed=3)
    T, B, lengths = 7, 5, np.array([7, 7, 3, 1, 5])
    xp = r.standard_normal((T * B, 6 * toxicity._H)).astype(np.float32)
    at = np.arange(T * B).reshape(T, B)
    want = [plain_logit(net, xp[at[:, b]].astype(float), lengths[b]) for b in range(B)]
    assert np.allclose(net.run(xp, at, lengths), want, atol=1e-4)
    y, weight = np.array([1, 0, 1, 0, 1.0]), np.array([1, 2, 1, 1, 3.0])

    def loss():
        z = np.array([plain_logit(net, xp[at[:, b]].astype(float), lengths[b]) for b in range(B)])
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())

    dx, g = net.step(xp, at, lengths, y, weight)
    for name in ("uf", "ub", "v", "w", "b"):
        flat, grad = net.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for i in r.integers(0, len(flat), 4):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - grad[i]) < 2e-3, name
    for t, b, c in ((0, 0, 0), (2, 2, 9), (6, 1, 30), (3, 4, 47)):
        old = xp[at[t, b], c]
        xp[at[t, b], c] = old + 1e-2
        up = loss()
        xp[at[t, b], c] = old - 1e-2
        down = loss()
        xp[at[t, b], c] = old
        assert abs((up - down) / 2e-2 - dx[t, b, c]) < 2e-3


# 6: the schedule, a slot at a time


def plain_mix(rows, goals, slots):
    """Words taken by row: ``rows`` of (key, source, size) in the order of the shuffle, ``goals``: source, target, block length."""
    span, golden = 1 << 31, 1327217885
    goals = sorted(goals, key=lambda g: (g[0] is None, g[0] or ""))
    turns = [t / k for _, t, k in goals]
    ends, total = [], 0.0
    for x in turns:
        total += x
        ends.append(total)
    ends = [e / ends[-1] * span for e in ends]
    ends[-1] = float(span)
    blocks = {s: math.ceil(sum(n for _, o, n in rows if o == s) / k) for s, _, k in goals}
    quota = {s: min(math.floor(t / k + 0.5), 2 * blocks[s]) for s, t, k in goals}
    ranks = defaultdict(int)
    for n in range(slots):
        u = n * golden % span
        s = next(g[0] for g, e in zip(goals, ends, strict=True) if u < e)
        ranks[s] += ranks[s] < quota[s]
    taken = defaultdict(int)
    for s, _, k in goals:
        words = [key for key, o, n in rows if o == s for _ in range(n)]
        for rank in range(quota[s]):  # what the points leave out comes last
            b = rank % blocks[s]
            for key in words[b * k : (b + 1) * k]:
                taken[key] += 1
        assert ranks[s] <= quota[s]
    return taken


def test_mix_against_a_plain_schedule(spark):
    r = np.random.default_rng(5)
    data = [(i, " ".join(["w"] * int(r.integers(0, 40))), [None, "a", "b", "c"][int(r.integers(0, 4))]) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    sized = mixing.sized(df)
    order = sized.orderBy("h", "doc_id").collect()
    buckets = sorted(order, key=lambda x: ((x.h >> 20) % 4096, x.h))
    goals = mixing.targets(sized, [3, 1, 2], 1.5, 2.0).collect()
    words = sum(x.size for x in order)
    block = max(16, min(4096, words // 65536))
    length = {g.source: max(1, min(block, math.floor(min(g.target, g.source_size) / 1024))) for g in goals}
    want = plain_mix([(x.doc_id, x.source, x.size) for x in buckets], [(g.source, g.target, length[g.source]) for g in goals], round(sum(g.target / length[g.source] for g in goals)))
    got = {x.doc_id: x.taken for x in mixing.mix(df).collect()}
    assert got == {i: want.get(i, 0) for i, _, _ in data}


def test_mixed_documents_share_to_the_word(spark):
    """Rows that repeat id and text share what is taken of them; the caller's columns stay, whatever their names."""
    rows = [(1, "a b c d e f g", "s", 1, 2), (1, "a b c d e f g", "s", 1, 3), (1, "a b c d e f g", "t", 1, 4), (2, "x y z " * 9, "t", 5, 6), (3, None, None, 7, 8), (None, "q r", None, 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _t int, _h int")
    taken = mixing.mix(df).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == taken


# SQL


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    rows = lambda d: sorted(map(repr, (tuple(v.item() if hasattr(v, "item") else v for v in r) for r in d[sorted(d.columns)].itertuples(index=False, name=None))))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# long texts go in pieces


def test_pieces_of_long_texts(monkeypatch):
    """Cut into small pieces, texts have the ids, proportions, words and n-grams that they have whole."""
    import random

    import public_tokenizers
    from simloom.llm import token_files, words

    r = random.Random(3)
    parts = ["le", "monde", "é", "the", "x" * 50, "'s", "don't", " ", "\n", "a b", "<|endoftext|>", "12", "?!"]
    texts = ["".join(r.choice(parts) + r.choice([" ", "", "\t"]) for _ in range(r.randint(0, 3000))) for _ in range(5)] + ["", "y" * 9000]
    data, offsets = column(texts)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens = token_files.Tokenizer(f.read())
    model = langid.Model(["a", "b", "c"], np.log(np.random.default_rng(0).random((1 << 16, 3)).astype(np.float32)))
    whole = common.spans
    results = []
    for pieces in (whole, lambda data, offsets: whole(data, offsets, 200)):
        for module in (words, langid, toxicity):
            monkeypatch.setattr(module, "spans", pieces)
        results.append([*tokens.ids(data, offsets), *langid.infer(model, data, offsets), *toxicity._words(data, offsets)])
    assert len(list(whole(data, offsets, 200))) > 50
    for a, b in zip(*results, strict=True):
        assert np.array_equal(a, b)


CONTRACTS = {
    "op1_language_id": "doc_id held_out lang_pred score",
    "op3_masked_lm": "doc_id n_tokens sum_logprob mean_logprob",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_source_mix": "doc_id size source_size target taken",
    "op8_token_files": "doc_id start n_tokens ids_crc32",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(spark, name):
    """Every document once, with the stated columns and within the stated ranges."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")
    got = queries.queries()[name](spark, SF).toPandas().set_index("doc_id")
    assert ["doc_id", *got.columns] == CONTRACTS[name].split() and sorted(got.index) == sorted(docs.index)
    if "score" in got:
        assert got.score.between(0, 1).all() and got.held_out.dtype == bool
    if name in ("op8_token_files", "op10_bpe"):
        import hashlib
        import zlib

        import public_tokenizers
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        start = 0
        for i in sorted(docs.index):
            ids, r = tok.encode(docs.text[i] or "", add_special_tokens=False).ids, got.loc[i]
            if name == "op10_bpe":
                assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
            else:
                ids.append(0)
                assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                start += len(ids)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_pipeline_run(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).toPandas()
    assert list(got.columns) == CONTRACTS["op10_bpe"].split() and len(got) > 100 and (got.n_tokens > 0).all()
