import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrade.llm import markov as M

HELD = "crc32(cast(doc_id as string)) % 7 = 2"


def plain_likelihood(model, symbols):
    alpha, total = model.start * model.emit[:, symbols[0]], 0.0
    for o in symbols[1:]:
        total += math.log(alpha.sum())
        alpha = (alpha / alpha.sum()) @ model.move * model.emit[:, o]
    return total + math.log(alpha.sum())


def some_model(k, seed):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return M.Model(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, M.CLASSES))))


def sequences(seed, lengths):
    rng = np.random.default_rng(seed)
    return [np.r_[rng.integers(0, 255, n - 1), M.END_CLASS].astype(np.uint8) for n in lengths]


def test_forward_is_exact():
    model = some_model(4, 1)
    texts = sequences(2, [1, 2, 127, 128, 129, 256, 257, 1000, 5000])
    got = M.Batch(texts, model).likelihoods()
    assert np.allclose(got, [plain_likelihood(model, t) for t in texts], rtol=1e-10)


def test_expected_counts_against_plain_recursion():
    model, texts = some_model(3, 3), sequences(4, [1, 5, 130, 300])
    k = 3
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, M.CLASSES))
    for o in texts:
        n = len(o)
        a, b = np.zeros((n, k)), np.ones((n, k))
        a[0] = model.start * model.emit[:, o[0]]
        a[0] /= a[0].sum()
        for t in range(1, n):
            a[t] = a[t - 1] @ model.move * model.emit[:, o[t]]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = model.move @ (model.emit[:, o[t + 1]] * b[t + 1])
            b[t] /= b[t].sum()
        g = a * b
        g /= g.sum(axis=1, keepdims=True)
        start += g[0]
        for t in range(n):
            emit[:, o[t]] += g[t]
        for t in range(1, n):
            x = a[t - 1][:, None] * model.move * (model.emit[:, o[t]] * b[t])[None, :]
            move += x / x.sum()
    got, _ = M.Batch(texts, model).expected()
    assert np.allclose(got, np.concatenate([start, move.ravel(), emit.ravel()]), rtol=1e-8)


def test_training_never_lowers_the_likelihood():
    texts = sequences(5, [40] * 30)
    model, last = M.first_model(np.ones(M.CLASSES), M.Training()), -1e18
    for _ in range(5):
        counts, total = M.Batch(texts, model).expected()
        assert total > last - 1.0  # the smoothing may cost a little
        last, model = total, M.updated(counts, 4)


def brute_base(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of (doc_id, text) rows."""
    counts, tokens = {}, []
    for doc_id, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        tokens.append(re.findall(r"[^\x20\x09-\x0D]+", lower) + [None])
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    for own, out in zip(tokens, held):
        for w in own if not out else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return [
        (i, out, len(own), sum(counts.get(w, 0) > 0 for w in own), n,
         sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own))
        for (i, _), own, out in zip(rows, tokens, held)
    ]


def same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


@pytest.mark.parametrize("block_tokens", [1 << 22, 50])
def test_edge_rows(edge, block_tokens):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    got = M.score_texts(edge.repartition(2), HELD, carry=["doc_id"], block_tokens=block_tokens).collect()
    same([r[:6] for r in got], brute_base(rows))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_whole_table_learns_languages(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = M.score_texts(docs, HELD, carry=["doc_id"]).cache()
    same([r[:6] for r in got.collect()], brute_base([tuple(r) for r in docs.collect()]))
    held = got.filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] / held[2] > held[1] / held[2] + 0.1  # log10 per token, on texts not learned from


def test_nothing_to_learn_from(edge, nothing):
    assert M.score_texts(nothing, HELD).collect() == []
    got = M.score_texts(edge.filter("doc_id < 4"), "true", carry=["doc_id"]).collect()
    assert {(r.n_known, r.train_tokens) for r in got} == {(0, 0)} and all(math.isfinite(r.score) for r in got)
