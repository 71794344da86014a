import collections
import math
import random
import zlib

import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from hearth.llm import hmm_lm, queries


def test_hmm_expectations_match_brute_force():
    rng = np.random.default_rng(1)
    k, c = 3, 7
    start, a, b = (rng.dirichlet(np.ones(n), size=m) for n, m in ((k, 1), (k, k), (c, k)))
    start = start[0]
    sizes = np.array([1, 3, 150, 64, 65, 128])
    classes = rng.integers(0, c, sizes.sum())
    total, starts, moves, emits = hmm_lm.expected(classes, sizes, start, a, b)
    want, s0, m0, e0, at = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((k, c)), 0
    for n in sizes:
        x = classes[at : at + n]
        at += n
        f, scale = np.zeros((n, k)), np.zeros(n)
        for t in range(n):
            f[t] = (start if t == 0 else f[t - 1] @ a) * b[:, x[t]]
            scale[t] = f[t].sum()
            f[t] /= scale[t]
        g = np.ones((n, k))
        for t in range(n - 2, -1, -1):
            g[t] = a @ (b[:, x[t + 1]] * g[t + 1]) / scale[t + 1]
        want += np.log(scale).sum()
        s0 += f[0] * g[0]
        for t in range(n):
            e0[:, x[t]] += f[t] * g[t]
            if t:
                m0 += np.outer(f[t - 1], b[:, x[t]] * g[t]) * a / scale[t]
    assert total == pytest.approx(want) and np.allclose(starts, s0) and np.allclose(moves, m0) and np.allclose(emits, e0)


def test_hmm_scores(spark, sf, odd, empty, texts):
    c, toks = collections.Counter(), {}
    for k, t in texts.items():
        toks[k] = [*words(t), None]
        if zlib.crc32(str(k).encode()) % 7 != 2:
            c.update(toks[k])
    n, v = sum(c.values()), len(c)
    rows = queries.op7_hmm_lm(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    for docs in (odd, empty):
        got = hmm_lm.hmm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
        assert got.count() == docs.count() and got.where("score > 0 OR isnan(score)").count() == 0
    assert hmm_lm.hmm_scores(odd, F.lit(True)).where("n_known > 0").count() == 0


def test_hmm_word_shares_sum_to_one():
    tokens, distinct = np.array([10.0, 0.0, 6.0]), np.array([2.0, 0.0, 1.0])
    model = hmm_lm.Model(np.ones(1), np.ones((1, 1)), np.ones((1, 3)), 16, 3, tokens, distinct, 0.4, ())
    share = 10 ** hmm_lm.word_logs(model, np.array([0, 0, 0]), np.array([7, 3, 0]))
    assert share.sum() == pytest.approx(1.0)


def test_states_beat_one_state_on_held_out_texts(spark, documents):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2

    def per_token(states):
        rows = hmm_lm.hmm_scores(documents, held_out, s=hmm_lm.Settings(states=states)).where("held_out")
        return rows.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()

    four, one = per_token(4), per_token(1)
    assert four[0] > one[0] > four[1]
