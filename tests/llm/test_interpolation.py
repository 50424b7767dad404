import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import blobs, interpolation


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def corpus():
    rnd = random.Random(4)
    texts = [None, "", " ", "A b"] + [" ".join(rnd.choice(["A", "b", "c", "D" * rnd.randint(1, 3), "é"]) for _ in range(rnd.randint(0, 40))) for _ in range(80)]
    return list(enumerate(texts)) + [(7, texts[7])]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_brute_force(spark, order):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    train, dev = (lambda i: i % 7 != 2), (lambda i: i % 7 == 5)
    out = interpolation.score(docs, F.col("doc_id") % 7 != 2, F.col("doc_id") % 7 == 5, order=order, batch_bytes=500).collect()

    def tables(keep):
        count = [Counter() for _ in range(order)]
        for i, t in rows:
            if keep(i):
                w = ["<s>"] * order + words(t)
                for k in range(order):
                    count[k].update(tuple(w[j - k : j + 1]) for j in range(order, len(w)))
        return count

    def parts(count, t):
        """Per token: estimates of each order over the uniform share, and counts of contexts."""
        types, total, w = len(every[0]), sum(count[0].values()), ["<s>"] * order + words(t)
        for j in range(order, len(w)):
            n = [count[k][tuple(w[j - k : j + 1])] for k in range(order)]
            c = [total] + [count[k - 1][tuple(w[j - k : j])] if j > order else count[0][("</s>",)] for k in range(1, order)]
            yield n, c, types

    every, main = tables(train), tables(lambda i: train(i) and not dev(i))
    total, types = sum(every[0].values()), len(every[0])
    codes = []
    for i, t in rows:
        if dev(i):
            for n, c, v in parts(main, t):
                n, c = [np.array([x]) for x in n], [np.array([x]) for x in c]
                codes.append(interpolation._cells(interpolation.ratios(n, c, v), interpolation.context_class(c))[0])
    cells = np.array(codes, np.int64)
    weights = interpolation.learn_weights(interpolation._decode(cells, order), np.ones(len(cells)), order)
    assert len(out) == len(rows)
    for r in out:
        t = dict(rows)[r.doc_id]
        base = score = known = 0
        for n, c, v in parts(every, t):
            own = interpolation.context_class([np.array([x]) for x in c])[0]
            share = [w for w, x in zip(weights[own], [1, *c]) if x > 0]
            value = [1 / (types + 1)] + [a / b for a, b in zip(n, c) if b > 0]
            score += math.log10(sum(a * b for a, b in zip(share, value)) / sum(share))
            base += math.log10((n[0] + 1) / (total + types + 1))
            known += n[0] > 0
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words(t)), known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-3)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(spark, order):
    """Over all texts of up to six words, of which longer ones are left a small share."""
    docs = [(i, t, True) for i, t in enumerate(["a", "b", "a b", "", "a", "b a", "", "a a"])]
    asks = [(100 + i, " ".join(w), False) for i, w in enumerate(w for n in range(7) for w in itertools.product(["a", "b", "new"], repeat=n))]
    df = spark.createDataFrame(docs + asks, "doc_id long, text string, t boolean")
    scored = interpolation.score(df, F.col("t"), F.col("doc_id") % 2 == 1, order=order).where("not train").collect()
    total = sum(10**r.score for r in scored)
    assert len(scored) == len(asks) and 0.97 < total < 1 + 1e-9


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in interpolation.score(df, F.lit(False), F.lit(False)).collect()} == {(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)}
    assert interpolation.score(df.limit(0), F.lit(True), F.lit(True)).count() == 0


def test_blobs_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (blobs.unpack(blobs.pack(keys, True), np.uint64, True) == keys).all()
        small = rng.integers(0, 300, n).astype(np.uint32)
        assert (blobs.unpack(blobs.pack(small), np.int64) == small).all()
        cut = blobs.ranges(keys, 7)
        assert cut[0] == 0 and cut[-1] == n and (np.diff(cut) >= 0).all()
