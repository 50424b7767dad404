import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quillgraph.llm import importance
from quillgraph.llm.arrowtext import ALNUM_LOWER, Words


def words_of(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(text, n):
    ws = words_of(text)
    return [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


def plain(rows, target, n, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, c in (([x for _, x in rows], s), (target, t)):
        for text in texts:
            for f in runs(text, n):
                c[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        f = runs(text, n)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("n", "chunk_bytes"), [(1, 262_144), (1, 40), (2, 30), (3, 25), (4, 1)])
def test_matches_brute_force(spark, n, chunk_bytes):
    rnd = random.Random(n)
    pool = ["alpha", "Beta", "gamma9", "été", "x", "ΔΣ", "naïve", "w" * 70, "中文", "d-e", "f_g", "0"]
    texts = [None, "", "...", "\0a\0B", "One"] + [rnd.choice([" ", "\n", ", "]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(50)]
    rows = [*enumerate(texts), (None, texts[9]), (9, texts[9]), (9, texts[9]), (9, texts[10])]
    target = [" ".join(rnd.choice(pool[:4]) for _ in range(40)), None, "alpha " * 20]
    docs = spark.createDataFrame([(i, t, 5, 1.0) for i, t in rows], "doc_id long, text string, score int, Rank double").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, goal, n=n, buckets=97, chunk_bytes=chunk_bytes, percent=40)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr) == plain(rows, target, n, 97, 20, 40)


def test_crc_of_spans():
    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 256, 5000).astype(np.uint8)
    edge = np.sort(rnd.choice(5000, 80, replace=False))
    start, end = edge[:-1], edge[1:]
    assert importance.crc32(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]


def test_chunks_own_every_start_once():
    text = " ".join(["ab", "c" * 50, "dé"] * 30).encode()
    for n in (1, 2, 5):
        pieces = importance.cut(text, n, 20)
        assert [a for a, *_ in pieces] == [0, *[b for _, b, _ in pieces[:-1]]] and pieces[-1][1] == len(text)
        for a, b, c in pieces:
            carried = Words(np.frombuffer(text[b:c], np.uint8), np.array([0, c - b]), ALNUM_LOWER)
            assert len(carried) == min(n - 1, len(text[b:].split()))


def test_long_texts_are_dealt_as_chunks(spark):
    rnd = random.Random(3)
    long = " ".join(str(rnd.randrange(5000)) for _ in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "z" * 1_000_000), (3, "12 34 " * 20)], "doc_id long, text string")
    goal = spark.createDataFrame([("12 34",)], "text string")
    got = {r.doc_id: r for r in importance.resample(docs, goal, n=2, chunk_bytes=50_000, percent=100).collect()}
    assert (got[1].n_words, got[1].n_features, got[2].n_words, got[2].rank) == (200_000, 399_999, 1, None)
    assert [got[i][3] for i in (1, 2, 3)] == [r[3] for r in sorted(plain([(1, long), (2, "z" * 1_000_000), (3, "12 34 " * 20)], ["12 34"], 2, importance.BUCKETS, 20, 100))]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).count() == 0
    assert importance.resample(docs, none, percent=100).first()["rank"] == 1
