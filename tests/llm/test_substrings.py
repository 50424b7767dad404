import random
import re

import pytest

from quillgraph.llm import substrings


def plain(rows, n):
    """Every window of every document against every earlier one."""
    words = [(float("inf") if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in words:
        for k in range(len(ws) - n + 1):
            key = tuple(ws[k : k + n])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - n + 1):
            if first[tuple(ws[k : k + n])] < (i, k):
                gone |= set(range(k, k + n))
        out.append((len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def check(spark, rows, n, **more):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, Removed string").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.text) for r in substrings.dedup(docs, n=n, **more).collect()))
    want = sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, plain(rows, n)))
    assert got == want


@pytest.mark.parametrize("period", [1, 2, 3, 5, 7, 13, 31])
def test_covers_hold_every_difference(period):
    cover = substrings.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(cover) ** 2 <= 4 * period + 4


@pytest.mark.parametrize(("n", "period", "batch_bytes"), [(4, 3, 200), (4, 7, 100_000), (20, 7, 700), (6, 1, 300), (1, 7, 300)])
def test_matches_brute_force(spark, n, period, batch_bytes):
    rnd = random.Random(n * 31 + period)
    passages = [[f"{rnd.choice('abcdé')}{k}" for k in range(rnd.randint(n, 3 * n))] for _ in range(6)]
    texts = [None, "", " \n\t", "one", "a\0b  c\x0bd\x1fe"]
    for _ in range(60):
        ws = []
        for _ in range(rnd.randint(1, 6)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) - 1)
            ws += p[a : a + rnd.randint(1, len(p))] if rnd.random() < 0.7 else [rnd.choice("xyz") for _ in range(rnd.randint(1, 2 * n))]
        texts.append(rnd.choice([" ", "\n", " \t "]).join(ws))
    rows = list(enumerate(texts))
    rows += [(7, rows[12][1]), (7, rows[12][1]), (rows[20][0], rows[20][1]), (None, rows[9][1]), (None, rows[30][1]), (-3, rows[40][1])]
    check(spark, rows, n, period=period, batch_bytes=batch_bytes)


def test_repeats_within_one_text_and_hot_passages(spark):
    passage = " ".join(f"w{k}" for k in range(25))
    run = "a " * 60
    rows = [(k, f"{passage} own{k} {passage if k % 3 else ''} tail{k}") for k in range(40)] + [(100, run), (101, run + passage), (102, passage * 1)]
    check(spark, rows, 20, batch_bytes=500)


def test_spans_and_empty_tables(spark):
    passage = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(["a", *passage, "b", "c", *passage[:20]]))], "doc_id long, text string")
    first, second = substrings.dedup(docs).orderBy("doc_id").collect()
    assert first.n_removed == 0 and first.removed == []
    assert [(s.start, s.end) for s in second.removed] == [(1, 31), (33, 53)] and second.text == "a b c"
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rnd = random.Random(8)
    base = [f"{rnd.randrange(10**6)}" for _ in range(120_000)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base[5000:90_000], "end"])), (3, "x" * 3_000_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup(docs, batch_bytes=100_000).collect()}
    assert got == {1: (120_000, 0), 2: (85_001, 85_000), 3: (1, 0)}
