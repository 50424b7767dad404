import random
import re

import numpy as np
import pytest

from quillgraph.llm import jaccard


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def plain(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows = [None, "", "\n", "A b c", "a B  c", "a b", "x " * 80]
    for _ in range(14):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 6, 9, 25, 60, 150, 300]))]
        if rnd.random() < 0.5:
            base += passage.split()
        for _ in range(rnd.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 45)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(" ".join(copy + [rnd.choice(words) for _ in range(rnd.choice([0, 0, 1, len(copy) // 5]))]))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,light", [(1, 8), (2, 2), (3, 3)])
def test_components_match_brute_force(spark, seed, light):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(docs, light=light).collect()}
    assert got == plain(rows)


def test_bounds():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 31, 32, 40, 63, 64, 100, 500):
        for m in range(-(-3 * n // 4), n * 4 // 3 + 1):
            most = max((n + m - 2 * i for i in range(min(n, m) + 1) if 4 * i >= 3 * (n + m - i)), default=0)
            shared = {b for b, _ in jaccard.bands(n)} & {b for b, _ in jaccard.bands(m)}
            if any(4 * i >= 3 * (n + m - i) for i in range(min(n, m) + 1)):
                assert shared
            for size in (n, m):
                for b, d in jaccard.bands(size):
                    if b in shared and b == min(jaccard.band_of(n), jaccard.band_of(m)):
                        assert d >= most, (n, m, b)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 40, 700)]
    key, owner, flag = jaccard.sketch_keys(sets)
    assert 0 not in owner and len(key) == len(owner) == len(flag)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(3, "one two three"), (3, "one two three"), (None, "one two three"), (9, "ONE two three"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.linked(docs).collect()), key=str)
    assert got == sorted([(3, 1, 3), (3, 1, 3), (None, 1, 3), (9, 1, 3), (None, 0, None)], key=str)
    assert jaccard.linked(docs.limit(0)).count() == 0


def test_large_groups_of_near_copies(spark):
    """Hundreds of texts that are near copies of one another, beside texts that only share a passage."""
    rnd = random.Random(4)
    base, passage = [f"b{i}" for i in range(200)], [f"p{i}" for i in range(60)]
    rows = [(0, " ".join(base)), (1, " ".join(base))]
    for i in range(2, 300):
        copy = list(base)
        for at in rnd.sample(range(200), rnd.choice([1, 2, 3])):
            copy[at] = f"n{i}_{at}"
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join([f"o{i}_{k}" for k in range(50)] + passage)) for i in range(300, 420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(docs).collect()}
    assert got == plain(rows)


def test_parities_bound_the_symmetric_difference():
    rng = np.random.default_rng(2)
    for n in (3, 50, 800):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: 2 * n // 3], rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]))
        x, y = jaccard.parities([a, b])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_the_null_character_is_a_word_character(spark):
    docs = spark.createDataFrame([(1, "a\0b c d e f"), (2, "a b c d e f"), (3, "\0")], "doc_id long, text string")
    assert {r.doc_id: r.n_shingles for r in jaccard.linked(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_task_holds_little_while_it_deals_out_its_keys():
    """Near two flushes of keys: under 120 MB at the peak (over 200 when each key carried its set's hash and component)."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    word = np.array([f"w{i}" for i in range(50_000)])
    texts = [" ".join(row) for row in word[rng.integers(0, len(word), (6000, 320))]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.nulls(len(texts), pa.int64())], names=["doc_id", "text", "component"])
    tracemalloc.start()
    keys = 0
    for out in jaccard._deal(iter([batch]), 5, 8, 12, jaccard.sketch_keys):
        keys += sum(len(jaccard.unpack(b, np.uint64, True)) for b in out.column("keys").to_pylist())
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert keys > jaccard.FLUSH and peak < 120, (keys, peak)
