import hashlib
import random
from collections import defaultdict

from quillgraph.llm import sharding


def plain(rows, limit):
    """Splits buckets one bit at a time."""
    bits = lambda i: bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:12], 16))[2:].zfill(48)
    todo, out = {"": rows}, {}
    while todo:
        name, rows = todo.popitem()
        if sum(len((t or "").encode()) for _, t in rows) <= limit:
            for i, _ in rows:
                out[i] = name or "*"
        else:
            split = defaultdict(list)
            for r in rows:
                split[bits(r[0])[: len(name) + 1]].append(r)
            todo |= split
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, "é" * rnd.choice([0, 1, 10, 40])) for i in range(300)] + [(None, "x"), (400, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    for limit in (100, 900, 10**6):
        out = sharding.shard(docs, limit=limit).collect()
        assert {r.doc_id: r.shard for r in out} == plain(rows, limit) and len(out) == len(rows)
        size = defaultdict(int)
        for r in out:
            size[r.shard] += r.n_bytes
        assert all(size[r.shard] == r.shard_bytes <= limit and not r.oversize for r in out)
    assert sharding.shard(docs.limit(0)).count() == 0
    assert "Python" not in sharding.shard(docs)._jdf.queryExecution().executedPlan().toString()


def test_one_id_over_the_limit(spark):
    docs = spark.createDataFrame([(1, "x" * 30)] * 40 + [(2, "y" * 500), (3, "z")], "doc_id long, text string").repartition(3)
    out = sharding.shard(docs, limit=100).collect()
    size = defaultdict(int)
    for r in out:
        size[r.shard] += r.n_bytes
    assert len(out) == 42
    assert all(size[r.shard] == r.shard_bytes and (r.shard_bytes <= 100 or r.oversize) for r in out)
    assert [r.doc_id for r in out if r.oversize] == [2]
