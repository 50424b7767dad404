"""Greedy choices against a loop over the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import chunking
from quillgraph.operators import greedy, text


def first_kept(rows, threshold):
    kept = {}
    for grp, key, body in sorted(rows, key=lambda r: r[1]):
        words = set((body or "").lower().split())
        if not any(words and k and len(words & k) / len(words | k) >= threshold for k, _ in kept.get(grp, [])):
            kept.setdefault(grp, []).append((words, key))
    return {(g, k) for g, x in kept.items() for _, k in x}


@pytest.mark.parametrize(("seed", "threshold", "rounds"), [(1, 0.8, 3), (2, 0.5, 3), (3, 0.9, 1), (4, 0.6, 1)])
def test_keeps_the_first_of_what_is_alike(spark, seed, threshold, rounds, monkeypatch):
    monkeypatch.setattr(greedy, "LEADER_ROUNDS", rounds)
    rnd = random.Random(seed)
    base = [[f"{c}{k}" for k in range(rnd.randint(1, 14))] for c in "abcdefg"]
    rows = [("x", 1000, None), ("x", 1001, " "), (None, 1002, "a b"), (None, 1003, "B  a"), ("y", 1004, "")]
    for key in range(150):
        line = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            line[rnd.randrange(len(line))] = rnd.choice(["the", "of", f"n{key}", line[0]])
        rows.append((rnd.choice("xxy"), key, rnd.choice([" ", "\n"]).join(line)))
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "grp string, k long, t string, w string").repartition(3)
    got = text.dedup_content(docs, group_col="grp", key_col="k", text_col="t", order_col="k", threshold=threshold)
    assert {(r.grp, r.k) for r in got.collect()} == first_kept(rows, threshold)


def test_a_chain_and_a_large_group(spark):
    """In a chain each row is like the next one only: every other stays. Of many near copies the first stays."""
    chain = [("c", k, " ".join(f"w{j}" for j in range(k, k + 20))) for k in range(0, 24, 2)]
    copies = [("c", 100 + k, " ".join([f"b{j}" for j in range(30)] + [f"own{k}"])) for k in range(300)]
    rows = chain + copies
    docs = spark.createDataFrame(rows, "grp string, k long, t string")
    got = {(r.grp, r.k) for r in text.dedup_content(docs, group_col="grp", key_col="k", text_col="t", order_col="k", threshold=0.8).collect()}
    assert got == first_kept(rows, 0.8) and sum(k >= 100 for _, k in got) == 1
    assert text.dedup_content(docs.limit(0), group_col="grp", key_col="k", text_col="t", order_col="k").count() == 0


@pytest.mark.parametrize("by", ["priority", "efficiency", "size"])
def test_packs_what_still_fits(spark, by):
    rnd = random.Random(len(by))
    items = [(rnd.choice(["p", "q", None]), k, rnd.choice([0.1, 0.5, 0.9, rnd.random()]), rnd.choice([0, 1, 3, 40, 90, rnd.randint(1, 200)])) for k in range(200)]
    frame = spark.createDataFrame(items, "grp string, k long, priority double, tokens int").repartition(3)
    got = {}
    for r in text.pack_tokens(frame, 400, group_col="grp", key_col="k", priority_col="priority", tokens_col="tokens", by=by).collect():
        got.setdefault(r.grp, set()).add(r.k)
    for grp in ("p", "q", None):
        assert got[grp] == set(chunking.knapsack([(k, p, t) for g, k, p, t in items if g == grp], 400, by))
    assert text.pack_tokens(frame.limit(0), 400, group_col="grp", key_col="k", priority_col="priority", tokens_col="tokens").count() == 0


def test_rows_of_a_group_are_cut_before_the_shuffle(spark, tmp_path):
    spark.range(10).selectExpr("id % 2 as grp", "id", "1 as t").write.parquet(str(tmp_path / "x"))
    by = Window.partitionBy("grp").orderBy("id")
    rows = spark.read.parquet(str(tmp_path / "x")).withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= greedy.GROUP_ROWS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
