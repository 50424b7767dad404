import itertools
import random

import pytest

from quillgraph.operators.overlap import candidates, overlap_join


@pytest.mark.parametrize("least", [1, 2, 4])
def test_equals_all_pairs(spark, least):
    rnd = random.Random(least)
    sets = {i: {"everyone"} | {f"m{int(rnd.paretovariate(0.6)) % 60}" for _ in range(rnd.randint(0, 9))} for i in range(60)}
    rows = [(i, m) for i, s in sets.items() for m in s] * 2 + [(None, "m1"), (3, None)]
    members = spark.createDataFrame(rows, "id long, m string").repartition(3)
    want = {(a, b, tuple(sorted(sets[a] & sets[b]))) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= least}
    assert {(r.a, r.b, tuple(r.shared)) for r in overlap_join(members, least).collect()} == want
    assert overlap_join(members.limit(0), least).count() == 0


def test_what_all_share_brings_no_pairs_together(spark):
    members = spark.createDataFrame([(i, m) for i in range(200) for m in ("all", f"group{i % 50}", f"own{i}")], "id long, m string")
    pairs, _ = candidates(members, 2)
    assert pairs.count() == 50 * 6  # of 19,900 pairs that share "all"


def test_ids_of_one_set_are_paired_as_slices(spark, monkeypatch):
    """every pair of ids went through the joins and had its own intersection."""
    from quillgraph.operators import overlap

    monkeypatch.setattr(overlap, "SLICE", 16)
    members = spark.createDataFrame([(f"i{i}", m) for i in range(150) for m in ("all", f"group{i % 3}", f"own{i}")], "id string, m string")
    slices = overlap.overlapping(members, 2)
    assert slices.count() < 100  # of 3,675 pairs
    got = {(r.a, r.b): r.shared for r in overlap.expanded(slices).collect()}
    ids = {f"i{i}": i % 3 for i in range(150)}
    assert got == {(a, b): ["all", f"group{ids[a]}"] for a, b in itertools.combinations(sorted(ids), 2) if ids[a] == ids[b]}
