from hypothesis import given
from hypothesis import strategies as st

from quillgraph.functions import chunking
from quillgraph.operators import text

TEXT = "Intro first.\n\n# One\nA sentence here. Another one! And more? Yes.\n\n- item\n- other\n\n# Two\n" + "Long words go on and on. " * 80
SOME = st.text(alphabet="ab .\n#-!A", max_size=300)


@given(SOME, st.integers(5, 60))
def test_chunks_cover_the_text(s, size):
    for spans in (chunking.semantic(s, size), chunking.token_aware(s, size), chunking.adaptive(s, size // 2, size), chunking.hierarchical(s, size)):
        assert "".join(s[a:b] for a, b in spans) == s
    assert "".join(s[a : min(b, a + size - 3)] if k + 1 < len(f) else s[a:b] for f in [chunking.fixed(s, size, 3)] for k, (a, b) in enumerate(f)) == s


@given(st.text(alphabet="ab ", min_size=1, max_size=200))
def test_windows_merge_back(s):
    parts = [s[a:b] for a, b in chunking.windows(s, 20, 0.2)]
    assert parts and "".join(parts[:1]) == s[: len(parts[0])]


def test_boundaries_and_strategies():
    kinds = [b[2] for b in chunking.boundaries(TEXT)]
    assert {"paragraph", "section", "sentence", "list"} <= set(kinds)
    assert chunking.pick_strategy(TEXT) == "hierarchical" and chunking.pick_strategy("plain", most_tokens=5) == "token_aware"
    assert chunking.balance([(0, 300), (300, 320), (320, 340)], 100) == [(0, 100), (100, 200), (200, 300), (300, 340)]
    assert chunking.knapsack([(1, 0.9, 80), (2, 0.8, 50), (3, 0.7, 20)], 100) == [1, 3]
    assert len(chunking.hash_embedding("x", 8)) == 8 and chunking.hash_embedding("x", 8) == chunking.hash_embedding("x", 8)
    assert chunking.merge_windows(["one two three", "two three four"]) == "one two three four"


def test_operators(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    for name in text.STRATEGIES:
        rows = sorted(text.chunk(docs, name).collect(), key=lambda r: r.chunk)
        assert {r.id for r in rows} == {1} and rows[0].content == TEXT[: rows[0].size]
    same = spark.createDataFrame([("g", 1, "a b c"), ("g", 2, "a b c"), ("g", 3, "d e f"), ("h", 4, "a b c"), ("h", 5, None)], "grp string, k int, t string")
    kept = {r.k for r in text.dedup_content(same, group_col="grp", key_col="k", text_col="t", order_col="k").collect()}
    assert kept == {1, 3, 4, 5}


def test_vector_links(spark):
    import numpy as np

    from quillgraph.operators import vector_index, vectors

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row], i % 3) for i, row in enumerate(v)], "vec_id long, v array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((i, int(j)))) for i in range(60) for j in np.argsort(-s[i])[:4]}
    old, vector_index.BLOCK = vector_index.BLOCK, 17
    try:
        assert {(r.a, r.b) for r in vectors.links(df, 4).collect()} == want
    finally:
        vector_index.BLOCK = old
    top = vectors.nearest(df, [float(x) for x in v[0]], 5, types=[0])
    assert top.first().vec_id == 0 and {r.label for r in top.collect()} == {0}


def test_balanced_chunks_cover_the_text(spark):
    body = "One sentence here. " * 400 + "\n\n" + "word " * 900
    rows = text.chunk(spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, text string"), "balanced").orderBy("chunk").collect()
    assert "".join(r.content for r in rows) == body and {r.id for r in rows} == {1} and all(r["size"] <= 1200 for r in rows)
