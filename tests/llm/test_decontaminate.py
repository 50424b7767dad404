import hashlib
import random
import re

from quillgraph.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window):
    ws, hit, found = words(text), set(), set()
    for key, item in items:
        iw = words(item)
        n = min(window, len(iw))
        for i in range(len(iw) - n + 1 if iw else 0):
            for j in range(len(ws) - n + 1):
                if ws[j : j + n] == iw[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(key))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def random_case(rnd):
    vocabulary = ["A", "b", "É", "d2"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 2, 3, 5, 9, 14])))) for i in range(rnd.randint(0, 7))]
    texts = [None, "", "..."] + [rnd.choice([" ", ", "]).join(rnd.choice(vocabulary + ["zz"] * rnd.randint(0, 1)) for _ in range(rnd.randint(0, 60))) for _ in range(8)]
    return items + [(99, None)], texts


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    for k in range(4):
        items, texts = random_case(rnd)
        docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)] + [(3, texts[3], "e")], "doc_id long, text string, hit_spans string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        out = decontaminate.report(docs, bench, window=4, block_chars=30 if k % 2 else 10**6).collect()
        assert len(out) == len(texts) + 1
        for r in out:
            assert tuple(r)[1:] == plain(texts[r.doc_id], items, 4), (texts[r.doc_id], items)


def test_removes_spans_and_keeps_clean_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    clean = "Nothing to see,  here.\nNothing at all"
    docs = spark.createDataFrame([(1, f"Intro words come first here. {item.title()}! And then the story goes on and on.", 7), (2, clean, 7), (3, item, 7), (4, None, 7)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    out = {r.doc_id: r.text for r in decontaminate.remove(docs, bench).collect()}
    assert out == {1: "Intro words come first here. ! And then the story goes on and on.", 2: clean, 4: None}


def test_removes_whole_short_items_from_long_documents(spark):
    before, after = " ".join(f"b{k}" for k in range(40)), " ".join(f"a{k}" for k in range(40))
    items = ["red green blue", "what is the capital of france", "i1 i2 i3 i4 i5 i6 i7 i8 i9"]
    rows = [(i, f"{before} {item} {after}") for i, item in enumerate(items)] + [(9, f"{before} i1 i2 i3 i4 i5 i6 {after}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for how in ({}, {"window": 4}):
        out = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, **how).collect()}
        assert out == {**{i: f"{before}  {after}" for i in range(len(items))}, 9: rows[3][1]}
