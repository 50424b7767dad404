import random
import re

from quillgraph.llm import repetition


def plain(text, least):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(ws)
    reach = [max([k for j in range(n) if j != i for k in [next((k for k in range(n) if i + k >= n or j + k >= n or ws[i + k] != ws[j + k]), 0)]], default=0) for i in range(n)]
    covered = {p for i in range(n) if reach[i] >= least for p in range(i, i + reach[i])}
    tri = [tuple(ws[i : i + 3]) for i in range(n - 2)]
    rep = {p for i, t in enumerate(tri) if tri.count(t) > 1 for p in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(rep), len(covered), max(reach, default=0)


def test_matches_brute_force(spark):
    rnd = random.Random(2)
    texts = [None, "", "\n", "a", "a\na\n", "a\n\n \na", "ab " * 60]
    texts += ["".join(rnd.choice(["a ", "bé ", "c\n", "#d ", "e\t", "\n"]) for _ in range(rnd.randint(0, 70))) for _ in range(60)]
    texts += [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80)) * rnd.randint(1, 2) for _ in range(10)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(2)
    for r in repetition.quality(docs, min_repeat=4).collect():
        n, chars, symbols, dup, rep, covered, longest = plain(texts[r.doc_id], 4)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat) == (n, chars, symbols, dup, rep, covered, longest), repr(texts[r.doc_id])
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)
    assert repetition.quality(docs.limit(0)).count() == 0


def test_coverage_alone_fails_a_text(spark):
    passage = [f"p{k}" for k in range(100)]
    fresh = [f"f{k}" for k in range(250)]
    rows = [(1, " ".join(passage + fresh[:150] + passage + fresh[150:])), (2, " ".join(passage[:15] + fresh + passage[:15] + passage[15:]))]
    twice, little = repetition.quality(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert (twice.n_words, twice.covered_words, twice.longest_repeat, twice.base_failed, twice.kept) == (450, 200, 100, False, False)
    assert (little.covered_words, little.base_failed, little.kept) == (30, False, True)


def test_the_null_character_is_a_word_character(spark):
    docs = spark.createDataFrame([(1, "a\0b c")], "doc_id long, text string")
    r = repetition.quality(docs).first()
    assert (r.n_words, r.word_chars) == (2, 4)
