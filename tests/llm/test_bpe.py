import hashlib
import random

import pytest

from quillgraph.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
LETTERS = ["abcdefgh", "aaab", "the ing er on", "!?'s-<|endoftext|>", "éèßñΣσİ²½́ \x85\x1c漢字한", "0123", "\0a", "<|startoftext|>x'll"]


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec(PATH, piece=16)


def direct(codec, text):
    e = codec.tokenizer.encode(text, add_special_tokens=False)
    return len(e.ids), " ".join(map(str, e.ids)), codec.tokenizer.decode(e.ids, skip_special_tokens=False)


def ours(codec, n_ids):
    return *n_ids, codec.decode(n_ids[1])


def test_encodes_as_the_library(codec):
    rnd = random.Random(5)
    for k in range(1500):
        text = "".join(rnd.choice(rnd.choice(LETTERS)) for _ in range(rnd.randint(0, 120))) + "<|endoftext|>" * (k % 3 == 0)
        assert ours(codec, codec.encode(text)) == direct(codec, text), repr(text)


def test_joins_cut_runs(codec):
    rnd, hard = random.Random(6), 0
    for _ in range(200):
        text = "".join(rnd.choice(LETTERS[rnd.choice([0, 1])]) for _ in range(rnd.randint(200, 900))) + " " * rnd.randint(0, 1) + "!-?'" * rnd.randint(0, 200) + "ok 7" * rnd.randint(0, 3)
        places = bpe.cuts(text, 130)
        hard += sum(h for _, h in places)
        edges = [0, *(p for p, _ in places), len(text)]
        assert ours(codec, bpe.encode_segments(codec, [text[a:b] for a, b in zip(edges, edges[1:])], [h for _, h in places])) == direct(codec, text)
    assert hard > 100


def test_cuts_after_contractions_and_other_openings(codec):
    """Every way into a long run, with a cut at every offset that can fall into it."""
    openings = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'RE", "'Ll", "don't", "!'s", "''t", "é's", "5've", " 'm", "—", "…!", "é", "ſ", "漢", "x—", "<|endoftext|>", "<|endoftext|>'s"]
    for k, opening in enumerate(openings):
        for run in ("s" * 200, "theing" * 40, "T" * 130, "!?" * 80):
            text = opening + run + " end"
            for segment in range(100 + k, 130 + k, 7):
                places = bpe.cuts(text, segment)
                edges = [0, *(p for p, _ in places), len(text)]
                parts = [text[a:b] for a, b in zip(edges, edges[1:])]
                assert ours(codec, bpe.encode_segments(codec, parts, [h for _, h in places])) == direct(codec, text), (opening, run[:9], segment)


def test_refuses_files_with_other_rules(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.BpeCodec(str(tmp_path / "other.json"))


def test_rows(spark, codec):
    texts = [None, "", "Hello World's end", "ab" * 4000, "one two " * 3000, "ab" * 4000, "word " * 9000 + "don'" + "t" * 60000, "'" + "s" * 70000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(5, "ab" * 4000, "y", 2)], "doc_id long, text string, ids string, n_tokens int")
    rows = bpe.encode_digests(docs, PATH, segment=1000).collect()
    assert len(rows) == len(texts) + 1
    rows += bpe.encode_digests(docs.where("doc_id > 5"), PATH).collect()
    for r in rows:
        n, ids, decoded = direct(codec, texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe.encode_digests(docs.limit(0), PATH).count() == 0
