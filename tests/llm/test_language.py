import random

import numpy as np

from quillgraph.llm import language

WORDS = {"aa": "the of and with from this that".split(), "bb": "der die und mit von dieser nicht".split(), "cc": "les des une avec pour cette dans".split()}


def corpus(spark, n=240):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(5, 60))), lang if i % 11 else None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_counts_match_a_plain_loop():
    import pyarrow as pa

    texts = ["", "Ab  c1é", "zz", None]
    counts = language.gram_counts(pa.array(texts))
    assert counts[0].sum() == counts[3].sum() == 0
    letters = "ab c é".encode()  # digits and repeated spaces become one space
    assert counts[1].sum() == sum(len(letters) - n + 1 for n in (1, 2, 3))
    assert counts[2].sum() == 2 + 1


def test_held_out_accuracy_and_rejection(spark):
    docs = corpus(spark)
    model = language.fit(docs.where("doc_id % 4 != 2"), sample_rows=90)
    assert len(model.owner) <= 3 * language.CLUSTERS and np.allclose(np.linalg.norm(model.centres, axis=1), 1, atol=1e-5)
    out = language.predict(docs, model).where("doc_id % 4 = 2").collect()
    names = sorted(WORDS)
    assert sum(r.lang_pred == names[r.doc_id % 3] for r in out) >= 0.97 * len(out)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 !?", 1), (4, "漢字漢字", 1), (4, "漢字漢字", 1), (5, "the of and", 1)], "doc_id long, text string, score int")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language.predict(odd, model).orderBy("doc_id").collect()]
    assert got[:3] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert got[3][2] and got[3] == got[4] and got[3][1] in names
    assert got[5] == (5, "aa", False)


def test_nothing_to_learn(spark):
    docs = corpus(spark, 4)
    assert language.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_gibberish_and_unseen_scripts_are_rejected(spark):
    rnd = random.Random(8)
    docs = corpus(spark, 600)
    model = language.fit(docs.where("doc_id % 4 != 2"))
    clean = language.predict(docs, model).where("doc_id % 4 = 2").collect()
    assert sum(r.rejected for r in clean) <= 0.02 * len(clean)
    letters = ["abcdefghijklmnopqrstuvwxyz ", "bcdfghjklmnpqrstvwxz ", "ABCDEFGHabcdefgh0123456789+/xyzq", "абвгдежзиклмнопрстуфхц ", "αβγδεζηθικλμνξοπρστυφχψω ", [chr(c) for c in range(0x4E00, 0x5E00)]]
    junk = [(i, "".join(rnd.choice(alphabet) for _ in range(n))) for n in (150, 400, 1500) for i, alphabet in enumerate(letters)]
    junk = spark.createDataFrame(junk, "doc_id long, text string")
    assert all(r.rejected for r in language.predict(junk, model).collect())


def test_the_model_follows_all_labelled_rows(spark):
    import pyarrow as pa

    rnd = random.Random(5)
    texts = [(" ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(20, 40))) + (" zyx" if i % 7 == 0 else ""), lang) for lang, n in (("aa", 4500), ("bb", 2500)) for i in range(n)]
    model = language.fit(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(5))
    counts, label = language.gram_counts(pa.array([t for t, _ in texts])), np.array([lang == "bb" for _, lang in texts]).astype(int)
    share = ((counts[label == 0] > 0).mean(0) + (counts[label == 1] > 0).mean(0)) / 2
    assert np.allclose(model.idf, np.log((1 + len(texts)) / (1 + len(texts) * share)) + 1, atol=1e-5)
    x = model.vectors(counts)
    best, cosine = model.closest(counts)
    octave = language._octave(counts)
    for i, owner in enumerate(model.owner):
        own = x[(label == owner) & (np.where(model.owner == owner, x @ model.centres.T, -1).argmax(1) == i)]
        mean = own.mean(0) / np.linalg.norm(own.mean(0))
        assert mean @ model.centres[i] > 0.998  # one step of k-means moves it little
        for o in set(octave[best == i]):
            here = cosine[(best == i) & (octave == o)]
            if len(here) >= language.ENOUGH:
                assert abs(model.least[i, o] - language.MARGIN * np.quantile(here, 0.01)) <= 2e-4
