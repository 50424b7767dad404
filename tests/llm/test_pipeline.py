import corpus_pipeline
from quillgraph.llm import bpe, decontaminate, jaccard, language, lines


def test_stages_on_a_small_corpus(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve"
    story = "the old man went down to the sea and looked at the ships that came from the far north with salt and furs"
    rows = [
        (1, story, "en", "s", len(story)), (2, story.upper(), "en", "s", len(story)), (3, f"before it begins {item} and after that more words follow here until the end", "en", "s", 9),
        (4, None, "en", "s", None), (5, "12 34 !!", "en", "s", 8), (6, "another clean text\nwith two lines of its own that nobody repeats", "en", "s", 60),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == columns
        seen[name] = {r.doc_id: r.text for r in at.collect()}
    assert set(seen["language"]) == {1, 2, 3, 6}
    assert set(seen["lines"]) == {1, 3, 6} and set(seen["near_duplicates"]) == {1, 3, 6}
    final = seen["decontamination"]
    assert final[1] == story and final[6] == rows[5][1] and item not in final[3] and final[3].startswith("before it begins")
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(last) == {1, 3, 6} and last[1].n_tokens > 10


def test_stages_apply_their_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "bpe"]
    assert all(callable(f) for f in (language.predict, lines.dedup, jaccard.linked, decontaminate.remove, bpe.encode_digests))


def test_columns_with_the_operators_own_names_come_back(spark, tmp_path):
    from pyspark.sql import functions as F

    own = ["score", "lang_pred", "rejected", "gone_lines", "GONE_ID", "hit_spans", "hit_items", "hit_n_words", "hit_whole", "component_id", "component", "n", "g", "c0", "key", "one"]
    rows = [(i, f"the {w} ships came home from the north with salt and furs and told of {w} winters", "en", "s", 70) for i, w in enumerate(["old", "red", "long", "grim"])]
    docs = spark.createDataFrame(rows + [(9, rows[0][1], "en", "s", 70), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in own])
    spark.createDataFrame([(1, "told of grim winters"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) >= 1
        for r in got:
            assert all(r[c] == f"{c}/{'-' if r.doc_id is None else r.doc_id}" for c in own), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 6


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    some = spark.createDataFrame([(1, "one two three", "en", "s", 13), (1, "one two three", "en", "s", 13)], docs.schema)
    assert corpus_pipeline.without_benchmark(spark, some, str(tmp_path)).count() == 2


def test_workers_get_texts_in_batches_of_bounded_size(spark):
    """30 MB of texts in one partition: no batch is much over 8 MB (one of 30 MB before); a size that the session names stays."""
    import pyarrow as pa

    from quillgraph import shipping

    shipping.ship(spark)
    docs = spark.range(3000, numPartitions=1).selectExpr("id", "repeat(cast(id % 10 as string), 10000) as text")
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) < 1.1 * shipping.BATCH_BYTES and sum(r.n for r in sizes) > 30_000_000
    other = spark.newSession()
    other.conf.set(shipping._BATCH, "123456")
    shipping.ship(other)
    assert other.conf.get(shipping._BATCH).startswith("123456")


def test_keys_leave_workers_in_small_batches(monkeypatch):
    """A flush of keys of jaccard or lines, dealt to 51 ranges: no batch of 3 MB (about 14 and 20 MB when a flush was one), and the same keys for any size."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    word = np.array([f"w{i}" for i in range(50_000)])
    texts = ["\n".join(" ".join(line) for line in text) for text in word[rng.integers(0, len(word), (6000, 16, 20))]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.nulls(len(texts), pa.int64())], names=["doc_id", "text", "component"])
    rarity = {size: np.zeros(lines.SLOTS, np.uint8) for size in (lines._size(lines.SIMILARITY), lines.RARE_GRAM)}
    deals = {
        (jaccard, "keys"): lambda: jaccard._deal(iter([batch]), 5, 8, 51, jaccard.sketch_keys),
        (lines, "buckets"): lambda: lines._deal(iter([batch]), 51, lines.MIN_WORDS, rarity, lines.SIMILARITY),
    }
    for (module, keys), deal in deals.items():
        found, largest = [], []
        for sent in (module.SENT, 1 << 40):
            monkeypatch.setattr(module, "SENT", sent)
            out = list(deal())
            largest.append(max(b.nbytes for b in out))
            got = [np.stack([np.full(len(k), part, np.uint64), k], 1) for b in out for part, packed in zip(b.column("part").to_pylist(), b.column(keys).to_pylist()) for k in [jaccard.unpack(packed, np.uint64, True)]]
            got = np.concatenate(got)
            found.append(got[np.lexsort(got.T)])
        assert largest[0] < 3_000_000 < largest[1], (module.__name__, largest)
        assert len(found[0]) > module.FLUSH and np.array_equal(*found), module.__name__
