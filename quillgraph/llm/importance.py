"""Importance resampling towards a target distribution, over hashed n-grams with overlap chunking.

Features are all runs of 1 to ``n`` consecutive words; each falls in the bucket that CRC-32 of its bytes names. A bucket's
gain is the logarithm of its share in the target over its share in the corpus, each with one added count, in whole
thousandths. A document's weight is the sum of its features' gains; Gumbel noise from a hash of its id makes the highest
scores a draw without replacement in proportion to the exponential of the weight.

Texts of over ``chunk_bytes`` are split at word boundaries. A chunk owns the features that start in it and carries the
``n`` - 1 words that follow, so every feature is counted once. Chunks are dealt to tasks on their own, those of one text
too; counts and weights are summed by document, in numbers of any order. Shorter texts stay where they are read. What
reaches the driver are two histograms of ``buckets`` numbers, and row counts per partition for the ranks.

A null text has no words: no features, weight 0. Rows are independent but for the counts; a repeated row counts, and may
be drawn, each time. A null id hashes as no characters and comes last among equal scores, equal ids go by the number of
features. Gains of an empty table or target follow from the formula with 0 counts; an empty table gives an empty one. Of
extra columns, whatever their names, none is read. A single word is never split, however long it is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrowtext import ALNUM_LOWER, Words, buffers, slices
from .memory import lean
from .tables import done, parts, settled

N, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
CHUNK_BYTES = 262_144
#: Words of up to this many bytes are hashed a byte at a time for all words at once, longer ones each on its own.
SHORT = 48


def _crc_table() -> np.ndarray:
    """CRC-32 of single bytes, by its polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1)).astype(np.uint32)
    return c


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each span's bytes; with ``before``, of those that had that CRC so far with the span appended."""
    crc = np.zeros(len(start), np.uint32) if before is None else before.astype(np.uint32)
    crc = ~crc
    size = end - start
    long = np.flatnonzero(size > SHORT)
    order = np.argsort(-np.where(size > SHORT, 0, size), kind="stable")
    at, state = start[order], crc[order]
    ends = np.searchsorted(-np.where(size > SHORT, 0, size)[order], -np.arange(1, SHORT + 1), "right")
    for k, many in enumerate(ends):  # the spans that have a byte k
        if not many:
            break
        state[:many] = _CRC[(state[:many] ^ data[at[:many] + k]) & np.uint32(255)] ^ (state[:many] >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order] = ~state
    for i in long:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(~crc[i]))
    return out


def features(words: Words, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of 1 to n words that lies in one text, and its first word."""
    found, first_word = [], []
    begins = np.arange(len(words))
    left = np.repeat(words.first[1:], np.diff(words.first)) - begins
    crc = crc32(words.mapped, words.start, words.end)
    blank = np.array([32], np.uint8)
    for k in range(1, n + 1):
        found.append(crc % np.uint32(buckets))
        first_word.append(begins)
        more = left[begins] > k
        begins, crc = begins[more], crc[more]
        if k < n:
            crc = crc32(blank, np.zeros(len(crc), np.int64), np.ones(len(crc), np.int64), crc)
            crc = crc32(words.mapped, words.start[begins + k], words.end[begins + k], crc)
    return np.concatenate(found).astype(np.int64), np.concatenate(first_word)


def cut(text: bytes, n: int, chunk_bytes: int) -> list[tuple[int, int, int]]:
    """Chunks of a text as bytes: begin, end of what the chunk owns, and end of what it carries.

    Borders lie where no word does; what is carried are the n - 1 words that follow, or all that are left.
    """
    data = np.frombuffer(text, np.uint8)
    outside = np.flatnonzero(~ALNUM_LOWER.inside[ALNUM_LOWER.mapped[data]])
    borders = [0]
    while borders[-1] + chunk_bytes < len(data):
        k = np.searchsorted(outside, borders[-1] + chunk_bytes)
        if k == len(outside):
            break
        borders.append(int(outside[k]))
    words = Words(data, np.array([0, len(data)]), ALNUM_LOWER)
    out = []
    for begin, end in zip(borders, [*borders[1:], len(data)]):
        last = np.searchsorted(words.start, end) + n - 2  # the last word that is carried
        carried = max(end, int(words.end[min(last, len(words) - 1)])) if n > 1 and len(words) else end
        out.append((begin, end, carried))
    return out


def _keyed(docs: DataFrame, n: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows key, doc_id, text, own (bytes in which a chunk's features start; null: all): whole texts, and chunks of long ones."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.octet_length("text")
    whole = docs.where(size <= chunk_bytes).select(F.lit(None).cast("long").alias("key"), "doc_id", "text", F.lit(None).cast("long").alias("own"))

    def run(batches):
        n_row = 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py().encode()
                key = (TaskContext.get().partitionId() << 32) + n_row
                n_row += 1
                for begin, end, carried in cut(text, n, chunk_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([begin], pa.int64()), batch.column(0)[i : i + 1], pa.array([text[begin:carried].decode()], pa.string()), pa.array([end - begin], pa.int64())], names=["key", "begin", "doc_id", "text", "own"])

    chunks = docs.where(size > chunk_bytes).mapInArrow(lean(run), f"key long, begin long, doc_id {kind}, text string, own long")
    return whole, settled(chunks.repartition(parts(spark), "key", "begin").drop("begin"))


def _counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                bucket, *_ = _owned(batch, n, buckets)
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text", "own").mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def _owned(batch: pa.RecordBatch, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and rows of the features that the batch's rows own, and the number of words each row owns."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index("text")))
    words = Words(data, offsets, ALNUM_LOWER)
    row = words.rows()
    own = batch.column(batch.schema.get_field_index("own"))
    ends = np.where(np.array(own.is_null()), np.diff(offsets), np.array(own.fill_null(0))) + offsets[:-1]
    mine = words.start < ends[row] if len(words) else np.zeros(0, bool)
    bucket, first_word = features(words, n, buckets)
    return bucket[mine[first_word]], row[first_word[mine[first_word]]], np.bincount(row[mine], minlength=batch.num_rows)


def gains(spark, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) for each bucket, both with one more count."""
    b = len(source)
    s_all, t_all = float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (s_all + b) / ((source + 1.0) * (t_all + b))
    rows = spark.createDataFrame([(i, float(r)) for i, r in enumerate(ratio)], "bucket int, ratio double").select("bucket", F.floor(1000 * F.log("ratio")).alias("gain")).collect()
    out = np.zeros(b, np.int64)
    for r in rows:
        out[r.bucket] = r.gain
    return out


def _weights(texts: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """Per row of ``texts``: key, doc_id, n_words, n_features, weight."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                bucket, row, n_words = _owned(batch, n, len(gain))
                weight = np.zeros(batch.num_rows, np.int64)
                np.add.at(weight, row, gain[bucket])
                count = np.bincount(row, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n_words, count, weight))], names=["key", "doc_id", "n_words", "n_features", "weight"])

    return texts.mapInArrow(lean(run), f"key long, doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for a u in (0, 1) from the first 32 bits of SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``rank`` 1, 2, ... of the highest scores among eligible rows, for ``percent`` of their number; null for all others.

    Rows are dealt by ranges of the order they rank in; a row's rank is its place in its range after all ranges before.
    """
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    ranged = scored.where(eligible).repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    placed = settled(ranged.withColumn("place", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.max(F.col("place").bitwiseAND((1 << 33) - 1)).alias("last")).orderBy("range").collect()
    before, total = {}, 0
    for r in sizes:
        before[r.range] = total
        total += r.last + 1
    drawn = percent * total // 100
    starts = spark.createDataFrame(list(before.items()), "range long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("range", F.shiftright("place", 33)).join(F.broadcast(starts), "range", "left").withColumn("rank", F.when(rank <= drawn, rank)).drop("range", "before", "place")
    return ranked.unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", n: int = N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight, score and rank, null unless drawn."""
    spark = docs.sparkSession
    ship(spark)
    text = lambda df, c: F.coalesce(df[c], F.lit("")).alias("text")
    whole, chunks = _keyed(docs.select(F.col(id_col).alias("doc_id"), text(docs, text_col)), n, chunk_bytes)
    goal_whole, goal_chunks = _keyed(target.select(F.lit(0).alias("doc_id"), text(target, target_text_col)), n, chunk_bytes)
    gain = gains(spark, _counts(whole.unionByName(chunks), n, buckets), _counts(goal_whole.unionByName(goal_chunks), n, buckets))
    columns = ("doc_id", "n_words", "n_features", "weight")
    summed = _weights(chunks, gain, n).groupBy("key").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in columns[1:]])
    weighed = _weights(whole, gain, n).select(*columns).unionByName(summed.select(*columns))
    scored = settled(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    done(chunks, goal_chunks)
    return _ranked(scored, F.col("n_words") >= min_words, percent)


def sql(*, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> str:
    """The same over ``documents`` and ``benchmark`` for runs of one word, for an independent engine."""
    upper = "".join(map(chr, range(65, 91)))
    words = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    digits = lambda x: f"list_transform(regexp_extract_all({x}, '.'), lambda d: CAST(instr('0123456789abcdef', d) - 1 AS BIGINT))"
    return f"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
source AS (SELECT r, unnest(ws) AS w FROM docs),
target AS (SELECT unnest({words}) AS w FROM benchmark),
spelled AS (SELECT w, list_transform(regexp_extract_all(lower(hex(encode(w))), '..'), lambda h: CAST((instr('0123456789abcdef', h[1]) - 1) * 16 + instr('0123456789abcdef', h[2]) - 1 AS BIGINT)) AS bytes
  FROM (SELECT w FROM source UNION SELECT w FROM target)),
bucketed AS (SELECT w, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % {buckets} AS b FROM spelled, crc_table),
s AS (SELECT b, count(*) AS n FROM source JOIN bucketed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM target JOIN bucketed USING (w) GROUP BY b),
totals AS (SELECT (SELECT count(*) FROM source) AS s_all, (SELECT count(*) FROM target) AS t_all),
gain AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (s_all + {buckets}) / ((s.n + 1.0::DOUBLE) * (t_all + {buckets})))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b), totals),
weights AS (SELECT r, count(*) AS n, sum(g) AS weight FROM source JOIN bucketed USING (w) JOIN gain USING (b) GROUP BY r),
hashed AS (SELECT docs.r, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    list_reduce({digits("sha256(concat('" + str(seed) + ":', doc_id))[1:8]")}, lambda a, b: a * 16 + b) AS h FROM docs LEFT JOIN weights USING (r)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM hashed),
placed AS (SELECT *, n_features >= {min_words} AS able, row_number() OVER (PARTITION BY n_features >= {min_words} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {percent} * (SELECT count(*) FROM placed WHERE able) // 100 THEN place END AS rank FROM placed"""
