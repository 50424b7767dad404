"""Sharding by extendible hashing, in DataFrame functions only.

A directory is indexed by the leading bits of a hash of each row's id. A bucket that is over the byte limit splits on
its next bit, and only such a bucket: so a row's shard is the shortest prefix of its hash whose rows fit the limit.
Sizes of all prefixes come from one pre-aggregated histogram at a depth that suits the total; rows whose cell is still
too large there go through the next depths alone, until all fit or the hash has no more bits.

Rows with equal ids have equal hashes, which no bit separates. If such rows exceed the limit together, they are dealt
to overflow shards by input partition and place in it. A single row over the limit is a shard of its own, ``oversize``.
Null ids hash as the empty string and null texts have 0 bytes. Extra columns are kept; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import renamed, settled, small

BITS, LIMIT_BYTES, STEP, BROADCAST_ROWS = 48, 1 << 20, 8, 200_000


def hash_bits(key: Column) -> Column:
    """The first 48 bits of the MD5 of an id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def _prefix(h: Column | str, depth) -> Column:
    h = F.col(h) if isinstance(h, str) else h
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _leaves(sizes: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each cell of ``high`` bits its bucket: depth, prefix, bytes and rows; depth is null where ``high`` bits are too few.

    ``sizes``: cell, bytes, rows. Buckets have ``low`` bits at least.
    """
    cells = sizes.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = cells.groupBy("depth", "prefix").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).where(F.col("b") <= limit)
    fits = cells.select("cell", "depth", "prefix").join(sums, ["depth", "prefix"])
    best = fits.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "b", "r")).alias("leaf"))
    return sizes.select("cell").join(best, "cell", "left").select("cell", F.col("leaf.depth").alias("depth"), F.col("leaf.prefix").alias("prefix"), F.col("leaf.b").alias("shard_bytes"), F.col("leaf.r").alias("shard_rows"))


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """``docs`` with n_bytes, shard (the bits of its prefix, ``*`` for none), depth, shard_bytes, shard_rows and oversize, which replace columns of these names."""
    own = ["n_bytes", "shard", "depth", "shard_bytes", "shard_rows", "oversize"]
    docs = docs.drop(*own)
    names = docs.columns
    docs, at = renamed(docs)
    id_col, text_col = at[id_col], at[text_col]
    rows = docs.select("*", F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col(id_col)).alias("h_"))
    sizes_only = rows.select("h_", "n_bytes")
    total = sizes_only.agg(F.sum("n_bytes")).first()[0] or 0
    bits = lambda depth, prefix: F.when(depth == 0, "*").otherwise(F.lpad(F.bin(prefix), depth, "0"))
    low, high = 0, min(BITS, max(1, (total // limit).bit_length() + 4))
    out, rest = None, rows
    while True:
        sizes = rest.select("h_", "n_bytes").groupBy(_prefix("h_", F.lit(high)).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        leaves = settled(_leaves(sizes, low, high, limit))
        over = leaves.where("depth is null").select("cell")
        placed = rest.withColumn("cell_", _prefix("h_", F.lit(high))).join(small(leaves.where("depth is not null").withColumnRenamed("cell", "cell_"), BROADCAST_ROWS), "cell_")
        placed = placed.select(*docs.columns, "n_bytes", bits(F.col("depth"), F.col("prefix")).alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", F.lit(False).alias("oversize"))
        out = placed if out is None else out.unionByName(placed)
        if not over.limit(1).count():
            return out.toDF(*names, *own)
        rest = rest.withColumn("cell_", _prefix("h_", F.lit(high))).join(small(over.withColumnRenamed("cell", "cell_"), BROADCAST_ROWS), "cell_", "left_semi").drop("cell_")
        if high == BITS:
            return out.unionByName(_overflow(rest, docs.columns, limit)).toDF(*names, *own)
        low, high = high + 1, min(BITS, high + STEP)


def _overflow(rest: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """Rows of one hash over the limit, dealt by input partition: as many to a shard as fit at the size of the largest."""
    rest = rest.withColumn("part_", F.spark_partition_id())
    here = Window.partitionBy("h_", "part_")
    largest = F.max("n_bytes").over(here)
    place = F.row_number().over(here.orderBy("n_bytes")) - 1
    cut = rest.withColumn("k_", F.floor(place / F.greatest(F.floor(F.lit(limit) / F.greatest(largest, F.lit(1))), F.lit(1))))
    one = Window.partitionBy("h_", "part_", "k_")
    name = F.concat(F.lpad(F.bin("h_"), BITS, "0"), F.lit("/"), F.col("part_"), F.lit("."), F.col("k_"))
    return cut.select(*columns, "n_bytes", name.alias("shard"), F.lit(BITS).cast("int").alias("depth"), F.sum("n_bytes").over(one).alias("shard_bytes"), F.count("*").over(one).alias("shard_rows"), (F.col("n_bytes") > limit).alias("oversize"))


def sql(limit: int = LIMIT_BYTES, depth: int = 24) -> str:
    """The same over ``documents`` for an engine without shifts of this kind; for tables whose buckets need at most ``depth`` bits."""
    digits = "'0123456789abcdef'"
    value = " + ".join(f"CAST(strpos({digits}, substr(m, {i + 1}, 1)) - 1 AS BIGINT) * {16 ** (11 - i)}" for i in range(12))
    return f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
h AS (SELECT doc_id, n_bytes, {value} AS h FROM d),
c AS (SELECT doc_id, n_bytes, depth, h // CAST(pow(2, {BITS} - depth) AS BIGINT) AS prefix FROM h, (SELECT unnest(range(0, {depth + 1})) AS depth)),
s AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM c GROUP BY 1, 2 HAVING sum(n_bytes) <= {limit}),
b AS (SELECT c.doc_id, c.n_bytes, c.depth, c.prefix, s.shard_bytes, s.shard_rows, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.depth) AS r FROM c JOIN s ON c.depth = s.depth AND c.prefix = s.prefix)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '*' ELSE right(lpad(bin(prefix), 64, '0'), CAST(depth AS INTEGER)) END AS shard, CAST(depth AS INTEGER) AS depth, shard_bytes, shard_rows, false AS oversize FROM b WHERE r = 1
"""
