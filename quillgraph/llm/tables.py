"""Reading tables, cutting lineage and checking sizes, the same way in every operator."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of this machine only in local mode, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder: on a cluster it must be one that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settled(df: DataFrame, *, codec: str = "zstd") -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: lineage ends, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/quill-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def done(*frames: DataFrame | None) -> None:
    """Deletes the files of settled frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "settled_at", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets shuffle files of finished jobs go: they stay until the driver has collected what refers to them, in two rounds."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame doesn't have yet, made of the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns c0, c1, ..., which clash with nothing an operator adds, and the new name of each old one."""
    new = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new))


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the number to deal keyed blobs to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A settled frame marked for broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
