"""Documents, exports and vector indexes in files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as path, length and content, for converters of formats that Spark doesn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def pdf_pages(files: DataFrame) -> DataFrame:
    """path and an estimate of pages of PDF files, from their page objects; text needs a PDF library, which isn't here."""
    text = F.decode("content", "ISO-8859-1")
    return files.select("path", F.greatest(F.regexp_count(text, F.lit(r"/Type\s*/Page[^s]")), F.lit(1)).alias("pages"))


def html_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with title and plain text: scripts, styles, comments and tags dropped, the commonest entities decoded."""
    clean = F.col(html_col)
    for pattern, by in ((r"(?is)<(script|style)[^>]*>.*?</\1>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)<br[^>]*>|</(p|div|h[1-6]|li|tr)>", "\n"), (r"<[^>]*>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"[ \t]+", " "), (r"\s*\n\s*", "\n")):
        clean = F.regexp_replace(clean, pattern, by)
    return pages.withColumns({"title": F.nullif(F.regexp_extract(html_col, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")), "text": F.trim(clean)})


def read_template(spark: SparkSession, path: str, fields: dict[str, str], *, limit: int | None = None, format: str = "parquet") -> DataFrame:
    """A source with its columns renamed by ``fields`` (new name to source column); no limit unless one is given."""
    df = spark.read.format(format).load(path).select(*[F.col(source).alias(name) for name, source in fields.items()])
    return df.limit(limit) if limit is not None else df


def save_index(vectors: DataFrame, path: str, *, model: str = "none", vector_col: str = "v") -> None:
    """Vectors of the commonest size as a table, with its size and model beside it."""
    size = vectors.groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = size.n if size else 0
    vectors.where(F.size(vector_col) == dims).write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(json.dumps({"dimension": dims, "model": model}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/vectors"), json.loads(spark.read.text(f"{path}/meta").first().value)


def export(df: DataFrame, path: str, format: str = "json") -> None:
    """A table as JSON lines, CSV with a header, Parquet or N-Triples."""
    if format == "nt":
        from .ntriples import write

        write(df, path)
    elif format == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(format).save(path)
