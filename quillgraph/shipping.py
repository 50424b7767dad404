"""Getting this package to Python workers that don't have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Once per context: a zip of the package, which the driver serves and executors fetch.

    Rows go to Python workers in batches of ``BATCH_BYTES``, unless the session names a size: an executor holds several
    copies of each task's batch, in buffers that double as they fill.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_quillgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quill-")) / "quillgraph.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(str(target))
    context._quillgraph_shipped = True
