"""Make this package importable by Python workers that do not share the driver's import path, and bound their batches."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Bytes of an Arrow batch, where the session sets none: workers hold a few copies of a batch.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the session's Python files, once per application."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory(prefix="weftspark-py-")
    atexit.register(folder.cleanup)
    path = Path(folder.name) / "weftspark_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
