"""Sends this package to the executors, whose Python starts in a folder of its own."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of a batch that goes to Python.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Once for each Spark application; batches are bounded in each session. The archive is built here and goes through Spark's own file server."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="meshlens-"), "meshlens.zip")
    Path(path).write_bytes(made.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
