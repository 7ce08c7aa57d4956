"""Making the package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors of this session, once.

    The archive is served by the driver, so no folder needs to be shared.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="quillon-ship-"), "quillon_package.zip")
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(path)
    sc._quillon_shipped = True
