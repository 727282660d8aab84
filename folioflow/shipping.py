"""Gives the executors this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session, so that Python functions in it can be imported there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="folioflow-ship-"), "folioflow.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
