"""Gives the executors this package, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; the archive goes through Spark's file server."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="rivulet-"), "rivulet_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(Path("rivulet") / p.relative_to(PACKAGE)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
