"""Gets this package to Python workers that don't have it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the application, once; Spark serves it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(os.path.join(root, "facetmill"), os.path.join(folder, "src", "facetmill"), ignore=shutil.ignore_patterns("__pycache__"))
        base = os.path.join(tempfile.mkdtemp(), "facetmill")
        sc.addPyFile(shutil.make_archive(base, "zip", os.path.join(folder, "src")))
    _shipped.add(sc.applicationId)
