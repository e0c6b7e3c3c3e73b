"""Spark jobs for idea pipelines, vendor-report reconciliation and training data."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application (needed where their PYTHONPATH lacks it)."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "tallyspark.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("tallyspark", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._tallyspark_shipped = True
