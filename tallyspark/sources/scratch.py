"""Tables that cut lineage: written under the shared checkpoint folder and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``, deleted when the application ends.

    Where that setting is unset, a temporary folder serves a local session; on a cluster executors could not see it, so that is an error.
    """
    context = spark.sparkContext
    root = getattr(context, "_tallyspark_scratch", None)
    if root is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.partition("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-scratch-")
        root = context._tallyspark_scratch = f"{base.rstrip('/')}/tallyspark-{context.applicationId}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return root


def _made(spark: SparkSession) -> list[str]:
    """Paths given out so far and not deleted since."""
    context = spark.sparkContext
    if not hasattr(context, "_tallyspark_paths"):
        context._tallyspark_paths = []
    return context._tallyspark_paths


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's scratch folder."""
    _made(spark).append(f"{_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _made(spark)[-1]


@contextmanager
def only_last_kept(spark: SparkSession) -> Iterator[None]:
    """On leaving, all scratch tables made inside are deleted but the last: for a step whose result is a stored table that nothing else is read for."""
    before = len(_made(spark))
    yield
    paths = _made(spark)
    for path in paths[before:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del paths[before:-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that a lost executor costs a re-read, not a re-run."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
