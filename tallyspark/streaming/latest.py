"""State under a feed of patches, kept as a log of folded deltas that readers merge.

A micro-batch folds its own patches to a row an id and adds them as one segment; it reads and rewrites nothing else.  For each field a row
holds the last value set and the number of the patch that set it, so segments fold in any order: late patches and repeated ones change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.sources.segments import Segment, SegmentLog


def fold_patches(before: DataFrame | None, patches: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """State (id, and each field with the seq it comes from) after patches (id, seq, fields), in whatever order these come."""
    new = patches.select("id", *[x for f in fields for x in (F.col(f), F.when(F.col(f).isNotNull(), F.col("seq").cast("long")).alias(f"{f}_seq"))])
    return fold_states(new if before is None else before.unionByName(new), fields)


def fold_states(states: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One state row an id: each field as its greatest seq set it."""
    return states.groupBy("id").agg(*[x for f in fields for x in (F.max_by(f, f"{f}_seq").alias(f), F.max(f"{f}_seq").alias(f"{f}_seq"))])


class StateLog:
    """The state table below a folder; ``buckets`` is the table's own."""

    def __init__(self, spark: SparkSession, path: str, types: dict[str, str], buckets: int = 32, fan: int = 8):
        self.spark, self.fields, self.buckets, self.log = spark, tuple(types), buckets, SegmentLog(spark, path, fan)
        self._schema = "id string, " + ", ".join(f"{f} {t}, {f}_seq long" for f, t in types.items()) + ", bucket int"

    def _bucketed(self, states: DataFrame) -> DataFrame:
        return states.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))

    def _rows(self, segments: list[Segment]) -> DataFrame:
        return self.log.read(self._schema, [self.log.folder(s) for s in segments])

    def append(self, patches: DataFrame, number: int) -> None:
        """Add batch ``number``; a replay writes the same segment again."""
        self.log.advance(number, lambda parts, wide: self.log.write(self._bucketed(fold_states(self._rows(parts), self.fields)), wide))
        self.log.write(self._bucketed(fold_patches(None, patches.withColumn("id", F.col("id").cast("string")), self.fields)), (number, number))

    def read(self, ids: list[str] | None = None) -> DataFrame:
        """(id, fields) as of now; given a few ids, only their buckets are opened."""
        live = self.log.live()
        rows = self._rows(live) if live else self.spark.createDataFrame([], self._schema)
        if ids is not None:
            asked = [r["b"] for r in self.spark.createDataFrame([(i,) for i in ids], "id string").select(F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]
            rows = rows.filter(F.col("bucket").isin(asked) & F.col("id").isin(list(ids)))
        return fold_states(rows, self.fields).select("id", *self.fields)


def stream_latest_state(patches: DataFrame, state: str, checkpoint: str, fields: tuple[str, ...], **options) -> StreamingQuery:
    """Fold a feed of patches (id, seq, fields) into the state log at ``state``."""
    types = {f: patches.schema[f].dataType.simpleString() for f in fields}

    def fold(batch: DataFrame, number: int) -> None:
        StateLog(batch.sparkSession, state, types, **options).append(batch, number)

    return patches.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
