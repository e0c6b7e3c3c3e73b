"""Tables as logs of segments in buckets: a batch adds one segment, and every so many of them become one.

A segment is a folder ``segment=<first batch>-<last batch>`` that counts once its ``_SUCCESS`` is there; inside, rows lie in folders by bucket.  A batch so costs what
it brings; merges, at batch numbers that a power of ``fan`` divides, cost each row about its logarithm in rewrites.  A replayed batch writes its own
segment again and merges only what came before it, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Segment = tuple[int, int]


class SegmentLog:
    def __init__(self, spark: SparkSession, path: str, fan: int = 8):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan

    def folder(self, segment: Segment) -> str:
        return f"{self.path}/segment={segment[0]:09d}-{segment[1]:09d}"

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[Segment]:
        """Segments that are whole, by one listing of names; there are a few for each power of ``fan``."""
        found = self._files().globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segment=*/_SUCCESS")) or []
        names = [x.getPath().getParent().getName().partition("=")[2].split("-") for x in found]
        return sorted((int(first), int(last)) for first, last in names)

    def live(self, before: int | None = None) -> list[Segment]:
        """The widest segments that together hold all batches, or those before one."""
        rest = [s for s in self.committed() if before is None or s[1] < before]
        return [s for s in rest if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in rest)]

    def write(self, rows: DataFrame, segment: Segment) -> None:
        """``rows`` with a column ``bucket``, each bucket written by one task."""
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.folder(segment))

    def read(self, schema: str, folders: list[str]) -> DataFrame:
        """Rows of segments, or of buckets in them, by folder; ``schema`` names the columns besides ``segment``."""
        return self.spark.read.schema(f"{schema}, segment string").option("basePath", self.path).parquet(*folders).drop("segment")

    def due(self, number: int) -> Segment | None:
        """The segment that batches before ``number`` should become now, if any."""
        width = 1
        while number and number % (width * self.fan) == 0:
            width *= self.fan
        return (number - width, number - 1) if width > 1 else None

    def tidy(self, number: int) -> None:
        """Delete segments that wider ones hold, but for those that a merge at this batch or the one before may still be read with."""
        have = self.committed()
        for s in have:
            if any(o != s and o[0] <= s[0] and s[1] <= o[1] and o[1] < number - 1 for o in have):
                self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(s)), True)

    def advance(self, number: int, merge: Callable[[list[Segment], Segment], None]) -> None:
        """Merge what is due at batch ``number``, unless a run before has done so."""
        self.tidy(number)
        wide = self.due(number)
        if wide and wide not in self.committed():
            parts = [s for s in self.live(number) if wide[0] <= s[0] and s[1] <= wide[1]]
            if parts:
                merge(parts, wide)
