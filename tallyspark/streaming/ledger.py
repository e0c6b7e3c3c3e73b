"""A ledger of ids that stays cheap to ask: ids in hash buckets by segment, each bucket with a Bloom filter.

A batch's ids are tested against the filters of their own buckets.  Ids that no filter knows are new without any look at the ledger; only
the buckets of segments that may hold an id are opened.  Filters take two bytes an id, and a segment's false answers are about one in a thousand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.sources.segments import Segment, SegmentLog

BITS_PER_ID, PROBES = 16, 6
_FILTER = "bucket int, first long, last long, bits binary"


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """PROBES bit places of each hash."""
    h = hashes.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)


def filter_bits(hashes: np.ndarray) -> bytes:
    """Bloom filter of hashes, its size by their number."""
    bits = np.zeros(max(64, len(hashes) * BITS_PER_ID + 7 & ~7), bool)
    bits[_places(hashes, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    table = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return table[_places(hashes, len(table))].all(axis=1)


class Ledger:
    """Ids under a folder: ``ids`` and ``filters``, both by segment and bucket. ``buckets`` is the table's own: about one for a million ids."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "entry_id", buckets: int = 32, fan: int = 8):
        self.spark, self.id_col, self.buckets = spark, id_col, buckets
        self.ids, self.filters = SegmentLog(spark, f"{path}/ids", fan), SegmentLog(spark, f"{path}/filters", fan)
        self._schema = f"`{id_col}` string, hash long, bucket int"

    def keyed(self, rows: DataFrame) -> DataFrame:
        """Different ids of rows, with their hash and bucket."""
        h = F.xxhash64(self.id_col)
        return rows.select(F.col(self.id_col).cast("string").alias(self.id_col)).filter(F.col(self.id_col).isNotNull()).distinct().withColumns({"hash": h, "bucket": F.pmod(h, F.lit(self.buckets)).cast("int")})

    def _write(self, ids: DataFrame, segment: Segment) -> None:
        """Ids first, then their filters, whose ``_SUCCESS`` makes the segment count."""
        self.ids.write(ids, segment)
        first, last = segment

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "first": [first], "last": [last], "bits": [filter_bits(rows["hash"].to_numpy())]})

        written = self.ids.read(self._schema, [self.ids.folder(segment)])
        self.filters.write(written.select("bucket", "hash").groupBy("bucket").applyInPandas(build, _FILTER), segment)

    def buckets_to_open(self, ids: DataFrame, before: int) -> list[str]:
        """Folders that may hold one of the ids; at most as many as segments have buckets."""
        live = self.filters.live(before)
        if not live:
            return []
        tests = self.filters.read(_FILTER, [self.filters.folder(s) for s in live])

        def probe(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            hashes = asked["hash"].to_numpy()
            hit = [len(hashes) > 0 and bool(may_hold(bits, hashes).any()) for bits in known["bits"]]
            return known.loc[hit, ["bucket", "first", "last"]]

        found = ids.groupBy("bucket").cogroup(tests.groupBy("bucket")).applyInPandas(probe, "bucket int, first long, last long")
        return sorted(f"{self.ids.folder((r['first'], r['last']))}/bucket={r['bucket']}" for r in found.collect())

    def seen(self, ids: DataFrame, before: int) -> DataFrame:
        """Those of the ids that batches before one brought."""
        folders = self.buckets_to_open(ids, before)
        if not folders:
            return ids.select(self.id_col).limit(0)
        known = self.ids.read(self._schema, folders)
        return ids.select(self.id_col, "hash").join(known, [self.id_col, "hash"], "left_semi").select(self.id_col)

    def append(self, rows: DataFrame, number: int) -> None:
        """Add the ids of batch ``number`` that are new; a replay writes the same again."""
        self.filters.advance(number, self._merge)
        self.ids.tidy(number)
        ids = self.keyed(rows).persist()
        self._write(ids.join(self.seen(ids, number), self.id_col, "left_anti"), (number, number))
        ids.unpersist()

    def _merge(self, parts: list[Segment], wide: Segment) -> None:
        self._write(self.ids.read(self._schema, [self.ids.folder(s) for s in parts]), wide)

    def read(self) -> DataFrame:
        """All ids, each once."""
        live = self.filters.live()
        return self.ids.read(self._schema, [self.ids.folder(s) for s in live]).select(self.id_col) if live else self.spark.createDataFrame([], f"`{self.id_col}` string")


def write_new_mail(mails: DataFrame, path: str, checkpoint: str, id_col: str = "entry_id", **options) -> StreamingQuery:
    """Each micro-batch adds the mail ids that the ledger at ``path`` lacks."""

    def append(batch: DataFrame, number: int) -> None:
        Ledger(batch.sparkSession, path, id_col, **options).append(batch, number)

    return mails.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
