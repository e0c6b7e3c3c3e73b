"""Labelled rows to learn from: a bounded sample outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3 (a null id does not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of the labelled documents outside the held-out fold with the least hashed ids, ``most`` ids at most.

    A document repeated under one id comes repeatedly; callers limit again once texts have become small features.
    """
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min(label).alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # ``ids`` is bounded by ``most``.
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "label")
