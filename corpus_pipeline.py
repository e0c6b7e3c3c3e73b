"""A corpus pipeline of the training-data operators: each stage works on what the one before it kept.

Defined results of all stages: an empty table gives no rows; extra columns, whatever their names, pass unchanged through all
stages but the last; repeated rows are treated alike; a text of any length is worked on whole; rows without id stay unless their text goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import decontamination, factorisation, merge_dropout, repeats, simhash
from tallyspark.llm.queries import table, tokenizer
from tallyspark.llm.scratch import only_last_kept, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored by their statistics, and a score of just 0.5 stays."""
    return factorisation.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id.

    Null and empty texts are copies of each other; rows repeated under the id that stays all stay.
    """
    return simhash.keep_one_of_each(docs, similarity=0.8, words=5, shingle=3, max_bits=2)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that repeat are taken out of the text, wherever they stand; a text that loses none stays as it is, null included."""
    return repeats.cut_repeats(docs, length=35)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and a coverage of just the threshold goes."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, with merge-dropout; null and empty texts have no pieces."""
    return merge_dropout.encode(docs, tokenizer("piece_bpe_32k.model"), rate=0.1, seed=1, part_bytes=1 << 19)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontaminated", decontaminated), ("encoded", encoded)]

#: Trained weights, XXH64 fingerprints, greedy tiling and keyed merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; what a stage has stored on its way goes once its result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with only_last_kept(spark):
            # The result's path is given out after those of the stage itself.
            result = stage(spark, docs, sf_dir)
            docs = stored(result, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
