"""Readers and writers: CSV masters and dumps, growing schemas, logs and saved extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallyspark.functions.text import blank_to_empty
from tallyspark.sources.scratch import stored

#: Headers that name each column of the project master.
MASTER_HEADERS = {
    "otp": ("otp",), "project_name": ("project name", "project", "project_name"), "business_unit": ("business unit", "businessunit", "business_unit"),
    "pd": ("pd", "pd name", "pd_name"), "spl_pl": ("spl/pl", "spl_pl", "splpl"),
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted newlines and a byte-order mark are read well."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])


def master_csv_import(spark: SparkSession, path: str, headers: dict[str, tuple[str, ...]] = MASTER_HEADERS, key: str = "otp") -> DataFrame:
    """The project master: headers in any case and under their aliases, values trimmed, rows without key dropped."""
    raw = read_csv(spark, path)
    have = {c.lower(): c for c in raw.columns}
    pick = lambda names: next((F.col(f"`{have[n]}`") for n in names if n in have), F.lit(""))
    return raw.select(*[F.trim(blank_to_empty(pick(names))).alias(c) for c, names in headers.items()]).filter(F.col(key) != "")


def csv_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def add_missing_columns(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Declared columns that a table lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in declared.items() if c not in df.columns})


def append_growing_schema(before: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows under all columns; what a row lacks is null."""
    return before.unionByName(new, allowMissingColumns=True)


#: Folder beside a growing table's rows with a line for each column that came; names that begin so are no rows to readers.
SCHEMA_LOG = "_columns"
_ENTRY = "name string, kind string, since timestamp"


def logged_schema(spark: SparkSession, path: str) -> StructType | None:
    """Columns of a growing table by their log, in order of their coming; null without one. Entries of appends at one time fold."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SCHEMA_LOG}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    entries = spark.read.schema(_ENTRY).json(f"{path}/{SCHEMA_LOG}").groupBy("name").agg(F.min("since").alias("since"), F.collect_set("kind").alias("kinds"))
    rows = entries.orderBy("since", "name").collect()  # as many rows as the table has columns
    if odd := [r["name"] for r in rows if len(r["kinds"]) > 1]:
        raise ValueError(f"columns of several types: {odd}")
    return StructType([StructField(r["name"], StructType.fromDDL(f"x {r['kinds'][0]}")[0].dataType) for r in rows])


def log_schema(df: DataFrame, path: str) -> None:
    """Log the columns of ``df`` that the table's log lacks; a column of another type than before is an error. Names count in lower case too."""
    spark = df.sparkSession
    have = {f.name.lower(): f.dataType.simpleString() for f in logged_schema(spark, path) or ()}
    if odd := [f.name for f in df.schema if have.get(f.name.lower(), f.dataType.simpleString()) != f.dataType.simpleString()]:
        raise ValueError(f"the table has other types for {odd}")
    new = [(f.name, f.dataType.simpleString()) for f in df.schema if f.name.lower() not in have]
    if new:
        spark.createDataFrame(new, "name string, kind string").coalesce(1).withColumn("since", F.current_timestamp()).write.mode("append").json(f"{path}/{SCHEMA_LOG}")


def append_parquet(df: DataFrame, path: str, *partitions: str) -> None:
    """Append to a table whose columns may grow: the log first, so that no row has a column that it lacks."""
    log_schema(df, path)
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def read_growing(spark: SparkSession, path: str) -> DataFrame:
    """All rows under all columns by the table's log, without a look into its files; older rows are null. Tables without a log merge their files' schemas."""
    schema = logged_schema(spark, path)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.option("mergeSchema", True).parquet(path)


#: Columns of the log's CSV twin; what else an event carries is in the table alone.
ACTIVITY_CSV = ("ts", "event", "entry_id", "done_by")


def activity_append(events: DataFrame, path: str, csv_path: str | None = None) -> None:
    """Append log events, partitioned by day, and to the CSV twin if there is one.

    Both writes read one stored copy, so that an event is in both or, after a failure, is written by the repeated run.
    """
    events = stored(events, "activity")
    append_parquet(events.withColumn("day", F.to_date("ts")), path, "day")
    if csv_path:
        rows = add_missing_columns(events, dict.fromkeys(ACTIVITY_CSV, "string"))
        rows.select(*[blank_to_empty(F.col(c)).alias(c) for c in ACTIVITY_CSV]).write.mode("append").option("header", True).option("escape", '"').csv(csv_path)


def extraction_rows(extracted: DataFrame) -> DataFrame:
    """Extracted values as a JSON object, for saving."""
    return extracted.select("doc_id", "vendor", "report", F.to_json("values").alias("values_json"))


def extraction_save(extracted: DataFrame, path: str) -> None:
    """Append extractions to a saved table."""
    append_parquet(extraction_rows(extracted), path)
