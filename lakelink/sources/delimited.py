"""Strict readers of delimited files, and audits of their shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")


def read_strict(spark: SparkSession, path: str, columns=RECORD_COLUMNS) -> DataFrame:
    """A tab-separated file with exactly these columns, all strings, empty cells as ''. Rows of another width and other headers are errors.

    The width is only checked where all columns are read: use the result as it is, or ``shape`` first.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    got = spark.read.schema(schema).csv(path, sep="\t", header=True, mode="FAILFAST", enforceSchema=False, multiLine=True, quote='"', escape='"')
    return got.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns))


def read_raw(spark: SparkSession, path: str, source: int) -> DataFrame:
    """The same file without quoting, with the columns renamed by place and the number of the source."""
    got = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False).toDF("id", "name", "addr", "country")
    return got.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in got.columns)).withColumn("src", F.lit(source).cast("byte"))


def shape(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """columns, lines: how many lines have how many columns."""
    return spark.read.text(path).groupBy(F.size(F.split("value", "\t")).cast("long").alias("columns")).agg(F.count("*").alias("lines"))


def malformed(spark: SparkSession, path: str, expected: int, most: int = 5) -> DataFrame:
    """file, offset, columns, value: the first malformed lines, as a report shows them, by file and by the line's place among the lines of its part of the file (a large file is read in parts)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("offset"), F.size(F.split("value", "\t")).cast("long").alias("columns"), "value")
    return lines.filter(F.col("columns") != expected).orderBy("file", "_block", "offset").limit(most).select("file", "offset", "columns", "value")


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a delimited file with a header: the reader parses no others."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False, multiLine=True, quote='"', escape='"').select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns))


def union_sources(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in frames])


def keep_ids(records: DataFrame, keep: DataFrame, on: str) -> DataFrame:
    """Records whose id is wanted, as a semi-join: nothing but ids of ``keep`` moves."""
    return records.join(keep.select(on).distinct(), on, "left_semi")
