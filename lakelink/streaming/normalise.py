"""Normalising files as they come: each file once, whatever interrupts the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import audit
from ..sources.delimited import RECORD_COLUMNS


def normalised(records: DataFrame) -> DataFrame:
    """The raw columns, then all text views, evidence and flags of each record."""
    view = T.normalized_record("business_name", "business_address").alias("_r")
    return records.select(*RECORD_COLUMNS, view).select(*RECORD_COLUMNS, "_r.*")


def normalise_new_files(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Normalise the files under ``source`` that no earlier run with this checkpoint has; ends when there are no more. Malformed rows are errors."""
    schema = ", ".join(f"{c} string" for c in RECORD_COLUMNS)
    stream = spark.readStream.schema(schema).csv(source, sep="\t", header=True, mode="FAILFAST", enforceSchema=False, multiLine=True, quote='"', escape='"')
    filled = stream.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in RECORD_COLUMNS))
    return normalised(filled).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()


def normalising_audit(rows: DataFrame) -> DataFrame:
    """Rows, set flags, the rules that gave numbers, and changed texts, for each country and over all."""
    flags = {c.split()[0]: F.col(c.split()[0]) for c in T.FLAGS.split(", ")} | {c: F.col(c) for c in ("house_number_missing", "house_number_ambiguous", "postal_code_missing", "postal_code_ambiguous")}
    rules = {f"{kind}_{rule}": F.col(f"{kind}_source") == rule for kind, some in (("house_number", ("explicit_premise_label", "leading_number_heuristic")), ("postal_code", ("explicit_postal_label", "trailing_numeric_heuristic"))) for rule in some}
    changed = {"name_changed": F.col("business_name") != F.col("name_normalized"), "address_changed": F.col("business_address") != F.col("address_normalized")}
    return audit.flag_counts(rows, flags | rules | changed, "country")
