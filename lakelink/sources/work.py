"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session has no such setting and all of it runs on this machine (tests) a folder of this machine serves; a cluster without the setting is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakelink-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lakelink/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: Sequence[str] = (), rows_a_file: int = 0, more: Sequence[DataFrame] = ()) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and fixes values for later passes. ``more``: further rows of the same table, written one after the other."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    for rows in (df, *more):
        rows.write.mode("append").option("maxRecordsPerFile", rows_a_file).partitionBy(*by).parquet(path)
    for scratch in _scratch.get(()):
        scratch.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._lakelink_path = path  # for ``drop``
    return table


_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work tables written inside are removed at the end. Only for results that are written themselves, outside, or that no longer read those tables."""
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        _delete(spark, paths)


def _delete(spark: SparkSession, paths: Sequence[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Remove work tables before the end of their ``scratch``: nothing may read them any more."""
    for table in tables:
        _delete(table.sparkSession, [table._lakelink_path])
