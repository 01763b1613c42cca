"""What the corpus operators share: table access, the shared work folder, Arrow helpers.

Conventions of every operator in this subpackage:

* a null text counts as an empty text, unless a docstring says otherwise;
* a repeated row is a row of its own and gets its own result row;
* only the named input columns are read, so extra columns never clash with results;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import materialise, scratch, shared_dir  # noqa: F401

#: Text bytes that one step of a Python worker handles at a time.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filter_in_arrow(docs: DataFrame, run) -> DataFrame:
    """``docs.mapInArrow`` for a function that drops rows and reads ``text`` alone: all columns come back, whatever their names (Spark's own takes no dots in them)."""
    plain = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that a piece holds about ``most`` bytes of ``column``; one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    col = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def fold_remainder(doc_id, mod: int):
    """crc32 of the id's decimal text, modulo ``mod``: the fold rule of the labelled queries."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


class Memo(dict):
    """A bounded cache of a function of one key: emptied when full, so results never depend on it."""

    def __init__(self, f, most: int = 1 << 19):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.f(key)
        return value
