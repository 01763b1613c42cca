"""Members of ZIP archives."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MEMBERS = "archive string, name string, bytes long, crc32 long, content binary"


def _unzip(batches):
    names = [x.split()[0] for x in MEMBERS.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            with zipfile.ZipFile(io.BytesIO(content.as_buffer().to_pybytes())) as whole:
                for member in whole.infolist():
                    parts = member.filename.replace("\\", "/").split("/")
                    if member.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
                        raise ValueError(f"{path}: a member leads out of the archive: {member.filename}")
                    if not member.is_dir():  # reading checks the CRC
                        row = (path, member.filename, member.file_size, member.CRC, whole.read(member))
                        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, bytes, crc32, content of every member. Damaged members and names that lead out of the archive are errors. A file is read as one value: 2 GB at most."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_unzip, MEMBERS)
