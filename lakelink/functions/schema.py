"""Schemas from short text, without a session: modules with Arrow UDFs are imported by workers, too."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "array<string>": T.ArrayType(T.StringType())}


def struct(text: str) -> T.StructType:
    """'a string, b int' as a struct type."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (part.split() for part in text.split(", "))])
