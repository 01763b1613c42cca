"""Column functions over identifiers and raw cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "no value", in lower case.
NULL_LIKE = ("null", "none", "nan", "na", "n/a", "<na>")


def entity_hash(entity: Column, seed: int) -> Column:
    """SHA-256 hex of the JSON list [seed,"id"]; the same on every machine and for any partitioning."""
    return F.sha2(F.concat(F.lit(f"[{seed},\""), entity.cast("string"), F.lit('"]')), 256)


def stripped(c: Column) -> Column:
    """Without leading and trailing Unicode white space (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return stripped(c) == ""


def is_null_like(c: Column) -> Column:
    return F.lower(stripped(c)).isin(*NULL_LIKE)


def is_padded(c: Column) -> Column:
    return c != stripped(c)


def is_reference_id(c: Column) -> Column:
    return c.rlike(r"^S1-[^\s,]+\z")


def checked_reference_id(c: Column) -> Column:
    return F.when(is_reference_id(c), c).otherwise(F.raise_error(F.concat(F.lit("not a reference id: "), c)))


def id_list(c: Column) -> Column:
    """The ids of a comma list ('' is none). Repeated ids, other prefixes, blanks and empty parts raise an error."""
    ids = F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ",", -1))
    good = F.forall(ids, lambda x: x.rlike(r"^S[23]-[^\s,]+\z")) & (F.size(F.array_distinct(ids)) == F.size(ids))
    return F.when(good, ids).otherwise(F.raise_error(F.concat(F.lit("bad id list: "), c)))


def shard(entity: Column, count: int, index: int) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(count)) == index


def sampled(entity: Column, share: float, seed: int = 0) -> Column:
    """A deterministic sample: the same rows whatever the order or the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), entity), F.lit(1_000_000)) < int(share * 1_000_000)
