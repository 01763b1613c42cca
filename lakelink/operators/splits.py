"""Deterministic stratified splits and transfer modes between segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import entity_hash


def validation_size(n: Column, share: float) -> Column:
    """Rows that a stratum of n gives to validation: none of one, else at least one and at most all but one."""
    return F.when(n == 1, 0).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.floor(n * share + 0.5)))).cast("long")


def stratified(entities: DataFrame, entity: str, strata: list[str], share: float = 0.2, seed: int = 20260925) -> DataFrame:
    """Add split_hash and role ('train' or 'validation'). Sizes come from a count of each stratum and a join, ranks from one window."""
    hashed = entities.withColumn("split_hash", entity_hash(F.col(entity), seed))
    w = Window.partitionBy(*strata)
    ranked = hashed.withColumns({"_at": F.row_number().over(w.orderBy("split_hash", entity)), "_n": F.count("*").over(w)})
    return ranked.withColumn("role", F.when(F.col("_at") <= validation_size(F.col("_n"), share), "validation").otherwise("train")).drop("_at", "_n")


def modes(segments: DataFrame, segment: str) -> DataFrame:
    """mode, train_segment, test_segment: 'grouped' and one transfer mode for each ordered pair of segments (a table of segments is small: its square is)."""
    names = segments.select(segment).distinct()
    pairs = names.select(F.col(segment).alias("train_segment")).join(names.select(F.col(segment).alias("test_segment")), F.col("train_segment") != F.col("test_segment"))
    numbered = pairs.withColumn("mode", F.format_string("transfer_%02d", F.row_number().over(Window.orderBy("train_segment", "test_segment"))))
    whole = names.sparkSession.createDataFrame([("grouped", None, None)], "mode string, train_segment string, test_segment string")
    return whole.unionByName(numbered.select("mode", "train_segment", "test_segment"))


def role(mode: tuple[str, str | None, str | None], segment: Column, grouped_role: Column) -> Column:
    """A row's role under a mode: its own when grouped; in transfer the train segment trains, the test segment validates, others are out."""
    name, train, test = mode
    if name == "grouped":
        return grouped_role
    return F.when(segment == train, "train").when(segment == test, "validation").otherwise("excluded")


def fold(entity: Column, folds: int) -> Column:
    return F.pmod(F.conv(F.substring(entity_hash(entity, 0), 1, 8), 16, 10).cast("long"), F.lit(folds))


def group_codes(entities: DataFrame, entity: str, name: str = "code") -> DataFrame:
    """entity, code: the distinct entities numbered from 0 without gaps, in the order of their hashes.

    Sizes of 4096 ranges of the hash give each range its first number, so no task numbers them all.
    """
    each = entities.select(entity).distinct().withColumn("_h", entity_hash(F.col(entity), 0)).withColumn("_range", F.substring("_h", 1, 3))
    sizes = each.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(sizes.select("_range", before.alias("_first")))  # 4096 rows at most
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_h", entity)) - 1
    return each.withColumn("_at", place).join(first, "_range").select(entity, (F.col("_first") + F.col("_at")).alias(name))


def evaluation_pools(pairs: DataFrame, held: DataFrame, pool: str, entity: str, rank: str, within: int = 3) -> DataFrame:
    """pool, held: every pool record of the pairs, and whether a held-out entity is among its first candidates; such a record must not train."""
    marked = pairs.join(held.select(entity).distinct().withColumn("_held", F.lit(True)), entity, "left")
    return marked.groupBy(pool).agg(F.coalesce(F.max(F.col("_held") & (F.col(rank) < within)), F.lit(False)).alias("held"))


def shown(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows to look at, drawn by a hash of the key: the same ones whatever the order of rows."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
