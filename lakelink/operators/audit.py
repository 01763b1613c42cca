"""Integrity audits: keys, references between tables, and what cells hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import is_blank, is_null_like, is_padded

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has, with ``rows``."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def orphans(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of the left table without a partner in the right one."""
    keys = right.select(F.col(right_key).alias("_k")).distinct()
    return left.join(keys, left[left_key] == keys["_k"], "left_anti")


def shared_ids(a: DataFrame, b: DataFrame, a_key: str, b_key: str, name: str = "id") -> DataFrame:
    return a.select(F.col(a_key).alias(name)).intersect(b.select(F.col(b_key).alias(name)))


def owners_of(edges: DataFrame, owner: str, target: str) -> DataFrame:
    """Targets that several owners claim, with ``owners``."""
    return edges.select(owner, target).distinct().groupBy(target).agg(F.count("*").alias("owners")).filter("owners > 1")


def distribution(df: DataFrame, value: Column) -> DataFrame:
    """Count, least, greatest, mean and linearly interpolated quantiles: from a histogram, so equal values travel once."""
    hist = df.groupBy(value.alias("_v")).agg(F.count("*").alias("_n")).filter("_v is not null")
    p = F.percentile("_v", F.array(*map(F.lit, QUANTILES)), F.col("_n"))
    got = hist.agg(F.sum("_n").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("greatest"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), p.alias("_p"))
    return got.select("n", "least", "greatest", "mean", *(F.col("_p")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(QUANTILES)))


def cell_audit(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """For each column the rows that are blank, like null, padded or null: one pass, one aggregation."""
    tests = {"blank": is_blank, "null_like": is_null_like, "padded": is_padded, "null": lambda c: c.isNull()}
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count_if(test(F.col(c))).alias(f"{c}_{name}") for c in columns for name, test in tests.items()))


def match_kind(ids: Column) -> Column:
    two, three = F.exists(ids, lambda x: x.startswith("S2-")), F.exists(ids, lambda x: x.startswith("S3-"))
    return F.when(two & three, "both").when(two, "S2_only").when(three, "S3_only").otherwise("singleton")


def truth_audit(truth: DataFrame, ids: str = "matched_entity_ids") -> DataFrame:
    """kind, entities, edges, duplicate_lists, bad_tokens by kind of match list (a comma list)."""
    parts = F.when(F.col(ids) == "", F.array().cast("array<string>")).otherwise(F.split(ids, ",", -1))
    rows = truth.select(parts.alias("_ids")).withColumn("kind", match_kind(F.col("_ids")))
    bad = F.size(F.filter("_ids", lambda x: ~x.rlike(r"^S[23]-[^\s,]+\z")))
    return rows.groupBy("kind").agg(
        F.count("*").alias("entities"), F.sum(F.size("_ids")).alias("edges"), F.count_if(F.size(F.array_distinct("_ids")) != F.size("_ids")).alias("duplicate_lists"), F.sum(bad).alias("bad_tokens")
    )


def flag_counts(df: DataFrame, flags: dict[str, Column], by: str) -> DataFrame:
    """Rows and set flags for each value of ``by`` and, where it is null and ``is_total`` is 1, over all."""
    named = df.select(F.col(by), *(f.cast("long").alias(n) for n, f in flags.items()))
    return named.rollup(by).agg(F.grouping(by).cast("long").alias("is_total"), F.count("*").alias("rows"), *(F.sum(n).alias(n) for n in flags))


def first_examples(df: DataFrame, kind: str, order: str, n: int = 3) -> DataFrame:
    """The first rows of each kind."""
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(order))).filter(F.col("place") <= n)
