"""Predicted match lists from scored candidates, with a model's scores or with retrieval's alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from . import learning, scoring


def predicted(candidates: DataFrame, score: str, threshold: float) -> DataFrame:
    """The pairs whose score reaches the threshold; a null score never does."""
    return candidates.filter(F.coalesce(F.col(score) >= threshold, F.lit(False)))


def lists(population: DataFrame, candidates: DataFrame, entity: str, target: str, score: str, threshold: float = 0.55) -> DataFrame:
    """entity, matched_ids, candidate_ids: comma lists for every entity of the population, '' for none. Matches are candidates by construction.

    One aggregation: a target that several pairs name matches if any of them reaches the threshold.
    """
    best = candidates.select(entity, F.col(target).cast("string").alias("_t"), F.col(score).alias("_s")).groupBy(entity, "_t").agg(F.max("_s").alias("_s"))
    said = F.when(F.col("_s") >= threshold, F.col("_t"))
    joined = best.groupBy(entity).agg(*(F.array_join(F.sort_array(F.collect_list(c)), ",").alias(n) for n, c in (("matched_ids", said), ("candidate_ids", F.col("_t")))))
    return population.select(entity).join(joined, entity, "left").select(entity, *(F.coalesce(c, F.lit("")).alias(c) for c in ("matched_ids", "candidate_ids")))


def model_lists(model, pairs: DataFrame, population: DataFrame, entity: str, target: str, threshold: float) -> DataFrame:
    """The lists by a model's scores over pairs with its features. Pairs are scored where they are read; whole lists alone are shuffled."""
    return lists(population, learning.score(model, pairs), entity, target, "p", threshold)


def run(population: DataFrame, candidates: DataFrame, entity: str, target: str, score: str, threshold: float, path: str, truth: DataFrame | None = None) -> DataFrame | None:
    """Write ``path``/matches and ``path``/candidates as delimited files, read both again and check them; with any truth, the metrics of the matches (one row)."""
    spark = population.sparkSession
    said = predicted(candidates, score, threshold)
    for name, pairs, column in (("matches", said, "matched_entity_ids"), ("candidates", candidates, "candidate_entity_ids")):
        wanted = sinks.id_lists(population, pairs, entity, target, column)
        sinks.write_checked(wanted, f"{path}/{name}", population.select(entity))
    if not sinks.outside(said, candidates, [entity, target]).isEmpty():
        raise ValueError("a match is no candidate")
    if truth is None or truth.join(population.select(entity), entity, "left_semi").isEmpty():
        return None
    return scoring.macro(scoring.per_entity(population.select(entity), scoring.set_counts(truth, said, entity, target), entity)).withColumn("threshold", F.lit(threshold).cast("double"))
