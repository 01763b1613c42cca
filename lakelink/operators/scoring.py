"""Population-aware set metrics, threshold sweeps, assignment and retrieval diagnostics.

Scores are taken over a population of entities, so that entities without any pair count. Entities are
never derived from pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f_half(tp: Column, fp: Column, fn: Column) -> Column:
    """F0.5 of one entity; without truth 1 for no prediction and 0 else."""
    return F.when(tp + fn == 0, F.when(fp == 0, 1.0).otherwise(0.0)).otherwise(5 * tp / (5 * tp + 4 * fp + fn))


def set_counts(truth: DataFrame, predicted: DataFrame, entity: str, target: str) -> DataFrame:
    """entity, tp, fp, fn from two tables of pairs; repeated pairs count once."""
    both = truth.select(entity, target, F.lit(1).alias("_t"), F.lit(0).alias("_p")).unionByName(predicted.select(entity, target, F.lit(0).alias("_t"), F.lit(1).alias("_p")))
    pair = both.groupBy(entity, target).agg(F.max("_t").alias("_t"), F.max("_p").alias("_p"))
    return pair.groupBy(entity).agg(F.sum(F.col("_t") * F.col("_p")).alias("tp"), F.sum((1 - F.col("_t")) * F.col("_p")).alias("fp"), F.sum(F.col("_t") * (1 - F.col("_p"))).alias("fn"))


def per_entity(population: DataFrame, counts: DataFrame, entity: str) -> DataFrame:
    """The population with tp, fp, fn (0 where no pair speaks of it) and f05. An entity that is in the population twice is an error when rows are read."""
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("tp", "fp", "fn")}
    kept = [F.first(c, ignorenulls=False).alias(c) for c in population.columns if c != entity]
    once = population.groupBy(entity).agg(F.count("*").alias("_rows"), *kept)  # by the entity, as the join is, so nothing more is shuffled
    said = F.concat(F.lit("an entity is in the population twice: "), F.col(entity).cast("string"))
    checked = once.withColumn("_rows", F.when(F.col("_rows") == 1, 1).otherwise(F.raise_error(said))).filter("_rows = 1").drop("_rows")
    return checked.join(counts, entity, "left").withColumns(zero).withColumn("f05", f_half(F.col("tp"), F.col("fp"), F.col("fn"))).select(*population.columns, "tp", "fp", "fn", "f05")


def _share(part: Column, whole: Column) -> Column:
    """A rate that is null where nothing could have it."""
    return F.when(whole > 0, part / whole)


def macro_columns() -> dict[str, Column]:
    single, said = F.col("tp") + F.col("fn") == 0, F.col("tp") + F.col("fp") > 0
    singles, others = F.count_if(single), F.count_if(~single)
    return {
        "entities": F.count("*"), "macro_f05": F.avg("f05"), "singleton_fraction": _share(singles, F.count("*")),
        "false_singleton_count": F.count_if(single & said), "false_singleton_rate": _share(F.count_if(single & said), singles), "missed_non_singleton_rate": _share(F.count_if(~single & ~said), others),
        "nonempty_predictions": F.count_if(said), "exact_set_accuracy": F.avg((F.col("fp") + F.col("fn") == 0).cast("double")),
        "micro_precision": _share(F.sum("tp"), F.sum("tp") + F.sum("fp")), "micro_recall": _share(F.sum("tp"), F.sum("tp") + F.sum("fn")),
    }


def macro(scored: DataFrame, segment: str | None = None) -> DataFrame:
    """One row over all, or with ``segment`` one for each segment and, with ``is_total`` 1, one over all."""
    columns = [c.alias(n) for n, c in macro_columns().items()]
    if segment is None:
        return scored.agg(*columns)
    return scored.groupingSets([[F.col(segment)], []], F.col(segment)).agg(F.grouping(segment).cast("long").alias("is_total"), *columns)


def checked_population(population: DataFrame, entity: str) -> DataFrame:
    """The population; an empty one and repeated ids are errors."""
    n, distinct = population.agg(F.count("*"), F.countDistinct(entity)).first()
    if not n or n != distinct:
        raise ValueError("the population is empty" if not n else "an entity is in the population twice")
    return population


def sweep(population: DataFrame, truth: DataFrame, scored_pairs: DataFrame, entity: str, target: str, score: str, thresholds: list[float]) -> DataFrame:
    """threshold, macro_f05: predictions are the pairs with at least that score.

    Only entities with a prediction at a threshold make a row for it; all others score 1 if they have no truth and 0 if they do, which
    the sizes of the population and of its truth tell. So no table of all entities at all thresholds arises.
    """
    sizes = population.join(truth.select(entity, target).distinct().groupBy(entity).agg(F.count("*").alias("_size")), entity, "left").select(entity, F.coalesce("_size", F.lit(0)).alias("_size"))
    best = scored_pairs.groupBy(entity, target).agg(F.max(score).alias("_s"))
    known = truth.select(entity, target).distinct().withColumn("_t", F.lit(1))
    grid = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("_s"))
    said = best.join(known, [entity, target], "left").select(entity, F.coalesce("_t", F.lit(0)).alias("_t"), F.explode(grid).alias("threshold"))
    counted = said.groupBy(entity, "threshold").agg(F.sum("_t").alias("_tp"), F.count("*").alias("_n")).join(sizes, entity)
    f = f_half(F.col("_tp"), F.col("_n") - F.col("_tp"), F.col("_size") - F.col("_tp"))
    at = counted.groupBy("threshold").agg(F.sum(f).alias("_sum"), F.count_if(F.col("_size") == 0).alias("_spoken"))
    whole = sizes.agg(F.count("*").alias("_entities"), F.count_if(F.col("_size") == 0).alias("_single"))
    every = population.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    got = every.join(at, "threshold", "left").crossJoin(F.broadcast(whole))  # one row
    return got.select("threshold", ((F.coalesce("_sum", F.lit(0.0)) + F.col("_single") - F.coalesce("_spoken", F.lit(0))) / F.col("_entities")).alias("macro_f05"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The best threshold; of equally good ones (to 12 places) the highest."""
    top = F.max(F.struct(F.round("macro_f05", 12).alias("macro_f05"), F.round("threshold", 4).alias("threshold"))).alias("b")
    return swept.agg(top).select("b.threshold", "b.macro_f05")


def at_least(pairs: DataFrame, score: str, threshold: float) -> DataFrame:
    return pairs.filter(F.col(score) >= threshold)


def ranked(pairs: DataFrame, group: list[str] | str, score: str, tie: str, name: str = "rank", most: int | None = None, start: int = 0) -> DataFrame:
    """Rank within each group by score, highest first, ties by ``tie``; with ``most`` only so many stay (Catalyst cuts before the shuffle, too)."""
    groups = [group] if isinstance(group, str) else group
    got = pairs.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(score), tie)))
    if most is not None:
        got = got.filter(F.col(name) <= most)
    return got.withColumn(name, (F.col(name) - 1 + start).cast("long"))


def assign(pairs: DataFrame, pool: str, entity: str, score: str, rank: str, threshold: float) -> DataFrame:
    """At most one entity for each pool record: the one of the highest score (ties: the lower rank, then the lesser id), if it reaches the threshold.

    An aggregation, not a window: a pool record's candidates are reduced before they are shuffled.
    """
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(rank).alias("r"), F.col(entity).alias("e"))).alias("_b")
    return pairs.groupBy(pool).agg(best).select(pool, F.col("_b.e").alias(entity), (-F.col("_b.s")).alias(score)).filter(F.col(score) >= threshold)


def recall_at(pairs: DataFrame, truth: DataFrame, pool: str, entity: str, rank: str, ks=(1, 2, 3, 5, 10)) -> DataFrame:
    """k, recall over the pool records that have a true owner: its rank is under k."""
    found = truth.join(pairs.select(pool, entity, rank), [pool, entity], "left").groupBy(pool).agg(F.min(rank).alias("_r"))
    got = found.agg(F.count("*").alias("_n"), *(F.count_if(F.col("_r") < k).alias(f"k{k}") for k in ks))
    pairs_of = ", ".join(f"{k}L, k{k}" for k in ks)
    return got.select("_n", F.expr(f"stack({len(ks)}, {pairs_of}) as (k, hits)")).select("k", "hits", (F.col("hits") / F.col("_n")).alias("recall"))


def retrieval_report(population: DataFrame, truth: DataFrame, candidates: DataFrame, entity: str, target: str, segment: str, pool_rows: int) -> DataFrame:
    """Recall of candidates, for each segment and over all: macro (over entities with truth), micro, the score of a perfect classifier, list sizes, reduction."""
    counts = set_counts(truth, candidates, entity, target)
    rows = per_entity(population, counts, entity).withColumns({
        "_n": F.col("tp") + F.col("fn"), "_c": F.col("tp") + F.col("fp"), "_recall": _share(F.col("tp"), F.col("tp") + F.col("fn")), "_oracle": f_half(F.col("tp"), F.lit(0), F.col("fn")),
    })
    matched = F.col("_n") > 0
    return rows.groupingSets([[F.col(segment)], []], F.col(segment)).agg(
        F.grouping(segment).cast("long").alias("is_total"), F.count("*").alias("entities"), F.avg("_recall").alias("macro_recall"), _share(F.sum("tp"), F.sum("_n")).alias("micro_recall"), F.avg("_oracle").alias("oracle_f05"),
        F.avg("_c").alias("mean_candidates"), F.count_if(matched & (F.col("tp") == F.col("_n"))).alias("fully_recalled"), F.count_if(matched & (F.col("tp") == 0)).alias("zero_recalled"),
        (1 - F.sum("_c") / (F.count("*") * F.lit(pool_rows))).alias("reduction_ratio"),
    )


def route_recall(truth: DataFrame, routed: DataFrame, entity: str, target: str, route: str) -> DataFrame:
    """route, macro_recall over entities with truth: what each route finds by itself."""
    sizes = truth.select(entity, target).distinct().groupBy(entity).agg(F.count("*").alias("_n"))
    hits = routed.select(entity, target, route).distinct().join(truth.select(entity, target).distinct(), [entity, target]).groupBy(entity, route).agg(F.count("*").alias("_h"))
    per = hits.join(sizes, entity).groupBy(route).agg(F.sum(F.col("_h") / F.col("_n")).alias("_sum"))
    return per.crossJoin(F.broadcast(sizes.agg(F.count("*").alias("_entities")))).select(route, (F.col("_sum") / F.col("_entities")).alias("macro_recall"))


def budget_diagnostics(truth: DataFrame, routed: DataFrame, entity: str, target: str, rank: str, budgets=(5, 10, 20, 50), start: int = 1) -> DataFrame:
    """budget, candidates, hits, micro_recall: pairs that some route ranks within the budget."""
    best = routed.groupBy(entity, target).agg(F.min(F.col(rank) + (1 - start)).alias("_r"))
    marked = best.join(truth.select(entity, target).distinct().withColumn("_t", F.lit(1)), [entity, target], "left")
    grid = F.filter(F.array(*(F.lit(b).cast("long") for b in budgets)), lambda b: b >= F.col("_r"))
    total = F.broadcast(truth.select(entity, target).distinct().agg(F.count("*").alias("_all")))
    got = marked.select(F.explode(grid).alias("budget"), F.coalesce("_t", F.lit(0)).alias("_t")).groupBy("budget").agg(F.count("*").alias("candidates"), F.sum("_t").alias("hits"))
    return got.crossJoin(total).select("budget", "candidates", "hits", (F.col("hits") / F.col("_all")).alias("micro_recall"))


def missed_pairs(truth: DataFrame, candidates: DataFrame, entity: str, target: str) -> DataFrame:
    return truth.select(entity, target).distinct().join(candidates.select(entity, target), [entity, target], "left_anti")


def error_kinds(candidates: DataFrame, assigned: DataFrame, truth: DataFrame, pool: str, entity: str) -> DataFrame:
    """kind, n over pool records: what became of each true owner, and of each assignment without one."""
    a = assigned.select(pool, F.col(entity).alias("_a"))
    t = truth.select(pool, F.col(entity).alias("_t"))
    known = candidates.select(pool, F.col(entity).alias("_c"), F.lit(True).alias("_in"))
    rows = t.join(known.withColumnRenamed("_c", "_t"), [pool, "_t"], "left").join(a, pool, "full")
    kind = (
        F.when(F.col("_t").isNull(), "false_distractor").when(F.col("_t") == F.col("_a"), "correct").when(F.col("_a").isNotNull(), "wrong_entity")
        .when(F.col("_in").isNull(), "missing_candidate").otherwise("below_threshold")
    )
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def source_recall(truth: DataFrame, candidates: DataFrame, entity: str, target: str, source: Column) -> DataFrame:
    """source, entities, macro_recall: for each source of targets, over the entities with a true target in it."""
    t = truth.select(entity, target).distinct().withColumn("source", source)
    hit = t.join(candidates.select(entity, target).distinct().withColumn("_h", F.lit(1)), [entity, target], "left")
    per = hit.groupBy("source", entity).agg((F.count("_h") / F.count("*")).alias("_r"))
    return per.groupBy("source").agg(F.count("*").alias("entities"), F.avg("_r").alias("macro_recall"))


def entity_recall(population: DataFrame, truth: DataFrame, candidates: DataFrame, entity: str, target: str) -> DataFrame:
    """entity, n_true, n_found, n_candidates, recall (null without truth) for every entity of the population."""
    rows = per_entity(population.select(entity), set_counts(truth, candidates, entity, target), entity)
    n = F.col("tp") + F.col("fn")
    return rows.select(entity, n.alias("n_true"), F.col("tp").alias("n_found"), (F.col("tp") + F.col("fp")).alias("n_candidates"), _share(F.col("tp"), n).alias("recall"))


def checked_report(report: DataFrame, again: DataFrame, on: list[str], figures: list[str], tolerance: float = 1e-12) -> DataFrame:
    """The report, if figures computed in another way agree: each within the tolerance, or null in both. Any other row is an error when it is read."""
    other = again.select(*(F.col(c).alias(f"_{c}") for c in (*on, *figures)), F.lit(True).alias("_there"))
    joined = report.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on], "left") if on else report.crossJoin(F.broadcast(other))  # one row each
    same = reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.col(c).isNull() & F.col(f"_{c}").isNull()) for c in figures], F.col("_there").isNotNull())
    checked = F.when(same, F.col(figures[0])).otherwise(F.raise_error(F.lit("a report differs from its check")))
    return joined.withColumn(figures[0], checked).select(*report.columns)


def used_entities(pairs: DataFrame, entity: str) -> DataFrame:
    """entities: how many different ones the pairs have."""
    return pairs.agg(F.countDistinct(entity).alias("entities"))
