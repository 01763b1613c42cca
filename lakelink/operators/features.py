"""Features of candidate pairs: context of a pair among all pairs, and similarities of its two records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T

ROUTES = ("name", "address", "combined", "rare", "components")


def context(pairs: DataFrame, pool: str, entity: str, score: str = "score", rank: str = "rank") -> DataFrame:
    """Context over ALL candidate pairs (select afterwards): gaps to the pool record's best, list sizes, and the entity's view.

    Two shuffles: all windows of a pool record share one, all of an entity the other.
    """
    p, e = Window.partitionBy(pool), Window.partitionBy(entity)
    at = lambda k: F.coalesce(F.max(F.when(F.col(rank) == k, F.col(score))).over(p), F.lit(0.0))
    first = F.col(rank) == 0
    got = pairs.withColumns({"gap_top1": at(0) - F.col(score), "margin12": at(0) - at(1), "ncand": F.count("*").over(p)})
    return got.withColumns({
        "s1_rank0_deg": F.sum(first.cast("long")).over(e), "s1_cand_deg": F.count("*").over(e), "s1_claim": F.coalesce(F.sum(F.when(first, F.col(score))).over(e), F.lit(0.0)),
        "s1_inrank": (F.row_number().over(e.orderBy(F.desc(score), pool, rank)) - 1).cast("long"), "s1_top_in_gap": F.max(score).over(e) - F.col(score),
    })


def relative(features: DataFrame, pool: str, columns: list[str]) -> DataFrame:
    """Each similarity less the best one among the pool record's candidates, as <name>_rel."""
    w = Window.partitionBy(pool)
    return features.withColumns({f"{c}_rel": F.col(c) - F.max(c).over(w) for c in columns})


def number_overlap(a: Column, b: Column) -> dict[str, Column]:
    """Features of the digit runs of two texts (p: pool side, s: entity side)."""
    p, s = T.digit_runs(a), T.digit_runs(b)
    both = F.size(F.array_intersect(p, s))
    return {
        "num_inter": both.cast("long"), "num_p": F.size(p).cast("long"), "num_s": F.size(s).cast("long"), "num_jac": both / F.greatest(F.size(p) + F.size(s) - both, F.lit(1)),
        "num_conflict": ((F.size(p) > 0) & (F.size(s) > 0) & (both == 0)).cast("long"), "num_p_subset": ((F.size(p) > 0) & (both == F.size(p))).cast("long"),
        "first_num_eq": F.coalesce(T.first_digits(a).cast("decimal(38,0)") == T.first_digits(b).cast("decimal(38,0)"), F.lit(False)).cast("long"),
    }


def token_overlap(prefix: str, a: Column, b: Column) -> dict[str, Column]:
    p, s = T.words(a), T.words(b)
    both = F.size(F.array_intersect(p, s))
    return {f"{prefix}_tok_inter": both, f"{prefix}_tok_cov_p": both / F.greatest(F.size(p), F.lit(1)), f"{prefix}_tok_cov_s": both / F.greatest(F.size(s), F.lit(1))}


def weighted_cosine(pairs: DataFrame, post: DataFrame, df: DataFrame, n: int, a: str, b: str, record: str, name: str) -> DataFrame:
    """Add the cosine of idf-weighted distinct terms of the records ``a`` and ``b``: one join on record, one on (record, term)."""
    from .blocking import smooth_idf

    squared = post.select(record, "term").distinct().join(df, "term").select(record, "term", F.pow(smooth_idf(F.col("df"), F.lit(n)), F.lit(2)).alias("_w"))
    norm = squared.groupBy(record).agg(F.sqrt(F.sum("_w")).alias("_norm"))
    left = squared.select(F.col(record).alias(a), "term", "_w")
    right = squared.select(F.col(record).alias(b), F.col("term"))
    shared = pairs.select(a, b).distinct().join(left, a).join(right, [b, "term"]).groupBy(a, b).agg(F.sum("_w").alias("_dot"))
    with_norms = shared.join(norm.select(F.col(record).alias(a), F.col("_norm").alias("_na")), a).join(norm.select(F.col(record).alias(b), F.col("_norm").alias("_nb")), b)
    value = with_norms.select(a, b, (F.col("_dot") / F.greatest(F.col("_na") * F.col("_nb"), F.lit(1e-6))).alias(name))
    return pairs.join(value, [a, b], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def spread(pairs: DataFrame) -> DataFrame:
    """Deal pairs out to all shuffle partitions: rows are small but costly to score, so merging partitions by size would leave a few tasks with all the work."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("float")


def _text_features(prefix: str, a: Column, b: Column, scores: Column) -> dict[str, Column]:
    both = (F.length(a) > 0) & (F.length(b) > 0)
    only = lambda c: F.when(both, c).otherwise(0.0)
    return {
        f"{prefix}_edit_ratio": scores["edit_ratio"], f"{prefix}_partial_ratio": scores["partial_ratio"], f"{prefix}_token_set_ratio": scores["token_set_ratio"],
        f"{prefix}_jaccard_tokens": only(S.jaccard(T.words(a), T.words(b))), f"{prefix}_jaccard_chars3": only(S.jaccard(F.array_distinct(T.trigrams(a, True)), F.array_distinct(T.trigrams(b, True)))),
        f"{prefix}_len_s1": S.log_length(a), f"{prefix}_len_cand": S.log_length(b), f"{prefix}_len_ratio": S.length_ratio(a, b),
        f"{prefix}_both_empty": _flag((a == "") & (b == "")), f"{prefix}_s1_empty": _flag(a == ""), f"{prefix}_cand_empty": _flag(b == ""),
    }


def _number_features(prefix: str, a: Column, b: Column, values: str, kind: str) -> dict[str, Column]:
    x, y = a[values], b[values]
    both = (F.size(x) > 0) & (F.size(y) > 0)
    agree = both & F.arrays_overlap(x, y)
    flag = lambda side, name: side[f"{kind}_{name}"].cast("float")
    return {
        f"{prefix}_both_present": _flag(both), f"{prefix}_agree": _flag(agree), f"{prefix}_conflict": _flag(both & ~agree), f"{prefix}_s1_missing": flag(a, "missing"), f"{prefix}_cand_missing": flag(b, "missing"),
        f"{prefix}_s1_ambiguous": flag(a, "ambiguous"), f"{prefix}_cand_ambiguous": flag(b, "ambiguous"),
    }


def staged_features(pairs: DataFrame, rare: DataFrame | None = None) -> DataFrame:
    """Pipeline A's 60 features for pairs with the structs ``s1`` and ``cand`` of normalised records, ``source``, ``best_score`` and ``metadata``.

    ``metadata`` maps a route to (rank, score). Rare words are a table (term); its overlap is found by array functions on
    a map-side set of the pair's own words, so only words that both sides have are joined.
    """
    a, b = F.col("s1"), F.col("cand")
    scored = spread(pairs).withColumns({"_name": S.staged_scores(a["name_normalized"], b["name_normalized"]), "_addr": S.staged_scores(a["address_normalized"], b["address_normalized"])})
    if rare is None:
        scored = scored.withColumns({c: F.lit(0.0) for c in ("rare_count", "rare_frac_s1", "rare_frac_cand", "rare_has")})
    else:
        x, y = T.words(a["name_normalized"]), T.words(b["name_normalized"])
        keyed = scored.withColumn("_pair", F.xxhash64(a["name_normalized"], b["name_normalized"]))
        names = keyed.select("_pair", x.alias("x"), y.alias("y")).distinct()  # copies ask once, and records stay where they are
        sides = F.transform(F.array_union("x", "y"), lambda w: F.struct(w.alias("term"), F.array_contains("x", w).cast("int").alias("a"), F.array_contains("y", w).cast("int").alias("b")))
        words = names.select("_pair", F.inline(sides)).join(rare.select("term"), "term", "left_semi")
        counts = words.groupBy("_pair").agg(F.sum(F.col("a") * F.col("b")).alias("_c"), F.sum("a").alias("_x"), F.sum("b").alias("_y"))
        share = lambda n: F.when(F.col(n) > 0, F.col("_c") / F.col(n)).otherwise(0.0)
        scored = keyed.join(counts, "_pair", "left").fillna(0, ["_c", "_x", "_y"]).withColumns({"rare_count": F.col("_c").cast("double"), "rare_frac_s1": share("_x"), "rare_frac_cand": share("_y"), "rare_has": (F.col("_c") > 0).cast("double")}).drop("_pair", "_c", "_x", "_y")
    made = _text_features("name", a["name_normalized"], b["name_normalized"], F.col("_name")) | _text_features("addr", a["address_normalized"], b["address_normalized"], F.col("_addr"))
    made |= _number_features("house", a, b, "house_numbers", "house_number") | _number_features("postal", a, b, "postal_codes", "postal_code")
    made |= {c: F.col(c) for c in ("rare_count", "rare_frac_s1", "rare_frac_cand", "rare_has")}
    meta = lambda r, f: F.col("metadata")[r][f]
    made |= {f"score_{r}": F.coalesce(meta(r, "score"), F.lit(0.0)) for r in ROUTES} | {f"invrank_{r}": F.coalesce(1 / (1 + meta(r, "rank")), F.lit(0.0)) for r in ROUTES}
    made |= {"n_routes_found": F.size(F.map_keys("metadata")), "best_retrieval_score": F.col("best_score"), "source_s2": _flag(F.col("source") == 2), "source_s3": _flag(F.col("source") == 3)}
    name, addr = made["name_edit_ratio"], made["addr_edit_ratio"]
    made |= {
        "name_high_addr_low": _flag((name > 0.85) & (addr < 0.5)), "name_low_addr_high": _flag((name < 0.5) & (addr > 0.85)), "both_high": _flag((name > 0.8) & (addr > 0.8)),
        "house_agree_name_high": _flag((made["house_agree"] > 0) & (name > 0.8)), "postal_agree_name_high": _flag((made["postal_agree"] > 0) & (name > 0.8)), "house_conflict_name_high": _flag((made["house_conflict"] > 0) & (name > 0.8)),
    }
    keep = [c for c in pairs.columns if c not in ("s1", "cand", "metadata", "best_score", "source")]
    return scored.select(*keep, *(c.cast("float").alias(n) for n, c in made.items()))


def with_records(pairs: DataFrame, entities: DataFrame, pool: DataFrame, entity: str, target: str) -> DataFrame:
    """pairs with the structs ``s1`` and ``cand``: null where a record is missing. Both sides are (id, record)."""
    a, b = entities.toDF(entity, "s1"), pool.toDF(target, "cand")
    return pairs.join(a, entity, "left").join(b, target, "left")


def missing_records(joined: DataFrame) -> DataFrame:
    """pairs, missing_entity, missing_candidate, kept: a pair without its entity's record counts there alone."""
    a, b = F.col("s1").isNull(), F.col("cand").isNull()
    return joined.agg(F.count("*").alias("pairs"), F.count_if(a).alias("missing_entity"), F.count_if(~a & b).alias("missing_candidate"), F.count_if(~a & ~b).alias("kept"))


def labelled_matrix(pairs: DataFrame, truth: DataFrame, entities: DataFrame, pool: DataFrame, entity: str, target: str, rare: DataFrame | None = None) -> DataFrame:
    """entity, target, label and the 60 features of every candidate pair whose two records exist; ``missing_records`` tells how many have none."""
    joined = with_records(pairs, entities, pool, entity, target).filter("s1 is not null and cand is not null")
    labelled = joined.join(truth.select(entity, target).distinct().withColumn("label", F.lit(1)), [entity, target], "left").fillna(0, ["label"])
    return staged_features(labelled, rare)


RELATIVE = ("n_tset", "a_tset", "num_jac", "n_concat", "n_ratio")


def pool_features(pairs: DataFrame, pool: str, entity: str) -> DataFrame:
    """Pipeline B's features for pairs with context columns, ``src``, and the texts p_name, p_addr, s_name, s_addr; a_wcos and n_wcos come from ``weighted_cosine``."""
    pn, sn, pa, sa = (F.col(c) for c in ("p_name", "s_name", "p_addr", "s_addr"))
    scored = spread(pairs).withColumns({"_n": S.pool_scores(pn, sn), "_a": S.pool_scores(pa, sa)})
    made = {f"n_{k}": F.col("_n")[k] for k in ("ratio", "tset", "tsort", "partial", "jw", "concat", "concat_partial")} | {f"a_{k}": F.col("_a")[k] for k in ("ratio", "tset", "tsort", "partial")}
    made |= number_overlap(pa, sa) | token_overlap("a", pa, sa) | {"a_len_p": F.size(T.words(pa)), "a_len_s": F.size(T.words(sa))}
    made |= token_overlap("n", pn, sn) | {"n_len_p": F.length(pn), "n_len_s": F.length(sn), "p_nonlatin": T.is_non_latin(pn).cast("int")}
    got = scored.withColumns(made).drop("_n", "_a", "p_name", "s_name", "p_addr", "s_addr")
    return relative(got, pool, list(RELATIVE))


def pair_statistics(pairs: DataFrame, label: str, features: list[str], split: str, edit: str | None = None) -> DataFrame:
    """For each split: pairs, positives, rate, hard negatives, and mean and population deviation of every feature."""
    hard = F.count_if((F.col(label) == 0) & (F.col(edit) > 0.8)) if edit else F.lit(0)
    stats = [x for f in features for x in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))]
    return pairs.groupBy(split).agg(F.count("*").alias("pairs"), F.sum(label).alias("positives"), F.avg(label).alias("rate"), hard.alias("hard_negatives"), *stats)
