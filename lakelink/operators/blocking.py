"""Candidate generation: frequencies, weights, similarity joins and retrieval routes, all set at a time.

Postings are tables (id, term, ...). Frequency caps are applied before any join on terms, as the size of
such a join is the sum of the products of frequencies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def postings(records: DataFrame, key: list[str], tokens: Column, name: str = "term") -> DataFrame:
    """key columns, term, tf: one row for each distinct term of a record."""
    return records.select(*key, F.explode(tokens).alias(name)).groupBy(*key, name).agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame, *by: str) -> DataFrame:
    return post.groupBy(*by, "term").agg(F.count("*").alias("df"))


def smooth_idf(df: Column, n: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def idf_table(post: DataFrame, records: DataFrame) -> DataFrame:
    """term, df, idf over the given (training) records. A term that is not here weighs ln(n + 1) + 1."""
    n = F.broadcast(records.agg(F.count("*").alias("_n")))  # one row
    return document_frequency(post).crossJoin(n).select("term", "df", smooth_idf(F.col("df"), F.col("_n")).alias("idf"))


def rare_terms(post: DataFrame, records: DataFrame, share: float = 0.001, least: int = 2, least_length: int = 3) -> DataFrame:
    """Terms of some length in at least ``least`` records and at most that share of them (two at least)."""
    n = F.broadcast(records.agg(F.greatest(F.lit(2), F.floor(F.count("*") * share)).alias("_most")))
    got = document_frequency(post).filter((F.length("term") >= least_length) & (F.col("df") >= least)).crossJoin(n)
    return got.filter(F.col("df") <= F.col("_most")).select("term", "df")


def tfidf(post: DataFrame, by: str, key: str, max_df: int) -> DataFrame:
    """by, key, term, w: sublinear tf x smooth idf, normalised; frequencies and record counts within each ``by``. Terms over ``max_df`` are out."""
    n = post.select(by, key).distinct().groupBy(by).agg(F.count("*").alias("_n"))
    df = document_frequency(post, by).filter(F.col("df") <= max_df).join(n, by)
    weighed = post.join(df, [by, "term"]).select(by, key, "term", ((1 + F.log("tf")) * smooth_idf(F.col("df"), F.col("_n"))).alias("_w"))
    norm = weighed.groupBy(by, key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return weighed.join(norm, [by, key]).select(by, key, "term", (F.col("_w") / F.col("_norm")).alias("w"))


def similarity_top_k(queries: DataFrame, targets: DataFrame, by: str, query: str, target: str, k: int = 10, least: float = 0.01) -> DataFrame:
    """query, target, score, rank (from 0): the k most similar targets above ``least``; ties by target.

    Scores are rounded to 9 places before ranking, so that the order of summing can't decide.
    """
    joined = queries.select(by, F.col(query), "term", F.col("w").alias("_q")).join(targets.select(by, F.col(target), "term", F.col("w").alias("_t")), [by, "term"])
    score = joined.groupBy(query, target).agg(F.round(F.sum(F.col("_q") * F.col("_t")), 9).alias("score")).filter(F.col("score") > least)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), target))
    return score.withColumn("rank", place).filter(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("long"))


def anchors(query_terms: DataFrame, pool_df: DataFrame, key: str, most: int) -> DataFrame:
    """key, term, df, place: each query's rarest terms in the pool (by df, then term); terms the pool lacks are out."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("df", "term"))
    return query_terms.select(key, "term").distinct().join(pool_df, "term").withColumn("place", place).filter(F.col("place") <= most)


def quota(post: DataFrame, record: str, most: int) -> DataFrame:
    """The first ``most`` records of each term, in the order of their ids."""
    return post.select("term", record).distinct().withColumn("_p", F.row_number().over(Window.partitionBy("term").orderBy(record))).filter(F.col("_p") <= most).drop("_p")


def conjunctions(anchor: DataFrame, post: DataFrame, key: str, record: str, most: int, offsets=(0, 2, 4)) -> DataFrame:
    """key, record for records that hold both anchors at places o + 1 and o + 2; capped for each pair of anchors."""
    first = anchor.filter(F.col("place").isin([o + 1 for o in offsets])).select(key, F.col("place").alias("_o"), F.col("term").alias("_a"))
    second = anchor.filter(F.col("place").isin([o + 2 for o in offsets])).select(key, (F.col("place") - 1).alias("_o"), F.col("term").alias("_b"))
    a, b = (post.select(F.col("term").alias(n), F.col(record)).distinct() for n in ("_a", "_b"))
    hits = first.join(second, [key, "_o"]).join(a, "_a").join(b, ["_b", record])
    return hits.withColumn("_p", F.row_number().over(Window.partitionBy(key, "_o").orderBy(record))).filter(F.col("_p") <= most).select(key, record)


def shortlist(anchor: DataFrame, post: DataFrame, key: str, record: str, per_anchor: int, most: int) -> DataFrame:
    """key, record, hits: records with most anchor hits (a pair of neighbouring anchors is one more), ties by id."""
    single = anchor.select(key, "term").join(quota(post, record, per_anchor), "term").select(key, record)
    counted = single.unionByName(conjunctions(anchor, post, key, record, per_anchor)).groupBy(key, record).agg(F.count("*").alias("hits"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("hits"), record))
    return counted.withColumn("_p", place).filter(F.col("_p") <= most).drop("_p")


def rare_route(query_terms: DataFrame, pool_post: DataFrame, key: str, record: str, max_df: int, most_terms: int) -> DataFrame:
    """Records that share one of a query's rarest words of two letters and more; a word that only one record has counts."""
    df = document_frequency(pool_post.select("term", record).distinct()).filter((F.col("df") <= max_df) & (F.length("term") >= 2))
    return anchors(query_terms, df, key, most_terms).select(key, "term").join(pool_post.select("term", record).distinct(), "term").select(key, record).distinct()


def component_route(query_parts: DataFrame, pool_parts: DataFrame, key: str, record: str, most: int) -> DataFrame:
    """Records with an equal component (such as a postcode), at most so many for each query and component."""
    hits = query_parts.select(key, "term").distinct().join(pool_parts.select("term", record).distinct(), "term")
    return hits.withColumn("_p", F.row_number().over(Window.partitionBy(key, "term").orderBy(record))).filter(F.col("_p") <= most).select(key, record).distinct()


def route_union(routed: DataFrame, key: str, record: str, route: str, score: str, budget: int, always=("rare", "components")) -> DataFrame:
    """key, record, routes, best_score, metadata: each route's best candidates within its budget, merged by pair.

    Candidates without any similarity stay only where the route itself is the evidence.
    """
    kept = routed.filter((F.col(score) > 0) | F.col(route).isin(*always))
    place = F.row_number().over(Window.partitionBy(key, route).orderBy(F.desc(score), record))
    top = kept.withColumn("_p", place).filter(F.col("_p") <= budget)
    entry = F.struct(F.col(route), F.struct(F.col("_p").alias("rank"), F.col(score).alias("score")))
    merged = top.groupBy(key, record).agg(F.max(score).alias("best_score"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("metadata"))
    return merged.withColumn("routes", F.array_join(F.sort_array(F.map_keys("metadata")), ","))


def gram_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str, record: str, idf: DataFrame, train: DataFrame) -> DataFrame:
    """pairs with ``score``: cosine of counts x idf over the grams of both sides; ``left`` and ``right`` are postings with tf. Grams without an idf weigh ln(n + 1) + 1, of n training records."""
    unseen = F.broadcast(train.agg((F.log(F.count("*") + 1) + 1).alias("_unseen")))  # one row

    def vectors(post: DataFrame, of: str) -> DataFrame:
        w = post.join(idf.select("term", "idf"), "term", "left").crossJoin(unseen).select(of, "term", (F.col("tf") * F.coalesce("idf", "_unseen")).alias("w"))
        norm = w.groupBy(of).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
        return w.join(norm, of).select(of, "term", (F.col("w") / F.col("_n")).alias("w"))

    a, b = vectors(left, key).withColumnRenamed("w", "_a"), vectors(right, record).withColumnRenamed("w", "_b")
    dot = pairs.select(key, record).distinct().join(a, key).join(b, [record, "term"]).groupBy(key, record).agg(F.sum(F.col("_a") * F.col("_b")).alias("_d"))
    return pairs.join(dot, [key, record], "left").withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("_d", F.lit(0.0)))), 9)).drop("_d")


def for_all(scored: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, key: str, record: str, most: int = 1000) -> DataFrame:
    """key, record and the other columns of ``scored`` (a, b, ...) for all keys of an ``a`` with all records of a ``b``; ids move in lists of about ``most``, pairs only as they are returned."""
    from .features import spread

    def lists(side: DataFrame, k: str, of: str) -> DataFrame:
        part = F.pmod(F.xxhash64(of), F.ceil(F.col("_c") / most))
        return side.join(side.groupBy(k).agg(F.count("*").alias("_c")), k).groupBy(k, part.alias("_p")).agg(F.collect_list(of).alias(of)).drop("_p")

    rest = [c for c in scored.columns if c not in (a, b)]
    met = spread(scored.join(lists(left, a, key), a).join(lists(right, b, record), b).select(key, record, *rest))
    return met.withColumn(key, F.explode(key)).withColumn(record, F.explode(record))


@dataclass(frozen=True)
class Limits:
    """What a retrieval keeps: rarest terms of a query, records of a term, records of a query and route before and after scoring, and the frequencies up to which words count."""

    anchors: int = 8
    postings: int = 96
    shortlist: int = 96
    rare_max_df: int = 100
    component_max_df: int = 5000
    budget: int = 20


FIELDS = ("name", "addr")


def retrieve(queries: DataFrame, pool: DataFrame, train: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """query, record, best_score, metadata, routes: the candidates of all five routes, each route's best within the budget. Both sides have id, name, addr and the arrays houses and postals.

    ``name`` and ``address``: the shortlist of the field's rarest trigrams. ``combined``: both shortlists and the records that a pair of anchors, one of each
    field, finds. ``rare``: a common rare word of either field. ``components``: an equal postcode, or an equal house number and one of a field's two rarest words.
    The score is the cosine of the name's grams for ``name``, of the address's for ``address``, of both fields' together for the others; 0 without any gram in common.
    """
    from .retrieval import scored_routes

    return route_union(scored_routes(queries, pool, train, limits), "query", "record", "route", "score", limits.budget)
