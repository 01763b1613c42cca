"""The five-route retrieval without a shuffle of pairs: lists of records by key, candidates query by query, scores block by block.

What a route finds for a query depends on keys alone: a gram's first records, the first records that hold two grams, a word's, a postcode's. These lists are
made once for each distinct key and broadcast (up to a bound; joined beyond it), so a query's candidates are made in one row. Then blocks of queries with their
candidates meet blocks of records, each with its gram vectors, and leave each route's best.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.work import materialise, scratch, shared_dir
from . import blocking
from .blocks import _short_batches

#: Entries up to which lists (and weights) are broadcast; more are joined.
MOST_ENTRIES = 8 << 20
#: Queries and records in a block.
QUERY_ROWS, RECORD_ROWS = 1000, 16_000
KINDS = ("name", "address", "both")
KIND = {"name": "name", "address": "address", "combined": "both", "rare": "both", "components": "both"}
ALWAYS = ("rare", "components")


def _hinted(df: DataFrame, entries: Column, name: str) -> DataFrame:
    kept = materialise(df, name)
    return F.broadcast(kept) if (kept.agg(F.sum(entries)).first()[0] or 0) <= MOST_ENTRIES else kept


def _vectors(side: DataFrame, weights: DataFrame, n: DataFrame) -> DataFrame:
    """id, vectors: for each kind of grams their hashes and normalised weights; nothing but the records themselves is shuffled."""
    name, addr = T.trigrams(F.col("name")), T.trigrams(F.col("addr"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), g.alias("g")) for k, g in zip(KINDS, (name, addr, F.concat(F.coalesce(name, F.array().cast("array<string>")), F.coalesce(addr, F.array().cast("array<string>")))))))
    one = side.select("id", "name", "addr").repartition("id").select("id", F.explode(kinds).alias("_k")).select("id", "_k.kind", F.explode("_k.g").alias("term")).groupBy("id", "kind", "term").agg(F.count("*").alias("tf"))
    w = one.join(weights, ["kind", "term"], "left").crossJoin(n).select("id", "kind", F.xxhash64("term").alias("t"), (F.col("tf") * blocking.smooth_idf(F.coalesce("df", F.lit(0)), F.col("_n"))).alias("w"))
    return w.groupBy("id", "kind").agg(F.collect_list("t").alias("t"), F.collect_list("w").alias("w")).groupBy("id").agg(F.collect_list(F.struct("kind", "t", "w")).alias("vectors"))


def _lists(queries: DataFrame, pool: DataFrame, limits: blocking.Limits) -> DataFrame:
    """query, lists: the first records of every key that a query has, by kind of key."""
    post = lambda side, k, tokens: side.select(F.col("id").alias(k), F.explode(F.array_distinct(tokens)).alias("term")).distinct()
    grams = {(f, k): post(side, k, T.trigrams(F.col(f))) for f in blocking.FIELDS for k, side in (("query", queries), ("record", pool))}
    words = {(f, k): post(side, k, T.words(F.col(f))) for f in blocking.FIELDS for k, side in (("query", queries), ("record", pool))}
    parts = {(c, k): post(side, k, F.col(c)) for c in ("houses", "postals") for k, side in (("query", queries), ("record", pool))}
    keys, made = [], []
    most = limits.shortlist

    def whole(p: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
        """The wanted terms' records, in order."""
        got = p.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sort_array(F.collect_list("record")).alias("records"))
        return _hinted(got, F.size("records"), name)

    def single(kind: str, k: DataFrame, lists: DataFrame, first: int) -> None:
        keys.append(k.select("query", F.lit(kind).alias("kind"), F.col("term").alias("a"), F.lit("").alias("b")))
        made.append(lists.select(F.lit(kind).alias("kind"), F.col("term").alias("a"), F.lit("").alias("b"), F.slice("records", 1, first).alias("records")))

    def double(kind: str, k: DataFrame, left: DataFrame, right: DataFrame, first: int) -> None:
        """Keys (query, a, b): the first records that both lists hold, made once for each (a, b)."""
        keys.append(k.select("query", F.lit(kind).alias("kind"), "a", "b"))
        x, y = left.select(F.col("term").alias("a"), F.col("records").alias("x")), right.select(F.col("term").alias("b"), F.col("records").alias("y"))
        both = k.select("a", "b").distinct().join(x, "a").join(y, "b")
        made.append(both.select(F.lit(kind).alias("kind"), "a", "b", F.slice(F.sort_array(F.array_intersect("x", "y")), 1, first).alias("records")))

    anchor, lists = {}, {}
    for f in blocking.FIELDS:
        anchor[f] = materialise(blocking.anchors(grams[f, "query"], blocking.document_frequency(grams[f, "record"]), "query", limits.anchors), f"anchors-{f}")
        lists[f] = whole(grams[f, "record"], anchor[f], f"grams-{f}")
        single(f"{f}1", anchor[f], lists[f], limits.postings)
        first = anchor[f].filter(F.col("place").isin(1, 3, 5)).select("query", "place", F.col("term").alias("a"))
        second = anchor[f].select("query", (F.col("place") - 1).alias("place"), F.col("term").alias("b"))
        double(f"{f}2", first.join(second, ["query", "place"]), lists[f], lists[f], limits.postings)
    n, a = (anchor[f].filter("place <= 3").select("query", "place", F.col("term").alias(c)) for f, c in zip(blocking.FIELDS, "ab"))
    double("crossed", n.join(a, ["query", "place"]), lists["name"], lists["addr"], limits.postings)
    houses = None
    for f in blocking.FIELDS:
        df = blocking.document_frequency(words[f, "record"])
        rare = blocking.anchors(words[f, "query"], df.filter((F.col("df") <= limits.rare_max_df) & (F.length("term") >= 2)), "query", limits.anchors)
        single("rare", rare, whole(words[f, "record"], rare, f"rare-{f}").withColumn("term", F.concat(F.lit(f), "term")), most)
        keys[-1] = keys[-1].withColumn("a", F.concat(F.lit(f), "a"))
        gate = blocking.anchors(words[f, "query"], df.filter(F.col("df") <= limits.component_max_df), "query", 2)
        houses = houses if houses is not None else whole(parts["houses", "record"], parts["houses", "query"], "houses")
        gated = parts["houses", "query"].withColumnRenamed("term", "a").join(gate.select("query", F.col("term").alias("b")), "query")
        double(f"gated-{f}", gated, houses, whole(words[f, "record"], gate, f"gates-{f}"), most)
    single("postal", parts["postals", "query"], whole(parts["postals", "record"], parts["postals", "query"], "postals"), most)
    every = _hinted(reduce(DataFrame.unionByName, made).filter(F.size("records") > 0), F.size("records"), "lists")
    asked = reduce(DataFrame.unionByName, keys).repartition("query")
    return asked.join(every, ["kind", "a", "b"]).groupBy("query").agg(F.collect_list(F.struct("kind", "records")).alias("lists"))


def _csr(rows: list[list[dict]], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ends, hashes, weights of one kind of grams of all rows; weights normalised."""
    terms, weights, sizes = [], [], []
    for row in rows:
        t, w = next(((v["t"], v["w"]) for v in row or () if v["kind"] == kind), ((), ()))
        w = np.array(w, float)
        terms.append(np.array(t, np.int64))
        weights.append(w / np.sqrt((w * w).sum()) if len(w) else w)
        sizes.append(len(t))
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.concatenate(terms), np.concatenate(weights)


def _found(lists: list[dict], limits: blocking.Limits) -> dict[str, np.ndarray]:
    """Each route's records for one query, in the order of their ids."""
    held: dict = {}
    for x in lists:
        held.setdefault(x["kind"], []).append(np.array(x["records"]))
    of = lambda *kinds: [r for k in kinds for r in held.get(k, [])]
    union = lambda parts, most: np.unique(np.concatenate(parts))[:most] if parts else np.array([])

    def short(f: str) -> np.ndarray:
        parts = of(f"{f}1", f"{f}2")
        if not parts:
            return np.array([])
        ids, hits = np.unique(np.concatenate(parts), return_counts=True)
        return np.sort(ids[np.argsort(-hits, kind="stable")[: limits.shortlist]])

    most = limits.shortlist
    name, addr = short("name"), short("addr")
    got = {"name": name[:most], "address": addr[:most], "rare": union(of("rare"), most), "components": union(of("postal", "gated-name", "gated-addr"), most)}
    return got | {"combined": union([x for x in (name, addr, *of("crossed")) if len(x)], 3 * most)}


def _pack(most: int, limits: blocking.Limits | None):
    def blob(rows: list[dict]) -> pa.RecordBatch:
        ids = [r["id"] for r in rows]
        if limits is None:
            rows = [rows[i] for i in sorted(range(len(ids)), key=ids.__getitem__)]
        block: dict = {"ids": np.array([r["id"] for r in rows])}
        for k in KINDS:
            ends, terms, weights = _csr([r["vectors"] for r in rows], k)
            if limits is None:
                terms, at = np.unique(terms, return_inverse=True)
                block[k] = (ends, terms, at.astype(np.int32), weights)
            else:
                block[k] = (ends, terms, weights)
        if limits is not None:
            found = [_found(r["lists"], limits) for r in rows]
            for route in KIND:
                lists = [x[route] for x in found]
                block[f"{route}-ends"] = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                lists = [x for x in lists if len(x)]
                block[f"{route}-found"] = np.concatenate(lists) if lists else np.array([])
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], ["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                if len(rows) == most:
                    yield blob(rows)
                    rows = []
        if rows:
            yield blob(rows)

    return run


def _scores(q: dict, r: dict, budget: int) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """query's place, route, records' places, scores: each route's best of the block."""
    ids = r["ids"]
    marks = {k: np.zeros(len(r[k][1]) + 1) for k in KINDS}
    place = {}
    for k in KINDS:
        at = np.searchsorted(r[k][1], q[k][1])
        at[at == len(r[k][1])] = 0
        place[k] = np.where(r[k][1][at] == q[k][1], at, len(r[k][1])) if len(r[k][1]) else at
    for i in range(len(q["ids"])):
        for k in KINDS:
            a, b = q[k][0][i : i + 2]
            marks[k][place[k][a:b]] = q[k][2][a:b]
            marks[k][-1] = 0
        for route, k in KIND.items():
            a, b = q[f"{route}-ends"][i : i + 2]
            wanted = q[f"{route}-found"][a:b]
            if not len(wanted):
                continue
            at = np.searchsorted(ids, wanted)
            at[at == len(ids)] = 0
            at = at[ids[at] == wanted]
            if not len(at):
                continue
            begin, size = r[k][0][at], r[k][0][at + 1] - r[k][0][at]
            gather = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            dot = np.bincount(np.repeat(np.arange(len(at)), size), weights=marks[k][r[k][2][gather]] * r[k][3][gather], minlength=len(at))
            score = np.floor(np.clip(dot, 0, 1) * 1e9 + 0.5) / 1e9
            if route not in ALWAYS:
                at, score = at[score > 0], score[score > 0]
            top = np.lexsort((at, -score))[:budget]
            yield i, route, at[top], score[top]
        for k in KINDS:
            a, b = q[k][0][i : i + 2]
            marks[k][place[k][a:b]] = 0


def _meet(budget: int, query: pa.DataType, record: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("q").to_pylist(), batch.column("r").to_pylist()):
                q, r = pickle.loads(x), pickle.loads(y)
                got = [g for g in _scores(q, r, budget) if len(g[2])]
                if got:
                    sizes = [len(g[2]) for g in got]
                    a, b = q["ids"][np.repeat([g[0] for g in got], sizes)], r["ids"][np.concatenate([g[2] for g in got])]
                    routes = pa.array(np.repeat([g[1] for g in got], sizes).tolist(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), query), pa.array(b.tolist(), record), routes, pa.array(np.concatenate([g[3] for g in got]))], ["query", "record", "route", "score"])

    return run


def scored_routes(queries: DataFrame, pool: DataFrame, train: DataFrame, limits: blocking.Limits = blocking.Limits()) -> DataFrame:
    """query, record, route, score: what each of the five routes finds and keeps, as ``blocking.retrieve`` tells; more than the budget only where records are in several blocks. Grams are compared by 64-bit hashes."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = queries.sparkSession
    kinds = [side.schema["id"].dataType for side in (queries, pool)]
    with _short_batches(spark), scratch(spark):
        name, addr = T.trigrams(F.col("name")), T.trigrams(F.col("addr"))
        seen = train.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.array_distinct(g).alias("g")) for k, g in zip(KINDS, (name, addr, F.concat(name, addr)))))).alias("_k"))
        weights = _hinted(seen.select("_k.kind", F.explode("_k.g").alias("term")).groupBy("kind", "term").agg(F.count("*").alias("df")), F.lit(1), "gram-weights")
        n = F.broadcast(train.agg(F.count("*").alias("_n")))  # one row
        asked = _lists(queries, pool, limits).withColumnRenamed("query", "id").join(_vectors(queries, weights, n), "id", "left")
        q = materialise(asked.select("id", "vectors", "lists").mapInArrow(_pack(QUERY_ROWS, limits), "block binary"), "query-blocks", rows_a_file=1)
        held = pool.select("id").distinct().join(_vectors(pool, weights, n), "id", "left")
        r = materialise(held.mapInArrow(_pack(RECORD_ROWS, None), "block binary"), "record-blocks", rows_a_file=1)
        met = q.withColumnRenamed("block", "q").crossJoin(r.withColumnRenamed("block", "r")).mapInArrow(_meet(limits.budget, *map(to_arrow_type, kinds)), f"query {kinds[0].simpleString()}, record {kinds[1].simpleString()}, route string, score double")
        path = shared_dir(spark, "scored-routes")
        met.write.parquet(path)
    return spark.read.schema(met.schema).parquet(path)
