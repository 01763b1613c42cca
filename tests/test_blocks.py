"""The similarity join block by block: against brute force, and what it shuffles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelink.functions import text
from lakelink.operators import blocking, blocks, features
from lakelink.plans.queries import QUERIES


def shuffled(spark, run) -> int:
    """Rows that all stages of ``run`` wrote for shuffles."""

    def total() -> int:
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def brute(rows, max_df, k, least, n_all):
    """pool, entity, score, rank, beside by the definition; rows (group, query, id, terms)."""
    rows = [(g, q, i, set(t)) for g, q, i, t in rows if g is not None and t]
    idf = lambda n, df: math.log((n + 1) / (df + 1)) + 1
    out = []
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        df, all_df = {}, {}
        for r, counts in ((r, c) for rs, c in ((mine, df), (rows, all_df)) for r in rs):
            for t in r[3]:
                counts[t] = counts.get(t, 0) + 1
        w = {t: idf(len(mine), n) ** 2 for t, n in df.items() if n <= max_df}
        v = {t: idf(n_all, n) ** 2 for t, n in all_df.items()}
        cosine = lambda x, y, w: sum(w.get(t, 0) for t in x & y) / max(1e-6, math.sqrt(sum(w.get(t, 0) for t in x)) * math.sqrt(sum(w.get(t, 0) for t in y)))
        for _, _, i, x in (r for r in mine if r[1]):
            got = sorted(((round(cosine(x, y, w), 9), j, cosine(x, y, v)) for _, q, j, y in mine if not q), key=lambda s: (-s[0], s[1]))
            out += [(i, j, s, rank, round(b, 6)) for rank, (s, j, b) in enumerate(got[:k]) if s > least]
    return sorted(out)


@pytest.mark.parametrize("postings", (1 << 20, 40))
def test_blocks_give_what_all_pairs_give(spark, postings):
    """Ties, copies, empty and null records and groups, terms over the limit; in one block and in many."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "", "é/x"]), rng.random() < 0.4, i, [f"t{int(rng.random() ** 2 * 60)}" for _ in range(rng.randint(0, 12))]) for i in range(300)]
    rows += [("a", i % 2 == 0, 1000 + i, ["same", "words", "t1"]) for i in range(60)] + [(None, True, 2000, ["same"]), ("c", True, 2001, ["same"])]
    got = blocks.similar_top_k(spark.createDataFrame(rows, "g string, q boolean, i long, t array<string>").repartition(3), "g", F.col("q"), "i", F.array_distinct("t"), 70, 4, 0.05, len(rows), postings)
    got = sorted((r["query"], r.target, round(r.score, 9), r["rank"], round(r.beside, 6)) for r in got.collect())
    want = brute(rows, 70, 4, 0.05, len(rows))
    assert len(got) == len(want) and [g[:2] + g[3:4] for g in got] == [w[:2] + w[3:4] for w in want]
    assert all(a[2] == pytest.approx(b[2], abs=2e-9) and a[4] == pytest.approx(b[4], abs=2e-6) for a, b in zip(got, want))


def test_repeated_keys_and_nothing(spark):
    rows = [("a", True, "x", ["p", "q"]), ("a", True, "x", ["q", "r"]), ("a", False, "y", ["p", "r"])]
    frame = spark.createDataFrame(rows, "g string, q boolean, i string, t array<string>")
    got = blocks.similar_top_k(frame, "g", F.col("q"), "i", F.col("t"), 10).collect()
    p, one = 1, math.log(3 / 2) + 1
    assert [(r["query"], r.target, r["rank"]) for r in got] == [("x", "y", 0)] and got[0].score == pytest.approx(2 * p / math.sqrt((2 * p + one**2) * 2 * p), abs=1e-9)
    assert blocks.similar_top_k(frame.limit(0), "g", F.col("q"), "i", F.col("t"), 10).collect() == []


def test_rounds_and_their_disk(spark, monkeypatch):
    """1,000 queries meet some 25 blocks of targets in rounds: the rows are those of one block, and no shuffle stays on disk (45 files before)."""
    monkeypatch.setattr(blocks, "FIRST_ROUND", 2, raising=False)
    rng, disk = random.Random(5), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    rows = [("a", i % 4 == 0, i, [f"t{int(rng.random() ** 2 * 300)}" for _ in range(12)]) for i in range(4000)]
    frame = spark.createDataFrame(rows, "g string, q boolean, i long, t array<string>").repartition(3)

    def files() -> set[str]:
        every = disk.getAllFiles()
        return {f for f in (every.apply(i).getName() for i in range(every.size())) if f.startswith("shuffle_")}

    def run(postings: int) -> list:
        made = blocks.similar_top_k(frame, "g", F.col("q"), "i", F.array_distinct("t"), 3000, 10, postings=postings)
        return sorted(map(tuple, made.collect()))

    whole, before = run(1 << 20), files()
    assert run(600) == whole and len(whole) == 10_000
    assert len(files() - before) < 20


def test_bar_of_a_query():
    """Of three targets with scores 1, 0.8 and 0.6 the bar lets those through that are at it or over it."""
    def side(lists, norm):
        of = [i for i, ts in enumerate(lists) for _ in ts]
        at = [t for ts in lists for t in ts]
        arrays = {"terms": [7], "at": at, "ends": np.cumsum([len(x) for x in lists]), "weight": [1.0], "norm": norm, "other": [], "other_norm": [], "of": of, "stop": [len(of)]}
        return blocks._Side({c: np.array(arrays[c], kind).tobytes() for c, kind in blocks._ARRAYS.items()}, None)

    q, t = side([[0]], [1.0]), side([[0], [0], [0]], [1.0, 1.25, 1 / 0.6])
    found = lambda bar: [(p.tolist(), s.tolist()) for _, p, s, _ in blocks._best(q, t, 10, 0.01, False, np.array([bar]))]
    assert found(-np.inf) == [([0, 1, 2], [1.0, 0.8, 0.6])]
    assert found(0.8) == [([0, 1], [1.0, 0.8])]
    assert found(1.1) == []


@pytest.mark.parametrize("name", ("tfidf_topk", "weighted_cosine_pairs", "numeric_overlap_features"))
def test_no_pair_is_shuffled(spark, sf, name):
    """The candidates of sf0.001's texts are some 200,000 products; only blocks and each query's best move."""
    assert shuffled(spark, lambda: QUERIES[name](spark, sf).collect()) < 20_000


def test_retrieval_of_copies_moves_no_pairs(spark):
    """Queries and records of one name: all records hold every pair of anchors, which each query would shuffle 3 x 300 times, and its candidates' grams after that."""
    side = lambda p, first: spark.createDataFrame([(f"{p}{i:03d}", "acme trading house", f"lane {first + i}", ["7"], ["12345"]) for i in range(300)], "id string, name string, addr string, houses array<string>, postals array<string>")
    q, pool, got = side("q", 0), side("r", 150), []
    assert shuffled(spark, lambda: got.extend(blocking.retrieve(q, pool, q).collect())) < 150_000
    best = {r["query"]: [x.record for x in got if x["query"] == r["query"] and "name" in x.metadata] for r in got}
    assert set(map(len, best.values())) == {20} and sorted(best["q000"]) == [f"r{i:03d}" for i in range(20)]


def test_pages_of_one_host_are_scored_once(spark, tmp_path):
    """300 pages ask for 300 of the same host: 90,000 rows, of which none is shuffled."""
    spark.createDataFrame([(i, f"{'http' if i % 2 else 'https'}://shop.example/en/{i}") for i in range(600)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = []
    assert shuffled(spark, lambda: got.append(QUERIES["gram_cosine_rerank"](spark, str(tmp_path)).agg(F.count("*"), F.min("score"), F.max("score")).first())) < 60_000
    assert tuple(got[0]) == (90_000, 1.0, 1.0)


def test_rare_words_move_without_records(spark):
    """400 pairs of records with five words each: the pairs move twice, their words once for each two names."""
    record = lambda k: text.normalized_record(F.lit("acme trading house of north"), F.concat(F.lit(k), F.col("id").cast("string")))
    none = F.create_map().cast("map<string,struct<rank:int,score:double>>")
    pairs = spark.range(400).select("id", record("lane ").alias("s1"), record("road ").alias("cand"), F.lit(0.5).alias("best_score"), none.alias("metadata"), F.lit(2).alias("source"))
    rare, got = spark.createDataFrame([("acme",), ("north",)], "term string"), []
    assert shuffled(spark, lambda: got.extend(features.staged_features(pairs, rare).select("rare_count", "rare_frac_s1").collect())) < 1500
    assert len(got) == 400 and {tuple(r) for r in got} == {(2.0, 1.0)}
