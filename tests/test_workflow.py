"""Prediction, decisions, resumable writing, streams and the small operators around them."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lakelink.functions import ids, text
from lakelink.operators import blocking, features, learning, prediction, scoring, splits
from lakelink.sources import archives, delimited, sinks
from lakelink.streaming import normalise

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_predict_and_check(spark, tmp_path):
    population = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "e string")
    pairs = spark.createDataFrame([("e1", "t1", 0.9), ("e1", "t2", 0.55), ("e1", "t3", None), ("e2", "t1", 0.1), ("e2", "t1", 0.1)], "e string, t string, s double")
    want = [("e1", "t1,t2", "t1,t2,t3"), ("e2", "", "t1"), ("e3", "", "")]
    assert rows(prediction.lists(population, pairs, "e", "t", "s")) == want
    truth = spark.createDataFrame([("e1", "t1")], "e string, t string")
    got = prediction.run(population, pairs, "e", "t", "s", 0.55, f"file://{tmp_path}/a", truth).first()
    assert got.threshold == 0.55 and got.macro_f05 == pytest.approx((5 / 9 + 1 + 1) / 3)
    assert prediction.run(population, pairs, "e", "t", "s", 0.55, f"file://{tmp_path}/b", truth.filter("e = 'x'")) is None
    assert rows(delimited.read_strict(spark, f"{tmp_path}/a/matches", ("e", "matched_entity_ids"))) == [w[:2] for w in want]
    with pytest.raises(ValueError, match="populations differ"):
        sinks.write_checked(population.union(population).withColumn("x", F.lit("")), f"file://{tmp_path}/c", population)
    assert prediction.lists(population.limit(0), pairs, "e", "t", "s").count() == 0


def test_a_repeated_entity_is_an_error(spark):
    twice = spark.createDataFrame([("a",), ("a",)], "e string")
    none = spark.createDataFrame([], "e string, t string")
    with pytest.raises(Exception, match="in the population twice"):
        scoring.macro(scoring.per_entity(twice, scoring.set_counts(none, none, "e", "t"), "e")).collect()


def test_decision(spark, tmp_path):
    made = [(f"e{i // 4}", f"t{i}", float(i % 4 == 0), (i % 4 == 0) + (i % 7) / 10, i % 9 == 0) for i in range(240)]
    pairs = spark.createDataFrame(made, "e string, t string, label double, x double, stop boolean")
    truth, population = pairs.filter("label = 1").select("e", "t"), pairs.select("e").distinct()
    held = (pairs, population, truth)
    model, decision = learning.final_with_decision(pairs, ["x"], population, truth, "e", "t", [0.1, 0.5, 0.9], held, rounds=2, depth=2)
    assert decision["threshold_source"].startswith("held-out") and decision["macro_f05"] > 0.95
    _, out_of_fold = learning.final_with_decision(pairs, ["x"], population, truth, "e", "t", [0.1, 0.5, 0.9], folds=2, rounds=2, depth=2)
    assert out_of_fold["threshold_source"].startswith("out-of-fold")
    learning.write_decision(spark, decision, f"file://{tmp_path}/d")
    assert learning.read_decision(spark, f"file://{tmp_path}/d") == decision and json.dumps(decision)
    lists = prediction.model_lists(model, pairs, population, "e", "t", decision["threshold"])
    assert lists.filter("matched_ids <> '' and not contains(matched_ids, ',')").count() == 60
    chance = pairs.withColumn("label", F.pmod(F.xxhash64("t"), F.lit(2)).cast("double")).withColumn("x", F.pmod(F.xxhash64("t", F.lit(1)), F.lit(97)))  # nothing to learn
    stopped = learning.classifier(["x"], rounds=30, depth=2, stop="stop").fit(learning.weighed(chance))
    assert stopped.stages[-1].getNumTrees < 30


def test_labelled_matrix(spark):
    records = spark.createDataFrame([("e", "Acme Ltd", "1 Main St"), ("f", "Blue", "2 Rue X"), ("p", "Acme Limited", "1 Main St"), ("q", "Red", "")], "id string, n string, a string").select("id", text.normalized_record("n", "a").alias("r"))
    meta = F.create_map(F.lit("name"), F.struct(F.lit(1).cast("long").alias("rank"), F.lit(0.5).alias("score")))
    pairs = spark.createDataFrame([("e", "p"), ("f", "q"), ("x", "p"), ("e", "y"), ("x", "y")], "e string, t string").withColumns({"best_score": F.lit(0.5), "metadata": meta, "source": F.lit(2)})
    sides = records.filter("id in ('e', 'f')"), records.filter("id in ('p', 'q')")
    counted = features.missing_records(features.with_records(pairs, *sides, "e", "t")).first()
    assert tuple(counted) == (5, 2, 1, 2)
    got = features.labelled_matrix(pairs, spark.createDataFrame([("e", "p"), ("e", "p")], "e string, t string"), *sides, "e", "t")
    assert sorted((r.e, r.t, r.label) for r in got.collect()) == [("e", "p", 1), ("f", "q", 0)] and len(got.columns) == 63


def test_shards_are_done_once(spark, tmp_path):
    who = spark.createDataFrame([(f"S1-{i}",) for i in range(50)], "e string")
    done = []

    def step(part):
        done.append(part.count())
        if len(done) == 2:
            raise RuntimeError("stopped")
        return part.withColumn("n", F.length("e"))

    with pytest.raises(RuntimeError):
        sinks.resumable(who, "e", step, f"file://{tmp_path}/s", 3)
    got = sinks.resumable(who, "e", step, f"file://{tmp_path}/s", 3)
    assert len(done) == 4 and sum(done) - done[1] == 50 and rows(got.select("e")) == rows(who)  # the first shard was not done again
    assert sum(who.filter(ids.shard(F.col("e"), 3, k)).count() for k in range(3)) == 50
    assert 0 < who.filter(ids.sampled(F.col("e"), 0.5)).count() < 50 and rows(splits.shown(who, "e", 5)) == rows(splits.shown(who.orderBy("e"), "e", 5))


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k long, v string, at long")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 3), (3, None, 0)], "k long, v string, at long")
    assert rows(sinks.upsert(base, changes, ["k"], "at")) == [(1, "a", 5), (2, "d", 3), (3, None, 0)]
    assert rows(sinks.insert_ignore(base, changes.filter("at > 1 or k = 3"), ["k"])) == [(1, "a", 5), (2, "b", 5), (3, None, 0)]


def test_new_files_are_normalised_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: normalise.normalise_new_files(spark, f"file://{source}", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    (source / "a.tsv").write_text(HEAD + 'S1-a\t"Blue\tDoor ""X"" Ltd"\t5 Mill Road\tFrance\nS1-b\tNA\t\tIndia\n')
    run()
    (source / "b.tsv").write_text(HEAD + "S1-c\tKiosk\t33000 Bordeaux\tFrance\n")
    run()
    run()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.entity_id, r.name_normalized, r.house_number_source, r.address_missing) for r in got.collect()) == [("S1-a", "blue door x limited", "leading_number_heuristic", 0), ("S1-b", "na", "", 1), ("S1-c", "kiosk", "", 0)]
    audit = {(r.country, r.is_total): r for r in normalise.normalising_audit(got).collect()}
    assert audit[None, 1].rows == 3 and audit["France", 0].house_number_leading_number_heuristic == 1 and audit["India", 0].name_null_like == 1 and audit[None, 1].name_changed == 3


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("dir/a.tsv", "x" * 1000)
        z.writestr("b.bin", bytes(range(256)))
    got = archives.zip_members(spark, f"file://{tmp_path}/good.zip").collect()
    assert {(r.name, r.bytes) for r in got} == {("dir/a.tsv", 1000), ("b.bin", 256)} and bytes(next(r for r in got if r.name == "b.bin").content) == bytes(range(256))
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("../x", "x")
    with pytest.raises(Exception, match="leads out"):
        archives.zip_members(spark, f"file://{tmp_path}/evil.zip").collect()
    data = bytearray((tmp_path / "good.zip").read_bytes())
    data[data.index(b"xxxx") + 10] ^= 1
    (tmp_path / "bad.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="CRC"):
        archives.zip_members(spark, f"file://{tmp_path}/bad.zip").collect()


def test_malformed_lines_and_columns(spark, tmp_path):
    path = tmp_path / "f.tsv"
    path.write_text(HEAD + "".join(f"S1-{i}\tn\ta\tc\n" if i % 3 else f"short {i}\tx\n" for i in range(30)))
    assert [r["value"] for r in delimited.malformed(spark, f"file://{path}", 4).collect()] == [f"short {i}\tx" for i in (0, 3, 6, 9, 12)]
    good = tmp_path / "g.tsv"
    good.write_text(HEAD + "S1-a\tn\t\tc\n")
    assert rows(delimited.read_columns(spark, f"file://{good}", ["country", "business_address"])) == [("c", "")]
    frame = delimited.read_strict(spark, f"file://{good}")
    assert rows(delimited.union_sources([frame, frame], ["entity_id"])) == [("S1-a",)] * 2 and delimited.keep_ids(frame, frame.limit(0), "entity_id").isEmpty()


def test_small_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "c string").select(c(F.col("c"))).first()[0]
    assert one(text.tolerant_list, '["a"]') == ["a"] and one(text.tolerant_list, "no list") == one(text.tolerant_list, None) == []
    assert one(text.canonical_number, " 5 / 7 ") == "5/7" and one(ids.checked_reference_id, "S1-x") == "S1-x"
    with pytest.raises(Exception, match="not a reference id"):
        one(ids.checked_reference_id, "S2-x")
    grams = one(text.hashed_grams, "abab ab")
    assert sum(grams.values()) == 4 + 3 + 2 + 2 + 1 + 1 and len(grams) == 10  # " abab " has 4, 3 and 2 grams; " ab " 2, 1 and itself as a whole; " ab", "ab ", " ab " come twice
    assert rows(spark.createDataFrame([(["n:a", "n:b", "c:ab", "n:d"],)], "t array<string>").select(text.name_bigrams(F.col("t")))) == [(["n:a", "n:b", "c:ab", "n:d", "m:a_b", "m:b_d"],)]
    sinks.same_population(spark.range(3), spark.range(3), "id")


def test_routes_find_what_they_should(spark):
    side = lambda data: spark.createDataFrame(data, "id string, name string, addr string, houses array<string>, postals array<string>")
    q = side([("q1", "blue door", "5 mill road", ["5"], ["33000"]), ("q2", "", "", [], [])])
    pool = side([("p1", "blue door", "5 mill road", ["5"], ["33000"]), ("p2", "other", "9 quay", ["9"], ["33000"]), ("p3", "blue lamp", "x", [], []), ("p4", "zzz", "5 mill lane", ["5"], [])])
    got = {(r["query"], r["record"]): r for r in blocking.retrieve(q, pool, q).collect()}
    assert {k[0] for k in got} == {"q1"} and got["q1", "p1"].routes == "address,combined,components,name,rare" and got["q1", "p1"].best_score == 1.0
    assert got["q1", "p2"].routes == "components" and got["q1", "p3"].metadata["rare"].rank == 2 + (got["q1", "p4"].metadata["rare"].score > got["q1", "p3"].metadata["rare"].score)
    assert "components" in got["q1", "p4"].routes and all(m.rank == 1 for m in got["q1", "p1"].metadata.values())
    few = blocking.retrieve(q, pool, q, blocking.Limits(budget=1))
    assert {r["record"] for r in few.collect()} == {"p1"}
