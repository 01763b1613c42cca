"""The pipeline's stages on the small tables, each held against its operator or brute force."""

import numpy as np
import public_tokenizers

import corpus_pipeline as pipeline
from lakelink.llm import decontamination, line_dedup, ngram_join, packing
from lakelink.llm.common import materialise


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        got = materialise(stage(spark, docs, sf), "test")
        seen[name] = (docs, got)
        docs = got
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5 and all(seen[n][1].columns == seen[n][0].columns for n in names[:-1])
    before, after = seen["quality classifier"]
    assert after.exceptAll(before).isEmpty() and 0.7 < after.count() / before.count() < 1
    before, after = seen["line dedup"]
    whole = line_dedup.dedup_lines(before)
    left = [r for r in whole.collect() if not r["n_cut_lines"] or r["text"].split()]
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == sorted((r["doc_id"], r["text"]) for r in left)
    assert after.filter("n_chars <> length(text)").isEmpty()
    before, after = seen["n-gram Jaccard join"]
    assert after.exceptAll(before).isEmpty()
    groups = {r["component_id"] for r in ngram_join.linked_documents(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == groups
    before, after = seen["benchmark decontamination"]
    marks = decontamination.contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in marks.filter("not contaminated").collect()}
    before, after = seen["packing"]
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(encode(r["text"])) + 1 for r in before.collect())
    assert sum(r["length"] for r in after.collect()) == total and after.agg({"sequence_id": "max"}).first()[0] == (total - 1) // 1024


def test_near_duplicates_go_by_row(spark, sf):
    """Null ids, repeated rows, and an id that two different texts share."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    data = [(1, text["a"]), (1, text["a"]), (None, text["a"]), (2, text["a"] + " end"), (3, text["b"]), (4, text["b"]), (4, text["c"]), (None, text["d"]), (None, text["d"]), (5, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in pipeline.near_duplicates(spark, docs, sf).collect()]
    want = [(1, text["a"]), (3, text["b"]), (4, text["c"]), (None, text["d"]), (5, ""), (None, None), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_take_awkward_rows(spark, sf):
    """Nulls in any column, empty and very long texts, repeated rows and ties, and columns with names that operators use themselves: no stage crashes, and rows that nothing speaks against come out as they went in."""
    own = lambda k: "\n".join(" ".join(f"{k}{i}w{j}" for i in range(20)) for j in range(8))
    shared = "\n".join(" ".join(f"s{i}w{j}" for i in range(30)) for j in range(3))
    texts = [own("a"), own("a"), own("b") + "\n" + shared, own("c") + "\n" + shared, shared, None, "", " \n ", " ".join(f"l{i}" for i in range(30_000)), own("d"), own("d")]
    ids = [1, 1, 2, 3, 4, 5, 6, None, 8, None, 10]
    names = ["_row", "_group", "others", "n_cut_lines", "_key", "row", "hit", "score", "_text", "a.b"]
    data = [(i, t, None if k % 2 else "en", None if k % 3 else "src", None if t is None else len(t), *(None if (k + j) % 4 == 0 else f"{n}{k}" for j, n in enumerate(names))) for k, (i, t) in enumerate(zip(ids, texts))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    before = {tuple(r) for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        after = [tuple(r) for r in got.collect()]
        assert got.columns == docs.columns, name
        if name != "line dedup":
            assert set(after) <= before, name
    by = {(r[0], r[6], r[7]): r for r in (tuple(r) for r in pipeline.lines(spark, docs, sf).collect())}
    same = {(r[0], r[6], r[7]): r for r in before}
    cut = {k for k in by if by[k] != same[k]}
    assert {k[0] for k in cut} == {3} and {k[0] for k in same.keys() - by.keys()} == {4, 10}  # all of 4 and 10 stands elsewhere, so they go
    assert all(by[k][1] == own("c") and by[k][4] == len(own("c")) for k in cut if k[0] == 3)
    assert sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, sf).filter("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 8, 10]
    assert pipeline.pack(spark, docs, sf).select("doc_id").distinct().count() == 9


def test_line_dedup_leaves_no_document_without_words(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    empty = docs.filter("text is null or not text rlike '[^ \\n\\t]'").count()
    got = pipeline.lines(spark, docs, sf)
    assert got.filter("text is null or not text rlike '[^ \\n\\t]'").count() == empty and got.count() < docs.count()


def test_run_is_the_stages(spark, sf):
    got = pipeline.run(spark, sf)
    assert got.count() > 0 and np.all(got.select("length").toPandas().length <= 1024)


def test_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
