"""A training-corpus pipeline: each stage takes (spark, docs, sf_dir) and gives the next stage's documents.

ORACLE_SQL is None: the classifier's training and the tokenizer have no SQL form; tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelink.llm import decontamination, line_dedup, ngram_join, packing, quality_classifier
from lakelink.llm.common import materialise, table
from lakelink.llm.queries import quality_weights

LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled rows of the corpus itself.

    Null and empty texts have the score of the bias alone and stay or go by it; null ids and repeated rows go by their text; an empty table stays empty.
    """
    return quality_classifier.filter_documents(docs, quality_weights(spark, sf_dir), LEAST_QUALITY)


def packed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id, text, and all other columns in one, so that no operator's own names clash with theirs."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("others")] if others else [])), others


def unpacked(df: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    own = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c)
    return df.select(*(instead.get(c, own(c)).alias(c) for c in columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines cut; n_chars follows the text. A document of which no word is left goes, as all it had stands elsewhere.

    Null and empty texts stay as they are. Repeated rows, alike in id and text, count as one document and get one result; a null id is a document before all others.
    """
    held, others = packed(docs)
    cut = line_dedup.dedup_lines(held).filter((F.col("n_cut_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    kind = dict(docs.dtypes).get("n_chars")
    made = {"n_chars": F.when(F.col("n_cut_lines") > 0, F.length("text")).otherwise(F.col("others").getField("n_chars")).cast(kind)} if kind else {}
    return unpacked(cut, docs.columns, **made)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows: the one of the least id, null ids last, and among repeated ids any one. Rows go by a key of their own, never by their id. Rows without words stay."""
    held, _ = packed(docs)
    keyed = materialise(held.withColumn("_row", F.monotonically_increasing_id()), "near-duplicate-rows")
    linked = materialise(ngram_join.linked_documents(keyed.select(F.col("_row").alias("doc_id"), "text")).withColumnsRenamed({"doc_id": "_row", "component_id": "_group"}), "near-duplicate-groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    named = linked.filter("n_shingles > 0").join(keyed.select("_row", "doc_id"), "_row").groupBy("_group").agg(first.alias("_row")).select("_row")
    return unpacked(keyed.join(named.union(linked.filter("n_shingles = 0").select("_row")), "_row", "left_semi"), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts stay; null ids and repeated rows go by their text; an empty benchmark lets all stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. A null or empty text is the separator alone; repeated rows and null ids are packed like any others."""
    return packing.concat_and_cut(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
