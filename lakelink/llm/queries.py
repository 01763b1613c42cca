"""The ten operators applied to the driver's tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import decontamination, line_dedup, ngram_join, packing, quality_classifier, quality_rules, secret_scan, token_counts, toxicity, warc
from .common import fold_remainder, shared_dir, table


def op1_distribution_divergence(spark, sf_dir):
    got = quality_rules.distribution_divergence(table(spark, sf_dir, "documents"))
    return got.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def quality_weights(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").filter(fold_remainder(F.col("doc_id"), 4) != 2)
    return quality_classifier.fit(table(spark, sf_dir, "documents"), labels)


def op2_ftrl_quality(spark, sf_dir):
    scored = quality_classifier.score_documents(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    held = F.coalesce(fold_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_digest_token_counts(spark, sf_dir):
    """Documents are counted with a cache that already holds the counts of the benchmark's items."""
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), shared_dir(spark, "token-cache")
    token_counts.store_counts(table(spark, sf_dir, "benchmark"), path, cache)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path, cache)


def op4_concat_cut(spark, sf_dir):
    return packing.concat_and_cut(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_wu_manber(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_chunks(spark, sf_dir):
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return got.select("doc_id", F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"), "n_cut_lines", (F.col("n_cut_lines") > 0).alias("changed"))


def op7_compression_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold_remainder(F.col("doc_id"), 5) != 0))
    held = F.coalesce(fold_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_gzip_normaliser(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_secret_ownership(spark, sf_dir):
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op10_multi_order_jaccard(spark, sf_dir):
    return ngram_join.linked_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_distribution_divergence, op2_ftrl_quality, op3_digest_token_counts, op4_concat_cut, op5_wu_manber, op6_line_chunks, op7_compression_toxicity, op8_gzip_normaliser, op9_secret_ownership, op10_multi_order_jaccard)}
