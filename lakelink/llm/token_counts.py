"""Token counts through a digest cache.

Stored counts are found by two digests: of the content and of the tokenizer (library, its version and the
bytes of its file). Only distinct contents without a stored count are encoded; their counts are appended to
the cache, a Parquet table (content binary, tokenizer string, n_tokens long), and every document then reads
its count from there. The content is normalised to the one form that cannot change a count: null becomes
empty; anything else, such as white space or composition, may and so stays.
"""

from __future__ import annotations

import hashlib
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir, slices


def library(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_digest(path: str) -> str:
    name = library(path)
    with open(path, "rb") as f:
        return hashlib.sha256(f"{name} {version(name)} ".encode() + f.read()).hexdigest()


def counter(path: str):
    """A function from a list of texts to their token counts, without begin, end or added special tokens."""
    if library(path) == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def encode_misses(path: str, digest: str):
    def run(batches):
        count = counter(path)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array([digest] * len(n)), pa.array(n, pa.int64())], ["content", "tokenizer", "n_tokens"])

    return run


def _stored(spark, cache: str) -> DataFrame | None:
    try:
        return spark.read.parquet(cache)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def store_counts(docs: DataFrame, path: str, cache: str) -> None:
    """Encode the distinct texts that the cache has no count of, and append their counts. Null texts count as empty; an empty table appends nothing."""
    spark, digest = docs.sparkSession, tokenizer_digest(path)
    misses, stored = keyed(docs).select("content", "text"), _stored(spark, cache)
    if stored is not None:
        misses = misses.join(stored.filter(F.col("tokenizer") == digest).select("content").distinct(), "content", "left_anti")
    distinct = misses.groupBy("content").agg(F.first("text").alias("text"))
    distinct.mapInArrow(encode_misses(path, digest), "content binary, tokenizer string, n_tokens long").write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of documents; null texts count as empty.

    ``path`` is the tokenizer's file on every machine, ``cache`` the folder of the cache (a new one by default).
    Copies, however many, are encoded once; a digest that two runs stored at once counts once.
    """
    spark, digest = docs.sparkSession, tokenizer_digest(path)
    cache = cache or shared_dir(spark, "token-cache")
    store_counts(docs, path, cache)
    counts = materialise(spark.read.parquet(cache).filter(F.col("tokenizer") == digest).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keyed(docs, "doc_id").drop("text").join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
