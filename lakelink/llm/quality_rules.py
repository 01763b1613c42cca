"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are held against the
reference histograms of its language by Jensen-Shannon distance. The references are sums over all
documents of the language, so they follow the corpus. Short documents have no stable histogram:
minimum-length guards leave them to the base rules alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, materialise, slices

# Frequent function words of four languages; the bins of the word histogram.
COMMON_WORDS = (
    "a about after al als an and are as at au auch auf aus aux avec be been but by ce como con dans das de del dem den der des die "
    "du ein eine einer el en er es est et for from für has have he his ich il im in is ist it la las le les lo los mais mit más "
    "n'est nicht no not o of on or ou par para pas pero plus por pour qu que qui se sein si sich sie sind so su sur that the "
    "their this to un una und une von war was were which wie will with y zu zum à"
).split()
# The classes of ASCII characters; any other code point is class "other".
CLASSES = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t\r\x0b\x0c",
    "line": "\n",
    "stop": ".,;:?'\"-()",
    "shout": "!",
    "symbol": "#*$%&|<>",
}
WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_counts array<long>, word_counts array<long>"


def _word_code(bins: dict[bytes, int]):
    """56 hash bits of the word as it stands, then 8 bits for its bin among the common words."""

    def code(word: bytes) -> int:
        return (xxhash.xxh3_64_intdigest(word) >> 8 << 8) | bins.get(word.lower().strip(b".,;:!?'\"()"), 0)

    return code


def _windows_twice(codes: np.ndarray, width: int) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (codes[i : i + n] ^ (codes[i : i + n] >> np.uint64(31)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(window: int = 8):
    """The mapInArrow function: one row of counts for each document."""

    def run(batches):
        words = [w.encode() for w in COMMON_WORDS]
        memo = Memo(_word_code({w: i + 1 for i, w in enumerate(words)}))
        of_byte = np.full(256, len(CLASSES))
        for i, chars in enumerate(CLASSES.values()):
            of_byte[list(chars.encode())] = i
        inside = np.arange(256)
        inside = (inside >= 0x80) & (inside < 0xC0)  # continuation bytes are no code points of their own
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text in as_bytes(part, "text"):
                    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
                    by[inside] = 0
                    found = text.split()
                    codes = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
                    seen, again = set(), 0
                    for line in text.split(b"\n"):
                        if line in seen:
                            again += 1
                        elif line.strip():
                            seen.add(line)
                    out.append((
                        len(found), int(by.sum() - by[list(WHITE)].sum()), int(by[list(SYMBOLS)].sum()), again,
                        _windows_twice(codes >> np.uint64(8), window),
                        np.bincount(of_byte, weights=by, minlength=len(CLASSES) + 1).astype(np.int64),
                        np.bincount((codes & np.uint64(255)).astype(np.int64), minlength=len(words) + 1),
                    ))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
                cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *cols], ["doc_id", "lang", *names])

    return run


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of the rows of two tables of counts; nan where either row has no mass."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / p.sum(1, keepdims=True), q / q.sum(1, keepdims=True)
        m = (p + q) / 2
        part = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(1)
        out = np.sqrt(np.maximum(0.0, (part(p) + part(q)) / 2))
    return np.where(np.isnan(p).any(1) | np.isnan(q).any(1), np.nan, out)


def judge(min_words: int, min_chars: int, max_class: float, max_word: float):
    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(c)
            number = lambda c: column(c).to_numpy(zero_copy_only=False)
            words, chars = number("n_words"), number("word_chars")
            long, got = (words >= min_words) & (chars >= min_chars) & column("_class").is_valid().to_numpy(zero_copy_only=False), []
            for counts, ref in (("class_counts", "_class"), ("word_counts", "_word")):
                out = np.full(batch.num_rows, np.nan)
                if long.any():
                    mask = pa.array(long)
                    rows = lambda c: column(c).filter(mask).flatten().to_numpy(zero_copy_only=False).reshape(int(long.sum()), -1).astype(float)
                    out[long] = distances(rows(counts), rows(ref))
                got.append(out)
            failed = (words < 20) | (100 * number("n_repeat_words") > 30 * words)
            kept = ~failed & ~(got[0] > max_class) & ~(got[1] > max_word)  # nan exceeds nothing
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            cols = [*map(column, names), pa.array(failed), pa.array(kept), *(pa.array(g, from_pandas=True) for g in got)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "base_failed", "kept", "class_distance", "word_distance"])

    return run


def distribution_divergence(
    docs: DataFrame, min_words: int = 100, min_chars: int = 400, min_ref_docs: int = 20, max_class_distance: float = 0.26,
    max_word_distance: float = 0.36, most_languages: int = 2000,
) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance and kept for each row of documents.

    ``kept`` is false if a base rule fails or a guarded distance exceeds its limit. A distance is null, and
    without effect, for documents under ``min_words`` words or ``min_chars`` non-white characters, and where the
    language (null is one) has fewer than ``min_ref_docs`` documents that reach these lengths. Null and empty
    texts fail the base rule on words. The references are a row for each language; they are broadcast while
    there are at most ``most_languages`` of them and joined by shuffle beyond that.
    """
    counts = materialise(docs.select("doc_id", "lang", "text").mapInArrow(text_counts(), f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, {SCHEMA}"), "rules")
    long = (F.col("n_words") >= min_words) & (F.col("word_chars") >= min_chars)
    n_class, n_word = len(CLASSES) + 1, len(COMMON_WORDS) + 1
    cells = lambda name, n: F.array(*(F.sum(F.col(name)[i]) for i in range(n)))
    refs = (
        counts.filter(long).groupBy("lang")
        .agg(F.count("*").alias("_docs"), cells("class_counts", n_class).alias("_class"), cells("word_counts", n_word).alias("_word"))
        .filter(F.col("_docs") >= min_ref_docs).select(F.col("lang").alias("_lang"), "_class", "_word")
    )
    refs = materialise(refs, "rules-refs")
    if refs.count() <= most_languages:
        refs = F.broadcast(refs)
    got = counts.join(refs, counts["lang"].eqNullSafe(refs["_lang"]), "left").drop("lang", "_lang")
    result = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return got.mapInArrow(judge(min_words, min_chars, max_class_distance, max_word_distance), result)
