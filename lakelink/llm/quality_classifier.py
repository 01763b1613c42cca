"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Words and runs of marks are tokens; unigrams and bigrams of tokens are hashed into a fixed number of
slots. A document's value in a slot is the share of its n-grams there, so a score is one sparse dot
product whatever the length of the text. Training uses a bounded sample of labelled rows (``most_rows``,
chosen by a hash of the id) and runs on the driver over slot counts; scoring is one pass over all rows
with the weights (``4 << bits`` bytes) as a broadcast.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, filter_in_arrow, slices

BITS = 18
#: Training rows at most: the documented bound of the sample.
MOST_ROWS = 6000
TOKEN = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[^\x00-\x20\x30-\x39A-Za-z\x80-\xff]+|\n+")


def _token_hash(token: bytes) -> int:
    """Words hash by their lower case, with marks for their case and length; runs of marks as they stand."""
    return zlib.crc32(token.lower()) | (zlib.crc32(b"%d %d %d" % (token.isupper(), len(token) > 12, token.isalpha() or token[0] > 127)) << 32)


def slots(text: bytes, memo: Memo, bits: int = BITS) -> np.ndarray:
    """The slots of all n-grams of a text: tokens, token shapes, pairs of both, and tokens said again one or two places on."""
    found = TOKEN.findall(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    word, shape = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    mix = lambda x, salt: ((x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    again = np.full(int((word[1:] == word[:-1]).sum()), 1, np.uint64), np.full(int((word[2:] == word[:-2]).sum()), 2, np.uint64)
    return np.concatenate([mix(word, 1), *(mix(x, 5) for x in again), mix(word[1:] * np.uint64(3) + word[:-1], 2), mix(shape, 3), mix(shape[1:] * np.uint64(5) + shape[:-1], 4)])


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; coordinate 0 of an extra slot is the bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, label: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def vector(found: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(found, return_counts=True)
    return np.append(at.astype(np.int64), 1 << bits), np.append(SCALE * count / max(1, len(found)), 1.0)


#: The n-gram shares sum to this; the bias has value 1.
SCALE = 40.0


def train(rows: list[tuple[bytes, int]], bits: int = BITS, epochs: int = 4) -> np.ndarray:
    """Weights of all slots and, last, of the bias, from (slots as little-endian uint32, label) rows.

    Rows are visited in a fixed shuffled order. Rows of the rarer label weigh more, so both labels count alike up to a factor of 2.
    Without rows of both labels the score is the share of label 1 (0.5 without any row).
    """
    model = Ftrl((1 << bits) + 1)
    labels = np.array([y for _, y in rows])
    if len(rows) and 0 < labels.mean() < 1:
        share = labels.mean()
        weight = {1: min(1.0, 2 * (1 - share) / share), 0: min(1.0, 2 * share / (1 - share))}
        rng = np.random.default_rng(7)
        vectors = [vector(np.frombuffer(f, np.uint32).astype(np.uint64), bits) for f, _ in rows]
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                model.step(*vectors[i], labels[i], weight[int(labels[i])])
        return model.weights().astype(np.float32)
    out = np.zeros((1 << bits) + 1, np.float32)
    out[-1] = 0 if not len(rows) else 4 * (2 * labels.mean() - 1)
    return out


def features(docs: DataFrame, keep: list[str], bits: int = BITS) -> DataFrame:
    """The slots of each text, with the columns ``keep``."""

    def run(batches):
        memo = Memo(_token_hash)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [slots(t, memo, bits).astype(np.uint32).tobytes() for t in as_bytes(part, "text")]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *(part.column(c) for c in keep)], ["slots", *keep])

    kinds = dict(docs.dtypes)
    return docs.select("text", *keep).mapInArrow(run, ", ".join(["slots binary", *(f"{c} {kinds[c]}" for c in keep)]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, bits: int = BITS) -> np.ndarray:
    """Train on at most ``most_rows`` labelled rows, those with the least hash of their id; labels other than 0 and 1 and null ids are left out.

    Repeated ids, and an id that two rows label differently, give several rows, repeated rows one. Whatever the order and partitioning of
    the input, the rows and their order, and so the weights, are the same.
    """
    key = ["_hash", "_id", "_y", "_text"]
    known = labels.select(F.xxhash64(F.col("doc_id").cast("string")).alias("_hash"), F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull()).distinct()
    sample = F.broadcast(known.orderBy(*key[:3]).limit(most_rows))  # ids alone; their rows may be more, so these are bounded next
    labelled = docs.join(sample, docs["doc_id"] == sample["_id"]).select("text", *key[:3], F.xxhash64("text").alias("_text"))
    bounded = F.broadcast(labelled.select(*key).distinct().orderBy(*key).limit(most_rows))
    rows = features(labelled.join(bounded, key, "left_semi"), key, bits).dropDuplicates(key).collect()  # at most most_rows
    return train([(bytes(r[0]), r["_y"]) for r in sorted(rows, key=lambda r: tuple(r[k] for k in key))], bits)


def scorer(weights, bits: int = BITS):
    """A function from UTF-8 bytes to the score; ``weights`` is a broadcast."""
    w, memo = weights.value.astype(np.float64), Memo(_token_hash)

    def score(text: bytes) -> float:
        found = slots(text, memo, bits)
        raw = w[-1] + (SCALE * w[found.astype(np.int64)].sum() / len(found) if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))

    return score


def score_documents(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts have the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        score = scorer(shared, bits)
        for batch in batches:
            for part in slices(batch, "text"):
                got = pa.array([score(t) for t in as_bytes(part, "text")], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), got], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def filter_documents(docs: DataFrame, weights: np.ndarray, least: float, bits: int = BITS) -> DataFrame:
    """The rows of documents whose score is at least ``least``, with all their columns, whatever their names. Null and empty texts have the score of the bias alone; a null id and a repeated row stay or go by their text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        score = scorer(shared, bits)
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array([score(t) >= least for t in as_bytes(part, "text")], pa.bool_()))

    return filter_in_arrow(docs, run)
