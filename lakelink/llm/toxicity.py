"""Toxicity by compression distance.

All dictionaries are trained apart, each on text of one label: a large and a small one on ordinary text, and one to
four on toxic text, as large as the small ordinary one. A window is compressed after the large dictionary with the
small ordinary one behind it, and after the large one with a toxic one behind it. What any text has in common is in
the large dictionary and costs alike both times, so the difference of both lengths tells which label's text the rest
of the window is like.

A document labelled toxic is mostly ordinary prose. So a toxic dictionary is trained in rounds: first on all windows
of toxic documents, then on those that the toxic dictionary of the other half of the documents compresses better, by more
than all but few windows of ordinary documents. Each half judges the other, as a window always fits a dictionary that it is part of.
Toxic documents that the first dictionary does not find, such as those in other languages, make a second one, and so on.

Rows that no dictionary has seen calibrate two thresholds for each toxic dictionary: by how many bytes a window has to differ, and
how far the number of such windows has to exceed what ordinary text has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, slices

#: Training rows of each label at most, and bytes of their text at most: the documented bounds of the sample.
MOST_ROWS, MOST_BYTES = 3000, 12 << 20
WINDOW, STEP, LEVEL, LEAST_MATCH = 32, 16, 3, 6
#: Bytes of the large ordinary dictionary and of either small one, and the length of the segments that training picks.
BASE, DICTIONARY, SEGMENT = 128 << 10, 2 << 10, 24
ROUNDS, RARE, MOST_TOXIC = 3, 0.99, 4
#: Bytes by which a window may have to differ; calibration takes one of them.
THRESHOLDS = (2, 3, 4, 5, 6, 8)
#: Bytes of texts whose windows are compressed together.
TOGETHER = 256 << 10
#: What a false alarm rate costs, when a miss rate costs 1.
ALARM_COST = 10.0
#: A further toxic dictionary stays if its cost is this at most.
LEAST_GAIN = 0.9


@dataclass
class Toxic:
    """A toxic dictionary and its thresholds: a window counts that is shorter by ``bytes_apart``, and a text whose such windows exceed the ``usual`` share by ``excess`` deviations."""

    content: bytes
    bytes_apart: int = THRESHOLDS[0]
    usual: float = 0.0
    excess: float = 0.0
    slope: float = 1.0

    def raw(self, diff: np.ndarray) -> float:
        return self.slope * (over(diff, self.bytes_apart, self.usual) - self.excess)


@dataclass
class Model:
    base: bytes = b""
    ordinary: bytes = b""
    toxic: list[Toxic] = field(default_factory=list)
    otherwise: float = 0.0
    window: int = WINDOW
    step: int = STEP


def windows(text: bytes, window: int, step: int) -> list[bytes]:
    """Overlapping windows over the whole text; the last one reaches its end."""
    if len(text) <= window:
        return [text] if text else []
    return [text[i : i + window] for i in [*range(0, len(text) - window, step), len(text) - window]]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on these windows; where they are too few for training, the windows themselves.

    Training picks segments from one stretch of the windows after the other and ends early where some stretches offer nothing new, as those of copied
    documents do. So the windows are shuffled, in a fixed way.
    """
    order = np.random.default_rng(len(samples)).permutation(len(samples))
    try:
        return zstandard.train_dictionary(size, [samples[i] for i in order], k=SEGMENT, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(base: bytes, behind: bytes, size: int = DICTIONARY) -> zstandard.ZstdCompressor:
    """Both dictionaries as one content; a shorter one behind is filled up, so that the large one always stands as far off."""
    kept = zstandard.ZstdCompressionDict(base + bytes(size - len(behind)) + behind, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=LEAST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    kept.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=kept, compression_params=how)


def lengths(how: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, map(how.compress, parts)), np.int64, len(parts))


def over(diff: np.ndarray, apart: int, usual: float) -> float:
    """By how many deviations the windows of at least that difference are more than ordinary text of as many windows has."""
    expected = usual * len(diff)
    return float(((diff >= apart).sum() - expected) / np.sqrt(expected + 0.3))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.ordinary = model, compressor(model.base, model.ordinary)
        self.toxic = [compressor(model.base, t.content) for t in model.toxic]

    def differences(self, text: bytes) -> list[np.ndarray]:
        """For each toxic dictionary and window, by how many bytes the window is shorter with it than with the ordinary one."""
        return next(self.every_difference([text]))

    def every_difference(self, texts: list[bytes]) -> Iterator[list[np.ndarray]]:
        """``differences`` of text after text. One dictionary after the other compresses all windows, for its tables then stay in the processor's cache."""
        cut = [windows(t.lower(), self.model.window, self.model.step) for t in texts]
        every = [w for parts in cut for w in parts]
        plain = lengths(self.ordinary, every)
        apart = [plain - lengths(t, every) for t in self.toxic]
        ends = np.cumsum([len(parts) for parts in cut])
        for parts, end in zip(cut, ends):
            yield [d[end - len(parts) : end] for d in apart]

    def score(self, text: bytes) -> float:
        """By the toxic dictionary that finds most in the text; 0.5 is at its thresholds."""
        return self.scores([text])[0]

    def scores(self, texts: list[bytes]) -> list[float]:
        """``score`` of every text."""
        raw = [max((t.raw(d) for t, d in zip(self.model.toxic, apart)), default=self.model.otherwise) for apart in self.every_difference(texts)]
        return [float(1 / (1 + np.exp(-np.clip(r, -30, 30)))) for r in raw]


class Halves:
    """Toxic documents in two halves, each judged by a dictionary of the other, and ordinary documents to judge by."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], base: bytes, behind: bytes, window: int, step: int):
        self.base = base
        plain = compressor(base, behind)
        cut = lambda texts: [(w := windows(t, window, step), lengths(plain, w)) for t in texts]
        self.halves, self.ordinary = [cut(toxic[::2]), cut(toxic[1::2])], cut(ordinary)

    def picked(self) -> list[list[bytes]]:
        """The windows of either half that are like the toxic documents of the other and not like ordinary text."""
        got = [[w for parts, _ in half for w in parts[::2]] for half in self.halves]
        for _ in range(ROUNDS):
            judges = self.judges = [compressor(self.base, dictionary(p, DICTIONARY)) for p in got]
            usual = [plain - lengths(j, parts) for j in judges for parts, plain in self.ordinary]
            bar = np.quantile(np.concatenate([np.zeros(1, np.int64), *usual]), RARE)
            got = [[w for parts, plain in half for w, d in zip(parts, plain - lengths(judge, parts)) if d > bar] for half, judge in zip(self.halves, reversed(judges))]
        return got

    def drop_found(self, toxic: Toxic) -> None:
        """Leave the documents that its thresholds do not find, each judged by the dictionary of the other half."""
        self.halves = [[(parts, plain) for parts, plain in half if toxic.raw(plain - lengths(judge, parts)) < 0] for half, judge in zip(self.halves, reversed(self.judges))]


def least_cost(yes: np.ndarray, no: np.ndarray) -> tuple[float, float, float]:
    """(cost, cut, margin): the cut between two scores that costs least, and how far the scores around it are apart; to find nothing costs 1."""
    yes, no = np.sort(yes), np.sort(no)
    scores = np.unique(np.concatenate([yes, no]))
    scores = np.append(scores, scores[-1] + 2)
    cuts = (scores[1:] + scores[:-1]) / 2
    cost = np.searchsorted(yes, cuts) / len(yes) + ALARM_COST * (1 - np.searchsorted(no, cuts) / len(no))
    at = int(np.argmin(cost))
    return float(cost[at]), float(cuts[at]), float(scores[at + 1] - scores[at])


def calibrated(content: bytes, toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> tuple[float, Toxic]:
    """The least cost of any thresholds over these documents' differences, of equal costs that of the widest margin; and the dictionary with those thresholds."""
    every, found = np.concatenate(ordinary), []
    for apart in THRESHOLDS:
        usual = max(float((every >= apart).mean()) if len(every) else 0.0, 1e-4)
        yes, no = (np.array([over(d, apart, usual) for d in diff]) for diff in (toxic, ordinary))
        (cost, cut, margin), spread = least_cost(yes, no), max(float(np.std(no)), 0.1)
        found.append((cost, -margin / spread, apart, Toxic(content, apart, usual, cut, 1 / spread)))
    best = min(found, key=lambda x: x[:3])
    return best[0], best[3]


def train(rows: list[tuple[bytes, int]], window: int = WINDOW, step: int = STEP) -> Model:
    """A model from (UTF-8 text, label) rows. Every third row of a label calibrates, the others make the dictionaries.

    Without rows enough of both labels (six of each) the score is constant: the share of label 1 (0.5 without any row), pressed towards the middle.
    """
    texts = {k: [t.lower() for t, y in rows if y == k] for k in (0, 1)}
    share = len(texts[1]) / len(rows) if rows else 0.5
    model = Model(otherwise=4 * (2 * share - 1), window=window, step=step)
    if min(map(len, texts.values())) < 6:
        return model
    held, fitted = ({k: [t for i, t in enumerate(ts) if (i % 3 == 0) == out] for k, ts in texts.items()} for out in (True, False))
    cut = lambda ts: [w for t in ts for w in windows(t, window, window)]
    model.base, model.ordinary = dictionary(cut(fitted[0][::2]), BASE), dictionary(cut(fitted[0][1::2]), DICTIONARY)
    halves, yes, no = Halves(fitted[1], held[0][::2], model.base, model.ordinary, window, step), held[1], held[0][1::2]
    for k in range(MOST_TOXIC):
        first, second = halves.picked()
        content = dictionary(first + second, DICTIONARY)
        alone = Scorer(Model(model.base, model.ordinary, [Toxic(content)], window=window, step=step))
        diff = [[alone.differences(t)[0] for t in ts] for ts in (yes, no)]
        cost, found = calibrated(content, *diff)
        if k and cost > LEAST_GAIN:
            break
        model.toxic.append(found)
        halves.drop_found(found)
        yes = [t for t, d in zip(yes, diff[0]) if found.raw(d) < 0]
        if min(len(yes), *map(len, halves.halves)) < 6:
            break
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Model:
    """Train on at most ``most_rows`` rows of either label, those with the least hash of their id, and ``most_bytes`` of their texts.

    Repeated ids, and an id that two rows label differently, give several rows; null ids and labels other than 0 and 1 are left out.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_id").isNotNull()).distinct()
    order = [F.xxhash64(F.col("_id").cast("string")), "_id"]
    sample = known.filter("_y = 1").orderBy(*order).limit(most_rows).union(known.filter("_y = 0").orderBy(*order).limit(most_rows))
    got = docs.join(F.broadcast(sample), docs["doc_id"] == sample["_id"]).select("_y", "_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))
    w = Window.partitionBy("_y").orderBy(*order, F.xxhash64("_text"))
    bounded = got.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= most_rows)
    bounded = bounded.withColumn("_sum", F.sum(F.length("_text")).over(Window.partitionBy("_y").orderBy("_at"))).filter(F.col("_sum") - F.length("_text") < most_bytes)
    return train([(bytes(r["_text"]), r["_y"]) for r in bounded.select("_y", "_at", "_text").orderBy("_y", "_at").toLocalIterator()])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: more likely toxic) of every row; all windows of a text count, null is an empty text.

    A text without windows has the score of an ordinary one. Repeated rows and null ids are scored like any others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                got = pa.array(scorer.scores(as_bytes(part, "text")), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), got], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
