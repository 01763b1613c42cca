"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the benchmark's windows of words. A table says for every block of two words how far a
scan may jump when it sees that block at the end of its window; at a jump of zero the bucket of the last
words' hash holds the test strings to compare, byte by byte. Most words of ordinary text are in no block, so
a scan looks at about one word in nine. Texts are scanned in stretches, a cursor for each, and all cursors of a batch
take their next jump together, as array operations.

Tables are sorted arrays (about 100 bytes a window, the test strings included). Those of at most ``most_windows``
windows are broadcast at a time; a larger benchmark takes a pass over the texts for each block of that many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, filter_in_arrow, materialise, slices

WINDOW = 10
#: Test strings whose tables are broadcast at a time: 50 MB or so.
MOST_WINDOWS = 500_000
#: Words of a stretch that one cursor scans, and bytes that are split into words at a time.
STRETCH, BLOCK = 256, 1 << 19
ODD = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to lower case; ASCII other than letters and digits separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def item_windows(text: bytes, window: int = WINDOW) -> list[bytes]:
    """All windows of an item, their words parted by spaces; a shorter item is one window, an item without words has none."""
    w = words(text)
    return [b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else []


def folded(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts as one, with spaces for all that separates words, and where each begins."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return b" ".join([*texts, b""]).translate(FOLD), np.cumsum(sizes) - sizes


def word_places(buf: bytes, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and a hash of each word: the sum of its bytes times powers of an odd number. A block of bytes, ended by a space, is worked on at a time."""
    found, begin, powers = [], 0, np.ones(1, np.uint64)
    while begin < len(buf):
        end = buf.find(b" ", min(begin + block, len(buf))) + 1 or len(buf)
        bytes_ = np.frombuffer(buf, np.uint8, end - begin, begin)
        inside = np.flatnonzero(bytes_ != 32)
        if len(inside):
            at = np.flatnonzero(np.diff(inside, prepend=-2) > 1)  # each word's first byte among those inside words
            n = np.diff(at, append=len(inside))
            if len(powers) < n.max():
                powers = np.cumprod(np.full(int(n.max()), ODD, np.uint64))
            place = np.arange(len(inside)) - np.repeat(at, n)
            starts = inside[at] + begin
            found.append((starts, starts + n, np.add.reduceat((bytes_[inside].astype(np.uint64) + np.uint64(1)) * powers[place], at)))
        begin = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def mixed(h: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words that end at each of the places."""
    out = h[ends]
    for back in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[ends - back]
    return out


class Tables:
    """Shift table and suffix buckets of test strings that all have one length in words."""

    def __init__(self, length: int, patterns: dict[bytes, set[str]]):
        self.length, self.block, self.tail = length, min(2, length), min(4, length)
        self.default = length - self.block + 1
        h = word_places(b" ".join([*patterns, b""]))[2]
        last = np.arange(len(patterns)) * length + length - 1
        keys = np.concatenate([mixed(h, last - back, self.block) for back in range(self.default)])
        jump = np.repeat(np.arange(self.default), len(patterns))
        order = np.lexsort((jump, keys))  # the least jump of a block first
        self.blocks, first = np.unique(keys[order], return_index=True)
        self.jumps = jump[order][first].astype(np.uint16)
        tails = mixed(h, last, self.tail)
        order = np.argsort(tails, kind="stable")
        self.tails, ordered = tails[order], list(patterns.items())
        self.patterns, self.items = [ordered[i][0] for i in order], [tuple(ordered[i][1]) for i in order]

    def candidates(self, h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ends (the last word's place) of windows whose last block ends a test string; texts are h[begin:end]."""
        at, stop = [], []
        for begin, end in zip((begins + self.length - 1).tolist(), ends.tolist()):
            if begin < end:
                cuts = np.arange(begin, end, STRETCH)
                at.append(cuts)
                stop.append(np.append(cuts[1:], end))
        if not at:
            return np.zeros(0, np.int64)
        at, stop, found = np.concatenate(at), np.concatenate(stop), []
        while len(at):
            key = mixed(h, at, self.block)
            place = np.minimum(np.searchsorted(self.blocks, key), len(self.blocks) - 1)
            jump = np.where(self.blocks[place] == key, self.jumps[place], self.default)
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate(found)

    def find(self, buf: bytes, at: tuple[np.ndarray, np.ndarray, np.ndarray], begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(the first word's number, items) of every occurrence in the texts, which are the words begin:end."""
        starts, stops, h = at
        last = self.candidates(h, begins, ends)
        key = mixed(h, last, self.tail) if len(last) else np.zeros(0, np.uint64)
        low, high = np.searchsorted(self.tails, key, "left"), np.searchsorted(self.tails, key, "right")
        for end, a, b in zip(*(x[high > low].tolist() for x in (last, low, high))):
            here = b" ".join(buf[starts[end - self.length + 1] : stops[end]].split())
            for k in range(a, b):
                if self.patterns[k] == here:
                    yield end - self.length + 1, self.items[k]


def build(patterns: dict[bytes, set[str]]) -> list[Tables]:
    by_length: dict[int, dict] = {}
    for p, items in patterns.items():
        by_length.setdefault(p.count(b" ") + 1, {})[p] = items
    return [Tables(n, ps) for n, ps in sorted(by_length.items())]


def pattern_blocks(benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> Iterator[list[Tables]]:
    """Search tables for the benchmark, block by block; rows stream through the driver. Null ids name no item, though their windows count. An empty benchmark is one block without tables."""
    block: dict[bytes, set[str]] = {}
    made = False
    for item, text in benchmark.selectExpr("cast(item_id as string)", "text").filter("text is not null").toLocalIterator():
        for p in item_windows(text.encode(), window):
            block.setdefault(p, set()).update(() if item is None else (item,))
            if len(block) >= most_windows:
                yield build(block)
                block, made = {}, True
    if block or not made:
        yield build(block)


def search(tables: list[Tables], texts: list[bytes]) -> list[tuple[np.ndarray, set[str]]]:
    """For each text, which of its words any occurrence has, and the occurring items."""
    buf, offsets = folded(texts)
    at = word_places(buf)
    begins = np.searchsorted(at[0], offsets)
    ends = np.append(begins[1:], len(at[0]))
    hit, items = np.zeros(len(at[0]), bool), [set() for _ in texts]
    for t in tables:
        for begin, found in t.find(buf, at, begins, ends):
            hit[begin : begin + t.length] = True
            items[int(np.searchsorted(ends, begin, "right"))].update(found)
    return [(hit[b:e], i) for b, e, i in zip(begins, ends, items)]


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _results(ids, rows) -> pa.RecordBatch:
    n, hits, found = [len(h) for h, _ in rows], [int(h.sum()) for h, _ in rows], [i for _, i in rows]
    digests = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in found]
    cols = [pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for i in found], pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())]
    return pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", *(x.split()[0] for x in RESULT.split(", "))])


def scanned(shared):
    """(batch, its rows' hits and items), a slice at a time."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield part, search(shared.value, as_bytes(part, "text"))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of documents.

    Null and empty texts have no words. Overlapping occurrences hit a word once. An empty benchmark hits nothing. Null ids and repeated rows are rows like any others.
    """
    doc_type, sc = dict(docs.dtypes)["doc_id"], docs.sparkSession.sparkContext
    blocks = pattern_blocks(benchmark, window, most_windows)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        alone = scanned(sc.broadcast(first))
        return docs.select("doc_id", "text").mapInArrow(lambda batches: (_results(part.column("doc_id"), rows) for part, rows in alone(batches)), f"doc_id {doc_type}, {RESULT}")

    keyed, found = materialise(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "decontamination-rows"), None
    for k, tables in enumerate(_chain(first, second, blocks)):  # each pass writes what it found; texts are not written again
        shared = sc.broadcast(tables)
        got = materialise(keyed.select("row", "text").mapInArrow(_found(scanned(shared), whole=k == 0), "row long, n long, hit binary, items array<string>"), "decontamination-found")
        shared.unpersist()
        found = got if found is None else found.unionByName(got)
    merged = found.groupBy("row").agg(F.max("n").alias("n"), F.collect_list("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # a row of each pass for a document, at most
    return keyed.select("row", "doc_id").join(merged, "row").select("doc_id", "n", "hits", "items").mapInArrow(_merge, f"doc_id {doc_type}, {RESULT}")


def _chain(first, second, rest):
    yield first
    yield second
    yield from rest


def _found(scan, whole: bool):
    """Rows with hits, or in the first pass all rows."""

    def run(batches):
        for part, rows in scan(batches):
            keep = [i for i, (h, _) in enumerate(rows) if whole or h.any()]
            cols = [pa.array([len(rows[i][0]) for i in keep], pa.int64()), pa.array([np.packbits(rows[i][0]).tobytes() if rows[i][0].any() else b"" for i in keep], pa.binary()), pa.array([sorted(rows[i][1]) for i in keep], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(keep, pa.int64())), *cols], ["row", "n", "hit", "items"])

    return run


def _merge(batches):
    for batch in batches:
        rows = []
        for n, hits, items in zip(*(batch.column(c).to_pylist() for c in ("n", "hits", "items"))):
            hit = np.zeros(n, bool)
            for bits in filter(None, hits):
                hit |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
            rows.append((hit, set(items)))
        yield _results(batch.column("doc_id"), rows)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The rows of documents without any occurrence, with all their columns, whatever their names. Null and empty texts stay; null ids and repeated rows go by their text.

    Beyond ``most_windows`` windows the rows that are left are written between the passes, so one block's tables are in memory at a time.
    """
    before = None
    for tables in pattern_blocks(benchmark, window, most_windows):
        if before is not None:
            docs = materialise(docs, "decontaminated")
            before.unpersist()
        before = docs.sparkSession.sparkContext.broadcast(tables)
        scan = scanned(before)
        docs = filter_in_arrow(docs, lambda batches, scan=scan: (part.filter(pa.array([not h.any() for h, _ in rows], pa.bool_())) for part, rows in scan(batches)))
    return docs
