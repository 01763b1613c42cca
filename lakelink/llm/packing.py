"""Packing by concatenating and cutting.

All documents' ids, each document's ended by a separator, form one stream that is cut into windows of a
fixed length. Pass one encodes every partition and writes ids, the place of each document within its
partition and the partition's number. Prefix sums over the partitions' totals give global offsets. Pass two
cuts: each piece says which window it lies in and where, so a document that crosses a boundary has a
boundary record on either side. Only the last window is shorter.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices

#: Partitions whose offsets (16 bytes each) are broadcast at most; beyond that they are joined by shuffle.
MOST_BROADCAST_PARTS = 500_000
_BLOCK = 4096


def _printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A function from a text to its ids as a uint32 array: those that the tokenizers library gives without added special tokens.

    A plain byte-level BPE file is run by a faster engine with the same vocabulary: that needs merges in the
    order of their ids, the standard word pattern and no normaliser. Any other file is run by the library.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    ids = [model["vocab"].get(m, -1) for m in merges] if model.get("type", "BPE") == "BPE" else [-1]
    added = spec.get("added_tokens") or []
    plain = (
        split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer") and ids == sorted(set(ids)) and ids[:1] > [255]
        and not model.get("dropout") and not model.get("ignore_merges") and not any(a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word"))
        and len(model["vocab"].keys() - {a["content"] for a in added}) == 256 + len(ids)
    )
    if plain:
        import public_tokenizers
        import tiktoken

        of, special = _printable_bytes(), {a["content"]: a["id"] for a in added}
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        engine = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: engine.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def encode_partition(path: str, separator: int):
    """Pass one: doc_id, part, place (ids before it in its partition), n, ids (little-endian, 2 bytes each where all fit)."""

    def run(batches):
        encode, part_no, place = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                places, sizes, blobs = [], [], []
                for text in part.column("text").to_pylist():
                    ids = np.append(encode(text or ""), np.uint32(separator)).astype("<u4")
                    wide = ids.max() > 0xFFFF
                    blobs.append(ids.tobytes() if wide else ids.astype("<u2").tobytes())
                    places.append(place)
                    sizes.append(len(ids))
                    place += len(ids)
                cols = [pa.array([part_no] * len(sizes), pa.int64()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "part", "place", "n", "ids"])

    return run


def cut(length: int, keep_ids: bool):
    """Pass two: the pieces of each document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "ids", 4 << 20):
                at, out = [], [[] for _ in range(7)]
                for row, (blob, n, begin) in enumerate(zip(*(part.column(c).to_pylist() for c in ("ids", "n", "begin")))):
                    ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4").tobytes()
                    start = 0
                    while start < n:
                        sequence, offset = divmod(begin + start, length)
                        size = min(length - offset, n - start)
                        piece = ids[4 * start : 4 * (start + size)]
                        at.append(row)
                        for col, x in zip(out, (start, size, zlib.crc32(piece), n, sequence, offset, piece)):
                            col.append(x)
                        start += size
                cols = [part.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in out[:6])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if keep_ids:
                    cols, names = [*cols, pa.array(out[6], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def partition_offsets(encoded: DataFrame) -> DataFrame:
    """part, base: the ids in all partitions before it. Sums within blocks of partitions, then over the blocks, so no task takes them all."""
    block = F.floor(F.col("part") / _BLOCK)
    totals = encoded.groupBy("part").agg(F.max(F.col("place") + F.col("n")).alias("total")).withColumn("block", block)
    before = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("block").agg(F.sum("total").alias("total"))
    blocks = blocks.select("block", before(Window.orderBy("block")).alias("block_base"))  # a row for every 4096 partitions
    inner = totals.select("part", "block", before(Window.partitionBy("block").orderBy("part")).alias("inner_base"))
    return inner.join(blocks, "block").select("part", (F.col("block_base") + F.col("inner_base")).alias("base"))


def concat_and_cut(docs: DataFrame, path: str, length: int = 1024, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with ``keep_ids``).

    Null and empty texts are the separator alone. Documents follow one another in the order of pass one's
    partitions; which order that is does not matter, and it is fixed by what pass one wrote.
    """
    doc_type = dict(docs.dtypes)["doc_id"]
    encoded = materialise(docs.select("doc_id", "text").mapInArrow(encode_partition(path, separator), f"doc_id {doc_type}, part long, place long, n long, ids binary"), "packing")
    offsets = materialise(partition_offsets(encoded), "packing-offsets")
    if offsets.count() <= MOST_BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    placed = encoded.join(offsets, "part").select("doc_id", (F.col("base") + F.col("place")).alias("begin"), "n", "ids")
    schema = f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return placed.mapInArrow(cut(length, keep_ids), schema)
