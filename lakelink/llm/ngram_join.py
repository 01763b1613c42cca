"""N-gram Jaccard self-join with prefix filters under several global token orders.

Two documents link when the Jaccard similarity of their sets of word shingles reaches a threshold. A set of n
tokens can only reach a link through one of its first n - ceil(t n) + 1 tokens, under any total order of all
tokens. All orders used here put rare tokens first; they break ties, and group frequencies, in different ways. A
pair is verified only if it shares a prefix token under every order.

The steps:

1. Every text becomes its set of 64-bit shingle hashes. Tokens (the top bits of the hashes) go to buckets in packed
   blocks, each with the place of its document in a batch; a bucket finds the documents' frequency of each token
   and sends back those of two and more. A token that a batch holds many times travels once for the batch.
2. A token of frequency 1 links nothing. Documents with a prefix of such tokens alone, nearly all, are done.
3. Documents with the same set are one class. Classes with very frequent prefix tokens (groups of thousands of near
   copies) are first held against pivots, a few pairs for each class; what links becomes one node.
4. Nodes that share a prefix token form clusters. Small clusters are settled in one task each. In large ones the
   classes outside the largest node are paired with the classes of other nodes, where the places of a common
   token still allow the overlap that a link needs.
5. Components of the verified links.

The sets of documents in clusters are made anew from their texts, so whole sets are never stored for the corpus.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_bytes, materialise, scratch, shared_dir, slices
from .components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
#: Times a token is sent with its documents from one batch at most; a token that is there more often stays with the batch.
OFTEN = 64
#: Classes in a cluster that one task settles at most.
SMALL = 128
#: Ids that are broadcast at most to fetch texts; beyond that they are joined by shuffle.
MOST_BROADCAST = 200_000
#: Text bytes that step one copies out of a batch at a time.
PIECE_BYTES = 1 << 20
#: Words whose hashes a worker keeps at most (about 120 bytes each).
MOST_WORDS = 1 << 17


def shingle_set(text: bytes, width: int, memo: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, a text without words has none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for i in range(min(width, len(h))):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(_ODD[i % 8]) + h[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, MOST_WORDS)


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _rest(tokens: np.ndarray) -> np.ndarray:
    return (tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(7)


PACKED = "key long, batch long, tokens binary, places binary, often binary, often_n binary, ids {id}, sizes binary, signatures binary, kept binary, kept_places binary"


def pack(width: int, bits: int, doc_type: str):
    """Step one, mapping: a row of documents for each batch, and its tokens by bucket."""

    def run(batches):
        memo, task, number = word_memo(), TaskContext.get().partitionId(), 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 60_000):
                for part in slices(whole.slice(begin, 60_000), "text"):
                    batch, number = task << 28 | number, number + 1
                    yield from _packed(part, batch, width, bits, memo, doc_type)

    return run


def _by_token(tokens: np.ndarray, places: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by token, then place. Tokens of up to 48 bits are sorted in place together with their places; ``tokens`` is used up."""
    if bits > 16:
        order = np.argsort(tokens, kind="stable")  # places ascend
        return tokens[order], places[order]
    tokens <<= np.uint64(16)
    tokens |= places
    tokens.sort()
    places = tokens.astype(np.uint16)
    tokens >>= np.uint64(16)
    return tokens, places


def _pieces(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A null, then the values up to each end as binary, without a copy of them."""
    offsets = (np.r_[0, 0, ends] * values.itemsize).astype(np.int32)
    valid = np.packbits(np.arange(len(ends) + 1) > 0, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(ends) + 1, [pa.py_buffer(valid), pa.py_buffer(offsets), pa.py_buffer(values)])


def _packed(part, batch, width, bits, memo, doc_type):
    # What is made for each token is freed or handed on as soon as it can be: of a batch's texts an executor's workers otherwise hold many times the size.
    sizes, signatures, tokens = np.zeros((2, part.num_rows), np.uint32), [], []  # shingles, and tokens left of them: two shingles of a document may have one token
    for piece in slices(part, "text", PIECE_BYTES):
        for text in as_bytes(piece, "text"):
            s = shingle_set(text, width, memo)
            t = s >> np.uint64(32 - bits)
            t = t[np.r_[True, t[1:] != t[:-1]]] if len(t) else t
            sizes[:, len(tokens)] = len(s), len(t)
            signatures.append(signature(s))
            tokens.append(t)
    tokens = np.concatenate([np.zeros(0, np.uint64), *tokens])
    places = np.repeat(np.arange(part.num_rows, dtype=np.uint16), sizes[1])
    tokens, places = _by_token(tokens, places, bits)
    often = np.unique(tokens[OFTEN - 1 :][tokens[OFTEN - 1 :] == tokens[: max(0, len(tokens) - OFTEN + 1)]])
    begin, end = np.searchsorted(tokens, often), np.searchsorted(tokens, often, "right")
    often_n, many = (end - begin).astype(np.uint32), np.zeros(len(tokens) + 1, np.int8)
    many[begin] += 1
    many[end] -= 1
    many = np.cumsum(many[:-1], dtype=np.int8).astype(bool)
    kept, kept_places = tokens[many], places[many]
    if len(kept):
        tokens, places = tokens[~many], places[~many]
    edges = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32)
    cut, cut_often = np.searchsorted(tokens, edges), np.searchsorted(often, edges)
    low, low_often = tokens.astype(np.uint32), often.astype(np.uint32)
    del tokens, many
    keys = np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_often) > 0))  # the other buckets have nothing, so the pieces of these lie side by side
    n = len(keys) + 1
    of_docs = lambda value, kind: pa.array([value] + [None] * (n - 1), kind)
    cols = [
        pa.array(np.r_[-1 - batch, keys], pa.int64()), pa.array(np.full(n, batch), pa.int64()), _pieces(low, cut[keys + 1]), _pieces(places, cut[keys + 1]), _pieces(low_often, cut_often[keys + 1]), _pieces(often_n, cut_often[keys + 1]),
        of_docs(part.column("doc_id").to_pylist(), pa.list_(part.column("doc_id").type)), *(of_docs(x, pa.binary()) for x in (sizes.tobytes(), b"".join(signatures), kept.tobytes(), kept_places.tobytes())),
    ]
    yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in PACKED.split(", ")])


COUNTED = "batch long, key long, places binary, tokens binary, counts binary, often binary, often_counts binary, ids {id}, sizes binary, signatures binary, kept binary, kept_places binary"


def count_bucket(table: pa.Table) -> pa.Table:
    """Step one, reducing: for each batch, its tokens of the bucket that two documents or more have, with their frequency."""
    names = [x.split()[0] for x in COUNTED.split(", ")]
    rows = table.to_pylist()
    if rows[0]["key"] < 0:
        got = [{n: r.get(n) if n in ("batch", "key", "ids", "sizes", "signatures", "kept", "kept_places") else None for n in names} for r in rows]
    else:
        part = lambda r, c: np.frombuffer(r[c], np.uint32)
        every = np.concatenate([part(r, c) for r in rows for c in ("tokens", "often")])
        weight = np.concatenate([w for r in rows for w in (np.ones(len(r["tokens"]) // 4), part(r, "often_n"))])
        distinct, back = np.unique(every, return_inverse=True)
        count = np.minimum(np.bincount(back, weights=weight, minlength=len(distinct)), 65535).astype(np.uint16)
        at, got = 0, []
        for r in rows:
            n, m = len(r["tokens"]) // 4, len(r["often"]) // 4
            c, o = count[back[at : at + n]], count[back[at + n : at + n + m]]
            at += n + m
            shared = c > 1
            if shared.any() or m:
                got.append({"batch": r["batch"], "key": r["key"], "places": np.frombuffer(r["places"], np.uint16)[shared].tobytes(), "tokens": part(r, "tokens")[shared].tobytes(), "counts": c[shared].tobytes(), "often": r["often"], "often_counts": o.tobytes()})
    ids = table.schema.field("ids").type
    kinds = {"batch": pa.int64(), "key": pa.int64(), "ids": ids}
    return pa.Table.from_arrays([pa.array([g.get(n) for g in got], kinds.get(n, pa.binary())) for n in names], names=names)


SETS = "doc_id {id}, n long, single long, signature binary, prefix_a binary, prefix_b binary, prefix_c binary, picks binary"


def prefixes(percent: int):
    """Step two, for the documents of a batch: prefixes under three orders; null where a token of frequency 1 or fewer tokens than needed settle that there is no link.

    ``single`` counts the tokens of frequency 1, which stand before the prefix. ``picks`` are two of the prefix's very frequent
    tokens, least by two hashes, so that sets which share most tokens pick alike.

    The orders: by frequency, then token; by frequency, then mixed bits of the token; by frequency's
    power of two, then other mixed bits.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs = [r for r in rows if r["key"] < 0]
        names = [x.split()[0] for x in SETS.split(", ")]
        id_type = table.schema.field("ids").type.value_type
        kinds = (id_type, pa.int64(), pa.int64(), *[pa.binary()] * 5)
        if not docs:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        doc, rest = docs[0], [r for r in rows if r["key"] >= 0]
        wide = lambda r, c: np.frombuffer(r[c], np.uint32).astype(np.uint64) | np.uint64(r["key"] << 32)
        cat = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
        often = cat([wide(r, "often") for r in rest], np.uint64)
        often_counts = cat([np.frombuffer(r["often_counts"], np.uint16) for r in rest], np.uint16)
        by = np.argsort(often, kind="stable")
        kept = np.frombuffer(doc["kept"], np.uint64)
        kept_counts = often_counts[by][np.searchsorted(often[by], kept)] if len(kept) else np.zeros(0, np.uint16)
        places = cat([*(np.frombuffer(r["places"], np.uint16) for r in rest), np.frombuffer(doc["kept_places"], np.uint16)], np.uint16)
        tokens = cat([*(wide(r, "tokens") for r in rest), kept], np.uint64)
        counts = cat([*(np.frombuffer(r["counts"], np.uint16) for r in rest), kept_counts], np.uint16)
        sizes, distinct = np.frombuffer(doc["sizes"], np.uint32).astype(np.int64).reshape(2, -1)
        shared = np.bincount(places, minlength=len(sizes))
        need = sizes - (percent * sizes + 99) // 100 + 1 - (distinct - shared)  # prefix tokens left after those of frequency 1; what merged shortens the set and the overlap alike
        live = (need > 0)[places]
        places, tokens, counts = places[live], tokens[live], counts[live]
        mixed, other = _rest(tokens), _rest(tokens ^ np.uint64(0x5555555555))
        begin = np.r_[0, np.cumsum(np.bincount(places, minlength=len(sizes)))]
        by = [np.lexsort(keys) for keys in ((tokens, counts, places), (tokens, mixed, counts, places), (tokens, other, np.frexp(counts)[1], places))]
        live = [i for i in range(len(sizes)) if need[i] > 0 and sizes[i]]
        cols = [dict.fromkeys(live, b"") for _ in range(4)]
        for k, order in enumerate(by):
            ordered = tokens[order]
            for i in live:
                cols[k][i] = ordered[begin[i] : begin[i] + need[i]].tobytes()
        ordered, frequent = tokens[by[0]], counts[by[0]] >= SMALL
        for i in live:
            t = ordered[begin[i] : begin[i] + need[i]][frequent[begin[i] : begin[i] + need[i]]]
            if len(t):
                cols[3][i] = np.unique([t[np.argmin(_rest(t ^ np.uint64(salt)))] for salt in (3, 0xABCDEF)]).tobytes()
        signatures = [doc["signatures"][16 * i : 16 * i + 16] for i in range(len(sizes))]
        rows = (doc["ids"], sizes, distinct - shared, signatures, *([c.get(i) for i in range(len(sizes))] for c in cols))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    return run


def document_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, signature and the prefixes of every row of documents, written."""
    doc_type = dict(docs.dtypes)["doc_id"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(24, max(6, math.ceil(math.log2(4 * parts))))
    ids = f"array<{doc_type}>"
    packed = docs.select("doc_id", "text").mapInArrow(pack(width, bits, doc_type), PACKED.format(id=ids))
    counted = packed.groupBy("key").applyInArrow(count_bucket, COUNTED.format(id=ids))
    return materialise(counted.groupBy("batch").applyInArrow(prefixes(percent), SETS.format(id=doc_type)), "ngram-sets")


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def _numbers(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def share(a: list[set], b: list[set]) -> bool:
    """Do both have a prefix token in common under every order?"""
    return not any(x.isdisjoint(y) for x, y in zip(a, b))


def settle(percent: int):
    """Step four, small clusters: exact components of the classes of one cluster."""

    def run(table: pa.Table) -> pa.Table:
        rows = list({r["signature"]: r for r in table.to_pylist()}.values())
        sets, union, index = [_numbers(r["tokens"]) for r in rows], Union(len(rows)), {}
        prefix = [[set(_numbers(r[f"prefix_{o}"]).tolist()) for o in "abc"] for r in rows]
        for i in range(len(rows)):
            tried = set()
            for token in prefix[i][0]:
                for j in index.setdefault(token, []):
                    if j not in tried and union.find(i) != union.find(j):
                        tried.add(j)
                        if share(prefix[i], prefix[j]) and linked(sets[i], sets[j], percent):
                            union.join(i, j)
                index[token].append(i)
        return pa.table({"a": pa.array([r["signature"] for r in rows], pa.binary()), "b": pa.array([rows[union.find(i)]["signature"] for i in range(len(rows))], pa.binary())})

    return run


def verify(percent: int):
    """Step four, pairs: keep those that link."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "tokens_a"):
                keep = []
                cols = [part.column(f"{c}_{s}").to_pylist() for s in "ab" for c in ("tokens", "prefix_b", "prefix_c")]
                for ta, ba, ca, tb, bb, cb in zip(*cols):
                    near = len(np.intersect1d(_numbers(ba), _numbers(bb))) and len(np.intersect1d(_numbers(ca), _numbers(cb)))
                    keep.append(bool(near) and linked(_numbers(ta), _numbers(tb), percent))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda s: sets.select(F.col("signature").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "tokens", "prefix_b", "prefix_c")))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return materialise(joined.drop("n_a", "n_b").mapInArrow(verify(percent), "a binary, b binary"), "ngram-links")


def _eights(blob: str):
    """The 8-byte pieces of a binary column, as an array."""
    size = F.floor(F.length(blob) / 8).cast("int")
    at = F.filter(F.sequence(F.lit(0), size), lambda i: i < size)
    return F.transform(at, lambda i: F.substring(F.col(blob), i * 8 + 1, F.lit(8)))


def pivot_pairs(classes: DataFrame, draw: int) -> DataFrame:
    """(a, b): each class with the pivot of each of its picks, unless both are one node already.

    The pivot is a class with few tokens of its own, as a copy with few changes is near to more of its group; later
    rounds take the number less exactly and so draw others, by a hash.
    """
    held = classes.select("signature", "node", "single", F.explode(_eights("picks")).alias("token"))
    first = held.groupBy("token").agg(F.min(F.struct(F.floor(F.col("single") / (4 * draw + 1)), F.xxhash64(F.lit(draw), "signature"), "signature", "node")).alias("p"))
    near = held.join(first, "token").filter(F.col("node") != F.col("p.node"))
    return near.select(F.least("signature", F.col("p.signature")).alias("a"), F.greatest("signature", F.col("p.signature")).alias("b")).distinct()


def with_nodes(classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return classes.withColumn("node", F.col("signature"))
    return classes.drop("node").join(roots.withColumnRenamed("root", "_root"), classes["signature"] == roots["node"], "left").drop("node").withColumn("node", F.coalesce("_root", "signature")).drop("_root")


def fetch_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """signature, n, tokens and prefixes of every class, made from the text of its least document; written."""
    ids = classes.select(F.col("doc_id").alias("_id"), F.col("signature").alias("_want"))
    if classes.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("_want", "text")

    def remake(batches):
        memo = word_memo()
        for batch in batches:
            for part in slices(batch, "text"):
                got = [(w, s) for w, t in zip(part.column("_want").to_pylist(), as_bytes(part, "text")) if signature(s := shingle_set(t, width, memo)) == w]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary())], ["signature", "tokens"])

    made = texts.mapInArrow(remake, "signature binary, tokens binary")
    return materialise(made.join(classes.select("signature", "n", "prefix_a", "prefix_b", "prefix_c"), "signature"), "ngram-full")


def class_links(docs: DataFrame, sets: DataFrame, width: int, percent: int, pivot_rounds: int = 3) -> DataFrame:
    """(a, b): links between classes that connect what all links connect."""
    alive = sets.filter(F.col("prefix_a").isNotNull() & (F.col("n") > 0))
    same = ("n", "single", "prefix_a", "prefix_b", "prefix_c", "picks")
    classes = materialise(alive.groupBy("signature").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in same)), "ngram-classes")
    full = fetch_sets(docs, classes, width)
    links, roots = None, None
    for draw in range(pivot_rounds):
        pairs = pivot_pairs(with_nodes(classes.filter(F.length("picks") > 0), roots), draw)
        got = verified(pairs, full, percent)
        links = got if links is None else materialise(links.unionByName(got), "ngram-found")
        roots = components(links)
    nodes = materialise(with_nodes(classes.select("signature", "n", "single", "prefix_a"), roots), "ngram-nodes")
    shared = nodes.select("node", F.explode(_eights("prefix_a")).alias("token")).distinct()
    pivots = shared.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("_z")).filter("a <> _z").select("token", "a")
    clusters = components(shared.join(pivots, "token").select("a", F.col("node").alias("b")).filter("a <> b").distinct())
    placed = nodes.join(clusters.select("node", F.col("root").alias("cluster")), "node")
    sizes = placed.groupBy("cluster", "node").agg(F.count("*").alias("_n")).groupBy("cluster").agg(F.sum("_n").alias("_classes"), F.max(F.struct("_n", "node"))["node"].alias("_largest"))
    placed = materialise(placed.join(sizes, "cluster"), "ngram-placed")
    small = placed.filter(F.col("_classes") <= SMALL).select("signature", "cluster").join(full, "signature")
    settled = small.select("cluster", "signature", "tokens", "prefix_a", "prefix_b", "prefix_c").groupBy("cluster").applyInArrow(settle(percent), "a binary, b binary").filter("a <> b")
    large = placed.filter(F.col("_classes") > SMALL)
    return links.unionByName(settled).unionByName(verified(cross_pairs(large, percent), full, percent))


def cross_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes of different nodes of a cluster that may link, at least one of them outside the cluster's largest node.

    If two sets link, then at their first common token the tokens after it still suffice for the overlap they
    need. A pair is kept if that holds for any common prefix token.
    """
    at = lambda s: F.posexplode(_eights("prefix_a")).alias(f"at_{s}", "token")
    side = lambda df, s: df.select(F.col("signature").alias(s), F.col("node").alias(f"node_{s}"), F.col("n").alias(f"n_{s}"), F.col("single").alias(f"single_{s}"), at(s)).withColumn(f"left_{s}", F.expr(f"n_{s} - single_{s} - at_{s}")).drop(f"single_{s}", f"at_{s}")
    odd, every = side(placed.filter("node <> _largest"), "a"), side(placed, "b")
    enough = F.least("left_a", "left_b") * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = odd.join(every, (odd["token"] == every["token"]) & (F.col("node_a") != F.col("node_b")) & enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_documents(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of documents.

    ``component_id`` is the least doc_id that links reach. Null and empty texts have no shingles and link with nothing: their component is
    their own id. Null ids take part in links but never name a component, unless it has no other. Repeated rows link by their text like any others.
    """
    sets = document_sets(docs, width, percent)
    with scratch(docs.sparkSession):
        roots = components(class_links(docs, sets, width, percent))
        classes = sets.filter("n > 0").groupBy("signature").agg(F.min("doc_id").alias("_rep"))
        named = classes.join(roots, classes["signature"] == roots["node"], "left").select("signature", "_rep", F.coalesce("root", "signature").alias("_root"))
        least = named.groupBy("_root").agg(F.min("_rep").alias("_component"))
        path = shared_dir(docs.sparkSession, "ngram-named")
        named.join(least, "_root").select(F.col("signature").alias("_signature"), "_component").write.parquet(path)
    of = docs.sparkSession.read.parquet(path)
    joined = sets.select("doc_id", "n", "signature").join(of, F.when(F.col("n") > 0, F.col("signature")) == F.col("_signature"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("doc_id")).alias("component_id"))
