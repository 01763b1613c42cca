"""Line dedup by content-defined chunks of lines.

Every line begins a chunk and ends one: the shortest run of two lines or more, from that line on or up to
it, that has ``min_chars`` characters. The lines of a chunk alone decide where it ends, so the same lines are
chunked alike wherever they stand, and the chunks inside any repeated passage that is long enough cover each of its
lines, whatever surrounds it. Very long lines are chunks by themselves too. A chunk whose text occurs elsewhere
in the corpus is removed from all but its first place, after its bytes were compared with those of the first place.

Only DataFrame functions are used. Slim joins find the repeated chunks. Texts move only where they may hold a first place, to
fetch it, or a copy, to be cut: bitmaps of the keys of such documents, of a fixed size, are held against all
documents where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bits of a bitmap of keys, 8 MB at most. Of more keys than bits it lets through ever more documents, which then move without need.
KEY_BITS = 1 << 26


def fixed(df: DataFrame, **made: Column) -> DataFrame:
    """Add columns behind a one-row generator, so that the optimizer can't copy their expressions into lambdas that would make them anew for every element."""
    kept = df.columns
    return df.select(*kept, F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items())))).alias("_made")).select(*kept, "_made.*")


def line_chunks(df: DataFrame, long_words: int, min_chars: int) -> DataFrame:
    """Add ``_places``: (first, n) of each chunk, lines counted from 1. Needs ``_lines``."""
    df = fixed(df, _chars=F.transform("_lines", F.length), _long=F.transform("_lines", lambda x: (F.size(F.split(x, " ")) >= long_words) & (F.length(x) >= min_chars)))
    i_of, most = F.sequence(F.lit(1), F.size("_lines")), max(2, min_chars + 1)  # a line break is a character

    def enough(run: Column) -> Column:
        return (run["n"] > 1) & (run["chars"] >= min_chars)

    def longer(run: Column, chars: Column) -> Column:
        return F.when(enough(run), run).otherwise(F.struct((run["n"] + 1).alias("n"), (run["chars"] + 1 + chars).alias("chars")))

    def needed(i: Column, beside: Column, onward: Column) -> Column:
        run = F.aggregate(onward, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("chars")), longer, lambda r: F.when(enough(r), r["n"]).otherwise(0))
        return F.when(F.element_at("_chars", i) + 1 + beside >= min_chars, 2).otherwise(run)

    ahead = F.transform(i_of, lambda i: needed(i, F.get("_chars", i), F.slice("_chars", i, most)))
    behind = F.transform(i_of, lambda i: needed(i, F.get("_chars", i - 2), F.reverse(F.slice("_chars", F.greatest(F.lit(1), i - (most - 1)), F.least(i, F.lit(most))))))
    df = fixed(df, _ahead=ahead, _behind=behind)
    place = lambda first, n: F.struct(first.alias("first"), n.alias("n"))
    begun = F.transform("_ahead", lambda n, i: place(i + 1, n))
    ended = F.filter(F.transform("_behind", lambda n, i: place(i + 2 - n, n)), lambda c: (c["n"] > 0) & (F.get("_ahead", c["first"] - 1) != c["n"]))
    single = F.transform(F.filter(i_of, lambda i: F.element_at("_long", i)), lambda i: place(i, F.lit(1)))
    return fixed(df, _places=F.concat(F.filter(begun, lambda c: c["n"] > 0), ended, single)).drop("_chars", "_long", "_ahead", "_behind")


def _text(lines: Column, at: Column) -> Column:
    return F.array_join(F.slice(lines, at["first"], at["n"]), "\n")


def key_bitmap(keys: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """(bucket, bits): a bitmap of the hashes of ``_key``, a row for each 32,768 bits in use."""
    at = F.pmod("_key", F.lit(bits)) + 1
    return keys.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def marked(rows: DataFrame, bitmap: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """Add ``_may``: may the row's ``_key`` be one of the bitmap's? Its size is bounded, so it is broadcast."""
    at = F.pmod("_key", F.lit(bits)) + 1
    found = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(at) == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.bitmap_bit_position(at) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.getbit(byte, (F.bitmap_bit_position(at) % 8).cast("int")) == 1
    return found.withColumn("_may", F.coalesce(may, F.lit(False))).drop("_bucket", "_bits")


def dedup_lines(docs: DataFrame, long_words: int = 50, min_chars: int = 80) -> DataFrame:
    """All columns of documents, with the repeated chunks cut out of ``text``, then ``n_cut_lines`` (a column of that name in the input is replaced).

    The first place of a chunk is the one with the least (doc_id, hash of the document, line); null ids come
    first. Chunks are at least two lines, or one of ``long_words`` words or more, and ``min_chars`` characters; so every
    run of lines of that size that also stands at an earlier place goes. A place that overlaps the first one is no copy. Rows
    alike in id and text count as one document and get one result. Null texts stay null, texts without a
    repeated chunk stay as they are; a text that is cut whole becomes empty. Other columns may have any names.
    """
    columns = [c for c in docs.columns if c != "n_cut_lines"]
    rows = docs.select(F.xxhash64("doc_id", "text").alias("_key"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"))
    text, split = F.col("_row.text"), lambda c: F.split(c, "\n", -1)
    found = rows.filter(text.isNotNull() & (F.length(text) >= min_chars)).select("_key", F.col("_row.doc_id").alias("_id"), split(text).alias("_split"))
    found = line_chunks(fixed(found, _lines=F.col("_split")).drop("_split"), long_words, min_chars)
    hashed = F.transform("_places", lambda c: F.struct(F.xxhash64(_text(F.col("_lines"), c)).alias("chunk"), c.alias("at")))
    found = found.select("_key", "_id", F.explode(hashed).alias("_c"))
    found = materialise(found.select(F.col("_c.chunk").alias("_chunk"), "_id", "_key", F.col("_c.at.first").alias("_first"), F.col("_c.at.n").alias("_n")), "line-chunks")  # 40 bytes or so for each chunk, no text

    place = F.struct("_id", "_key", "_first", "_n")
    repeated = materialise(found.groupBy("_chunk").agg(F.min(place).alias("_home"), F.count("*").alias("_places")).filter("_places > 1").select("_chunk", "_home"), "line-homes")
    homes = repeated.select(F.col("_home._key").alias("_key"), F.struct("_chunk", "_home").alias("_h")).groupBy("_key").agg(F.collect_list("_h").alias("_homes"))
    holders = marked(rows.select("_key", text.alias("_of")), key_bitmap(repeated.select("_home._key"))).filter("_may").select("_key", "_of")
    bodies = (
        fixed(holders.join(homes, "_key"), _lines=split(F.col("_of"))).select("_lines", F.explode("_homes").alias("_h"))
        .select(F.col("_h._chunk").alias("_chunk"), F.col("_h._home").alias("_home"), _text(F.col("_lines"), {"first": F.col("_h._home._first"), "n": F.col("_h._home._n")}).alias("_body"))
    )
    bodies = materialise(bodies.groupBy("_chunk").agg(F.first("_home").alias("_home"), F.first("_body").alias("_body")), "line-bodies")  # written, so that the next join can split a chunk of very many copies
    apart = (F.col("_key") != F.col("_home._key")) | (F.col("_first") >= F.col("_home._first") + F.col("_home._n"))
    copies = found.join(bodies, "_chunk").filter((place != F.col("_home")) & apart)
    per_doc = materialise(copies.groupBy("_key").agg(F.collect_set(F.struct(F.col("_first").alias("first"), F.col("_n").alias("n"), F.col("_body").alias("body"))).alias("_copies")), "line-copies")

    seen = marked(rows, key_bitmap(per_doc.select("_key")))
    clean = seen.filter(~F.col("_may")).select(*(F.col("_row").getField(c).alias(c) for c in columns), F.lit(0).cast("long").alias("n_cut_lines"))
    joined = seen.filter("_may").join(per_doc, "_key", "left").select("_row", "_copies")
    joined = fixed(joined, _lines=F.when(F.col("_copies").isNotNull(), split(text)))
    same = F.filter("_copies", lambda c: _text(F.col("_lines"), c) == c["body"])  # byte by byte
    cut = F.array_distinct(F.flatten(F.transform(same, lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1))))
    joined = fixed(joined, _cut=cut)
    left = F.array_join(F.filter("_lines", lambda x, i: ~F.array_contains("_cut", i + 1)), "\n")
    n_cut = F.coalesce(F.size(F.coalesce("_cut", F.array().cast("array<int>"))), F.lit(0))
    kept = F.when(n_cut > 0, left).otherwise(text)
    return clean.unionByName(joined.select(*(kept.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in columns), n_cut.cast("long").alias("n_cut_lines")))
