"""Secret scans with corpus-wide ownership frequency.

Spans of three base kinds are found in every text. The hash of each candidate value is then counted over
the corpus by distinct repositories and distinct owners. A value that many of them carry is a widely copied
example; one that a single owner carries, and that looks live, is marked with a further span of kind "live".

Only DataFrame functions are used. A pattern's matches are taken together with the text before each of them,
so lengths alone give positions; texts without a match never leave the first test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# The base kinds in their order, each with its pattern, the group that must reach a length, and that length.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
LIVE = "live"
NOT_LIVE = r"(?i)example|sample|dummy|changeme|placeholder|your|test|x{4}|0{6}|1234"


def _spans(text: Column, number: int) -> Column:
    """Array of (start, kind, end, value, value_start) of one kind; code points from 0, end exclusive."""
    kind, pattern, group, least = KINDS[number]
    both = rf"(?s)(.*?)(?:({pattern})|\z)"
    before, whole = F.regexp_extract_all(text, F.lit(both), F.lit(1)), F.regexp_extract_all(text, F.lit(both), F.lit(2))
    value = F.regexp_extract_all(text, F.lit(both), F.lit(3)) if group else whole
    parts = F.arrays_zip(before.alias("before"), whole.alias("whole"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string,value_start:int>>").alias("spans"))

    def step(state, part):
        begin = state["at"] + F.length(part["before"])
        end = begin + F.length(part["whole"])
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"), part["value"].alias("value"), (end - F.length(part["value"])).alias("value_start"))
        good = (F.length(part["whole"]) > 0) & (F.length(part["value"]) >= least)
        return F.struct(end.alias("at"), F.when(good, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda s: s["spans"])).otherwise(start["spans"])


def _entropy(value: Column) -> Column:
    """Shannon entropy of a value's characters, in bits."""
    chars = F.split(value, "")
    n = F.length(value)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, *_ in KINDS), F.lit(LIVE))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_spans(
    docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), most_owners: int = 1, most_repositories: int = 2, least_length: int = 16, least_entropy: float = 3.0,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied for each row of documents.

    ``spans`` has the base spans and, for each value that at most ``most_owners`` owners and
    ``most_repositories`` repositories carry and that looks live (long enough, rich enough in characters, no
    placeholder), a span of kind "live" over the value. ``n_copied`` counts base spans whose value more owners carry.
    Null owners and parts of repositories count as one more value. Null and empty texts have no spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.array_sort(F.concat(*(_spans(text, k) for k in range(len(KINDS)))))
    place = docs.select("doc_id", F.col(owner).alias("_owner"), F.xxhash64(*repository).alias("_repo"), spans.alias("_base")).withColumn("_row", F.monotonically_increasing_id())
    place = materialise(place, "secrets")  # row numbers are read back from here, never made anew
    value = F.sha2(F.col("_s.value"), 256)
    seen = place.filter(F.size("_base") > 0).select("_row", "_owner", "_repo", F.explode("_base").alias("_s")).withColumn("_value", value)
    pairs = seen.groupBy("_value", F.coalesce(F.xxhash64("_owner"), F.lit(0)).alias("_owner"), "_repo").agg(F.min("_s.value").alias("_text"))
    owners = pairs.groupBy("_value", "_owner").agg(F.count("*").alias("_repos"), F.min("_text").alias("_text"))
    spread = owners.groupBy("_value").agg(F.count("*").alias("_owners"), F.sum("_repos").alias("_repos"), F.min("_text").alias("_text"))
    live = (F.col("_owners") <= most_owners) & (F.col("_repos") <= most_repositories) & (F.length("_text") >= least_length) & ~F.col("_text").rlike(NOT_LIVE)
    judged = spread.select("_value", (F.col("_owners") > most_owners).alias("_copied"), (live & (_entropy(F.col("_text")) >= least_entropy)).alias("_live"))
    marked = seen.join(judged, "_value").groupBy("_row").agg(
        F.collect_set(F.when(F.col("_live"), F.struct(F.col("_s.value_start").alias("start"), F.lit(len(KINDS)).alias("kind"), (F.col("_s.value_start") + F.length("_s.value")).alias("end")))).alias("_more"),
        F.sum(F.col("_copied").cast("long")).alias("n_copied"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    base = F.transform("_base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    every = F.array_sort(F.concat(base, F.coalesce(F.col("_more"), none)))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return place.join(marked, "_row", "left").select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"),
        F.size(F.coalesce(F.col("_more"), none)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
