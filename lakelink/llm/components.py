"""Connected components of a graph of edges.

Up to a checked number of edges one task unites them. Beyond that: alternating stars (large-star, small-star).

Each round is two aggregations and joins over the edges; hot centres are only ever aggregated or joined, never
gathered in one task. Rounds go on until the edges no longer change and are written to the shared folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's larger (or not larger) neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


#: Edges that one task unites at most; more are united by rounds over all tasks.
ONE_TASK = 500_000


def unite(batches):
    """(node, root) from (a, b), for all edges of the task."""
    up: dict = {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], ["node", "root"])


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of the edges (a, b), written; root is the least node of its component. Loops are ignored."""
    edges = materialise(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    kind = dict(edges.dtypes)["a"]
    if edges.count() <= one_task:
        return materialise(edges.coalesce(1).mapInArrow(unite, f"node {kind}, root {kind}"), "components")
    state = None
    for _ in range(most_rounds):
        edges = materialise(_star(_star(edges, True), False), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return materialise(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "components")
