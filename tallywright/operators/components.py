"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.operators.lineage import settle

#: Edges up to which one task solves them; more are solved in rounds of joins. Both give the same roots.
ONE_TASK = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node below its smallest one: larger neighbours, or smaller ones and itself."""
    if large:
        back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(back)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = [x for x in up if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, root for all nodes of edges (a, b) that aren't a root: the smallest node reachable. Edges may repeat or be loops;
    nodes may be of any type that Python orders as Spark does."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    state = settle(pairs)
    if state.count() <= one_task:
        kind = state.schema["a"].dataType.simpleString()
        return state.coalesce(1).mapInArrow(_solve, f"node {kind}, root {kind}")
    mark = None
    while True:
        state = settle(_star(_star(state, True), False))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
