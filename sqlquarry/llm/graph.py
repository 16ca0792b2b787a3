"""Connected components over an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, spread_join, written


#: So many distinct edges are joined by one task in one go; rounds of jobs would take longer.
FEW_EDGES = 10_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], names=["node", "component"])


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """edges (a, b) of one type -> (node, component): the smallest node reachable, for every node with an edge.

    Alternates large-star and small-star steps until nothing changes; each round's edges are written to the shared folder.
    Every step groups by a node but keeps only (node, smallest neighbour) per group, joined back to the edges; that of a hub
    is broadcast, so its neighbours never meet in one task. Up to `few` distinct edges are joined by one task instead. Loops
    and repeated or reversed edges are fine; no edges give no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, n_edges = None, now.count()
    if n_edges <= few:
        kind = now.schema["u"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}")
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        low = written(low.select("u", F.least("u", "m").alias("m"), "n"))
        large = written(spread_join(both.where("v > u"), low, "u", "n", 2 * n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")))
        small_low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, small_low, "u", "n", n_edges).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        new = written(small.unionByName(small_low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        sums = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 32) - 1)))).first()
        removed(edges.sparkSession, now, low, large, small_low)
        now = new
        if tuple(sums) == before:
            break
        before, n_edges = tuple(sums), sums[0]
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
