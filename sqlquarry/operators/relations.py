"""Join edges between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(edges: DataFrame) -> DataFrame:
    """Edges by unordered pair of tables: how many, and their distinct non-empty predicates; most first."""
    a, b = F.struct(F.col("table_a_schema").alias("s"), F.col("table_a").alias("t")), F.struct(F.col("table_b_schema").alias("s"), F.col("table_b").alias("t"))
    keyed = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), "predicate")
    out = keyed.groupBy("x", "y").agg(F.count("*").alias("join_count"), F.array_sort(F.collect_set(F.when(F.col("predicate") != "", F.col("predicate")))).alias("predicates"))
    return out.select(F.col("x.s").alias("table_a_schema"), F.col("x.t").alias("table_a"), F.col("y.s").alias("table_b_schema"), F.col("y.t").alias("table_b"), "join_count", "predicates").orderBy(F.desc("join_count"), "table_a", "table_b", "table_a_schema", "table_b_schema")


def without_implied_duplicates(structural: DataFrame, implied: DataFrame, keys: list[str]) -> DataFrame:
    """Both, but for implied edges between a pair that a structural edge of the same statement (keys) joins."""

    def pair(df: DataFrame) -> DataFrame:
        a, b = F.concat_ws(".", "table_a_schema", "table_a"), F.concat_ws(".", "table_b_schema", "table_b")
        return df.withColumns({"_x": F.least(a, b), "_y": F.greatest(a, b)})

    left = pair(implied).join(pair(structural).select(*keys, "_x", "_y").distinct(), [*keys, "_x", "_y"], "left_anti").drop("_x", "_y")
    return structural.unionByName(left)
