"""Native operators over exploded tokens: statements, runs of punctuation, comment spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamped_depth(df: DataFrame, keys: list[str], order: list[str], step: Column) -> DataFrame:
    """Adds depth: the running sum of step (+1, -1, 0), held at 0 or more: the sum less its running minimum, if that is negative."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_s", F.sum(step).over(w))
    return summed.withColumn("depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def chunked(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Adds depth and chunk_id to exploded tokens (keys, i, type, hidden): a ; at depth 0 ends a statement."""
    step = F.when(F.col("type") == "(", 1).when(F.col("type") == ")", -1).otherwise(0)
    deep = clamped_depth(tokens, keys, ["i"], step)
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return deep.withColumn("chunk_id", F.coalesce(F.sum(((F.col("type") == ";") & (F.col("depth") == 0)).cast("int")).over(before), F.lit(0)))


#: The ASCII punctuation marks, as a class for regular expressions of Java and of RE2.
MARKS = r"[!-/:-@\[-`{-~]"


def longest_run(text: Column) -> Column:
    """Length of the longest run of one punctuation mark; null if the text has none."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"({MARKS})\\1*"), F.lit(0)), F.length))


def exploded(tokens: DataFrame) -> DataFrame:
    """path, i and the fields of each token."""
    return tokens.select("path", F.posexplode("tokens").alias("i", "t")).select("path", "i", "t.*")


def in_comment(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """spans (path, start_offset, ...) with in_comment: Y if a comment of the same text covers the start."""
    c = tokens.select("path", F.filter("tokens", lambda t: t["type"].isin("LINE_COMMENT", "SQL_COMMENT")).alias("_c"))
    hit = F.exists("_c", lambda t: (t["start"] <= F.col("start_offset")) & (F.col("start_offset") <= t["stop"]))
    return spans.join(c, "path", "left").withColumn("in_comment", F.when(hit, "Y").otherwise("N")).drop("_c")
