"""Masking, splitting into SELECT blocks and joining them again, quarantine plans. Nothing here touches files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import SPLIT_NAME, identity_of

NUMBER = r"^[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$|^\.[0-9]+([eE][+-]?[0-9]+)?$"


def mask_of(value: Column) -> Column:
    """'****', \"****\" or 0000; null if the literal can't be masked."""
    q = F.substring(value, 1, 1)
    quoted = q.isin("'", '"') & (F.length(value) >= 2) & F.endswith(value, q)
    return F.when(quoted, F.concat(q, F.lit("****"), q)).when(value.rlike(NUMBER), F.lit("0000"))


def masked(texts: DataFrame, findings: DataFrame) -> DataFrame:
    """texts (path, text) with masked_text, masked_spans (a, b, put) and the numbers of spans masked, overlapping and unmaskable.

    Spans are taken in order; one that starts at or before the last masked one's end is skipped; an unmaskable one is left
    and hides none behind it.
    """
    own = findings.where("start_offset IS NOT NULL").select(F.col("file").alias("path"), F.col("start_offset").alias("a"), F.col("end_offset").alias("b")).distinct()
    spans = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("s"))
    text = F.col("text")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(-1).alias("end"), F.lit(0).alias("m"), F.lit(0).alias("o"), F.lit(0).alias("u"), F.expr("CAST(array() AS array<struct<a:int,b:int,put:string>>)").alias("s"))

    def step(acc: Column, x: Column) -> Column:
        over = x["a"] <= acc["end"]
        put = mask_of(F.substring(text, x["a"] + 1, x["b"] - x["a"] + 1))
        take = ~over & put.isNotNull()
        return F.struct(
            F.when(take, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["a"] - acc["at"]), put)).otherwise(acc["out"]).alias("out"),
            F.when(take, x["b"] + 1).otherwise(acc["at"]).alias("at"), F.when(take, x["b"]).otherwise(acc["end"]).alias("end"),
            (acc["m"] + take.cast("int")).alias("m"), (acc["o"] + over.cast("int")).alias("o"), (acc["u"] + (~over & put.isNull()).cast("int")).alias("u"),
            F.when(take, F.concat(acc["s"], F.array(F.struct(x["a"].alias("a"), x["b"].alias("b"), put.alias("put"))))).otherwise(acc["s"]).alias("s"),
        )

    done = texts.join(spans, "path", "left").withColumn("r", F.aggregate(F.coalesce("s", F.expr("CAST(array() AS array<struct<a:int,b:int>>)")), zero, step))
    whole = F.concat("r.out", F.substring(text, F.col("r.at") + 1, F.length(text)))
    return done.select("path", "text", whole.alias("masked_text"), F.col("r.m").alias("masked"), F.col("r.o").alias("skipped_overlap"), F.col("r.u").alias("skipped_unmaskable"), F.col("r.s").alias("masked_spans"))


def split_plan(blocks: DataFrame) -> DataFrame:
    """original_file, split_file, block_number, total_blocks, text for files of several SELECT blocks that are no parts already."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    width = F.greatest(F.lit(2), F.length(F.col("n_blocks").cast("string")))
    number = F.lpad((F.col("n") + 1).cast("string"), 20, "0")
    stem, ext = F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("path", r"(\.[^./]*)$", 1)
    rows = blocks.where((F.col("n_blocks") > 1) & ~name.rlike(SPLIT_NAME))
    return rows.select(F.col("path").alias("original_file"), F.concat(stem, F.lit("-"), F.right(number, width), ext).alias("split_file"), (F.col("n") + 1).alias("block_number"), F.col("n_blocks").alias("total_blocks"), "text")


def unsplit_plan(manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, text) of originals whose parts are all there and that are gone themselves, and the manifest rows that stay."""
    have = files.select(F.col("path").alias("split_file"), F.col("text"))
    joined = manifest.join(have, "split_file", "left")
    per = joined.groupBy("original_file").agg(F.count("*").alias("rows"), F.max("total_blocks").alias("total"), F.count("text").alias("there"), F.countDistinct("block_number").alias("numbers"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_number", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("text"))
    per = per.join(files.select(F.col("path").alias("original_file"), F.lit(1).alias("present")), "original_file", "left")
    ok = (F.col("rows") == F.col("total")) & (F.col("there") == F.col("total")) & (F.col("numbers") == F.col("total")) & F.col("present").isNull()
    done = per.where(ok).select(F.col("original_file").alias("path"), "text")
    return done, manifest.join(done.select(F.col("path").alias("original_file")), "original_file", "left_anti")


def backup_siblings(files: DataFrame, split: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Files of the same folder and identity as a split file: what a split leaves to delete."""
    d = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    key = lambda df, c: df.withColumns({"_d": d, "_i": identity_of(F.col("path"), extensions)})
    gone = key(split.select(F.col("original_file").alias("path")).distinct(), "path")
    return key(files.select("path"), "path").join(gone.select("_d", "_i"), ["_d", "_i"], "left_semi").join(gone.select("path"), "path", "left_anti").select("path")


def quarantine_plan(files: DataFrame, root: str, suffixes: tuple[str, ...], exclude: tuple[str, ...] = (), folder: str = "_quarantine/excluded") -> DataFrame:
    """original_file, quarantined_file of files without a configured suffix, outside the quarantine."""
    root = root.rstrip("/")
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | F.endswith(F.lower("path"), F.lit(s))
    rows = files.where(~ok & ~F.startswith("path", F.lit(f"{root}/_quarantine/")) & (~F.col("path").isin(*exclude) if exclude else F.lit(True)))
    return rows.select(F.col("path").alias("original_file"), F.concat(F.lit(f"{root}/{folder}/"), F.substring("path", len(root) + 2, 1 << 20)).alias("quarantined_file"))


def bad_file_plan(bad: DataFrame, root: str) -> DataFrame:
    """bad with quarantined_file below the root's quarantine; a path outside the root keeps its name only."""
    root = root.rstrip("/")
    rel = F.when(F.startswith("path", F.lit(root + "/")), F.substring("path", len(root) + 2, 1 << 20)).otherwise(F.regexp_extract("path", r"([^/]*)$", 1))
    return bad.withColumn("quarantined_file", F.concat(F.lit(f"{root}/_quarantine/bad_files/"), rel))


def merged_bad_files(previous: DataFrame, new: DataFrame) -> DataFrame:
    return previous.join(new, "path", "left_anti").unionByName(new).orderBy("path")
