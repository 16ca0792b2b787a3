"""Cells, tables and reports of a scan's results. What is written to one file is sorted and small, or streamed row by row."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP, DETAIL, VALUES = 10, 15, 10


def clean(c: Column) -> Column:
    """Tabs and line ends become spaces."""
    return F.translate(c, "\t\r\n", "   ")


def markdown(c: Column) -> Column:
    """Safe in a table cell: no line ends, bars escaped, backticks as quotes."""
    return F.replace(F.replace(F.translate(c, "\t\r\n", "   "), F.lit("|"), F.lit("\\|")), F.lit("`"), F.lit("'"))


def shown_values(values: Column, most: int = VALUES) -> Column:
    more = F.size(values) - most
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more, F.lit(" more...)"))).otherwise(""))


def first_per_file(rows: DataFrame, most: int = DETAIL) -> DataFrame:
    """The first rows of each file by line."""
    w = Window.partitionBy("file").orderBy("line")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def as_cells(df: DataFrame) -> DataFrame:
    """All columns as clean strings: lists joined by "; ", booleans as True and False, nulls empty."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        s = F.array_join(c, "; ") if kind.startswith("array") else F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string")
        out.append(clean(F.coalesce(s, F.lit(""))).alias(f.name))
    return df.select(*out)


def write_tsv(df: DataFrame, path: str, order: Sequence[str] = ()) -> int:
    """One file with a byte order mark and a header, rows sorted; fetched partition by partition. Returns the rows."""
    cells = as_cells(df.orderBy(*order) if order else df)
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="\n") as f:
        f.write("\t".join(df.columns) + "\n")
        for row in cells.toLocalIterator():
            f.write("\t".join(row) + "\n")
            n += 1
    return n


def write_tsv_folder(df: DataFrame, path: str) -> None:
    """Parts of a large table, written by the executors."""
    as_cells(df).write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def findings_table(findings: DataFrame) -> DataFrame:
    file = F.col("file")
    return findings.select("severity", "in_comment", F.regexp_extract(file, "^(.*)/", 1).alias("directory"), F.regexp_extract(file, "([^/]*)$", 1).alias("file_name"), "line", "column_name", "operator", "value", "snippet")


def write_strings(counts: DataFrame, path: str) -> None:
    """Name candidates with their counts; most frequent first."""
    head = ["# Quoted names that no list has.", "# Move a name to known_names.txt to report it,", "# or to stopwords.txt to ignore it.", "#"]
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("\n".join(head) + "\n")
        for word, n in counts.select("word", "n").toLocalIterator():
            f.write(f"{word}   # {n} occurrence(s)\n")


def create_list(path: str, title: str) -> bool:
    """An empty list file with a title, if there is none."""
    if os.path.exists(path):
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# {title}, one a line\n")
    return True


def totals(findings: DataFrame) -> DataFrame:
    """Findings of each file, and of all (file null)."""
    return findings.rollup("file").agg(F.count("*").alias("findings"))


def _table(title: str, df: DataFrame, most: int = TOP) -> list[str]:
    """A section with at most `most` rows, and how many more there are."""
    rows = df.limit(most).select(*[markdown(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns]).collect()
    out = [f"## {title}", ""]
    if not rows:
        return [*out, "None.", ""]
    out += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)] + ["| " + " | ".join(r) + " |" for r in rows]
    more = df.count() - len(rows)
    return [*out, *([f"... and {more} more."] if more > 0 else []), ""]


def write_summary(scan, path: str, info: dict[str, str], similarity: DataFrame | None = None) -> None:
    """summary.md: run, identities, relations, functions, references, strings, bad files, lists, blocks, findings."""
    o, parts = scan.options, ["# Summary", "", "## Run", ""] + [f"- {k}: {v}" for k, v in info.items()] + [""]
    if o.extract_query_identity:
        ids = scan.clusters(None)
        n, of = ids.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        parts += [*_table("Query Identity", ids), f"{of} statements have {n} identities.", ""]
        if similarity is not None:
            parts += _table("Query Similarity", similarity.select("core_id_a", "core_id_b", "similarity", "shared_facts"))
    if o.extract_relations:
        parts += _table("Relations", scan.rollup().withColumn("predicates", shown_values(F.col("predicates"))))
    if o.extract_functions:
        parts += _table("Functions", scan.functions().groupBy("function").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "function"))
    if o.extract_table_refs:
        parts += _table("Table References", scan.tables().groupBy("schema", "table").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "schema", "table"))
    if o.extract_column_refs:
        parts += _table("Column References", scan.columns().groupBy("schema", "table", "column").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "schema", "table", "column"))
    parts += _table("String Occurrences", scan.name_counts())
    parts += _table("Bad Files", scan.bad_files().select("path", "category", "item", "message").orderBy("path"))
    parts += ["## Stopwords", "", str(len(o.stopwords)), "", "## Known Names", "", str(len(o.known_names)), ""]
    if o.split_selects:
        blocks = scan.stats().where("select_block_count > 0").select("path", "select_block_count")
        total, split = blocks.agg(F.coalesce(F.sum("select_block_count"), F.lit(0)), F.count(F.when(F.col("select_block_count") > 1, 1))).first()
        parts += [*_table("Select Blocks", blocks.orderBy("path")), f"{total} blocks in all; {split} files have several.", ""]
    found = scan.findings()
    parts += _table("Sensitive Findings", totals(found).orderBy(F.col("file").isNotNull(), F.desc("findings"), "file"), DETAIL)
    detail = first_per_file(found.groupBy("file", "line", "column_name", "operator").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_offset", "value"))), lambda x: x["value"]).alias("v")))
    parts += _table("Details", detail.select("file", "line", "column_name", "operator", shown_values(F.col("v")).alias("values")).orderBy("file", "line"), 10 * DETAIL)
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("\n".join(parts))
