"""Corpora: files of SQL text below a folder, or the rows of any table."""

from __future__ import annotations

import codecs
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..options import ScanOptions
from ..schemas import BAD_FILES, SPLIT_MANIFEST

# In this order, and endings of backup copies.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin-1")
BACKUPS = ("bak", "backup", "bkup", "bk", "old", "orig", "save", "swp", "tmp")
SPLIT_NAME = r"-\d{2,}(\.[^.]+)?$"


def _dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def matching(files: DataFrame, options: ScanOptions = ScanOptions(), exclude: DataFrame | Sequence[str] = (), skip_dirs: Sequence[str] = ()) -> DataFrame:
    """Files (path, ...) with a configured suffix in any case, below no skipped folder, and not excluded (paths, or a table of paths)."""
    ok = F.lit(False)
    for s in options.suffixes:
        ok = ok | F.endswith(F.lower(_name(F.col("path"))), F.lit(s))
    for d in skip_dirs:
        ok = ok & ~F.startswith("path", F.lit(d.rstrip("/") + "/"))
    kept = files.where(ok)
    if isinstance(exclude, DataFrame):
        return kept.join(exclude.select("path"), "path", "left_anti")
    return kept.where(~F.col("path").isin(list(exclude))) if exclude else kept


def without_stale_splits(files: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """Without report-01.sql where report.sql is in the same folder (of all names there, not only matching ones)."""
    every = (siblings if siblings is not None else files).select(_dir(F.col("path")).alias("_d"), _name(F.col("path")).alias("_n")).distinct()
    marked = files.withColumns({"_d": _dir(F.col("path")), "_n": F.regexp_replace(_name(F.col("path")), SPLIT_NAME, "$1")})
    part = F.col("_part")
    marked = marked.withColumn("_part", _name(F.col("path")).rlike(SPLIT_NAME))
    stale = marked.where(part).join(every, ["_d", "_n"], "left_semi").select("path")
    return files.join(stale, "path", "left_anti")


def identity_of(path: Column, extensions: Sequence[str]) -> Column:
    """The lower-cased name without trailing known and backup endings."""
    ends = "|".join(sorted({e.lower().lstrip(".") for e in extensions} | {*BACKUPS}))
    return F.regexp_replace(F.lower(_name(path)), rf"(?<=.)(\.({ends}))+$", "")


def deduped(files: DataFrame, extensions: Sequence[str] = ScanOptions().extensions) -> DataFrame:
    """One file of each folder and name identity: no backup before a backup, then the shorter name, then the lesser."""
    ends = "|".join(BACKUPS)
    w = Window.partitionBy(_dir(F.col("path")), identity_of(F.col("path"), extensions)).orderBy(F.lower("path").rlike(rf"\.({ends})$"), F.length("path"), "path")
    return files.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def decode(content: bytes) -> tuple[str, str]:
    """Text with line feeds for line ends, and the first encoding that fits."""
    for enc in ENCODINGS:
        try:
            return content.decode(enc).replace("\r\n", "\n").replace("\r", "\n"), enc
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace"), "utf-8(replace)"


def decoded(files: DataFrame) -> DataFrame:
    """path, text, encoding of files with content: valid UTF-8 stays in the JVM; only the rest goes through Python."""
    bom = codecs.BOM_UTF8.decode()
    ok = files.where(F.expr("is_valid_utf8(cast(content as string))"))
    plain = F.regexp_replace(F.regexp_replace(F.col("content").cast("string"), f"^{bom}", ""), "\r\n?", "\n")
    odd = files.where(~F.expr("is_valid_utf8(cast(content as string))")).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [decode(c) for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([t for t, _ in rows]), pa.array([e for _, e in rows])], names=["path", "text", "encoding"])

    return ok.select("path", plain.alias("text"), F.lit("utf-8-sig").alias("encoding")).unionByName(odd.mapInArrow(run, "path string, text string, encoding string"))


def read_files(spark: SparkSession, root: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """path, modificationTime, length, content of all files below root (with one of the suffixes in any case); content is read
    only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    if suffixes:
        any_case = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
        reader = reader.option("pathGlobFilter", "{" + ",".join("*" + any_case(s) for s in suffixes) + "}")
    return reader.load(root)


#: So many paths are broadcast at most to choose the files to read; with more, contents are shuffled.
MAX_PATHS = 200_000


def chosen_files(spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), exclude: DataFrame | Sequence[str] = (), skip_dirs: Sequence[str] = ("_quarantine",)) -> DataFrame:
    """path of the files to scan, from names alone."""
    names = read_files(spark, root).select("path")
    top = spark._jvm.org.apache.hadoop.fs.Path(root).toString().rstrip("/")
    keep = deduped(without_stale_splits(matching(names, options, exclude), names), options.extensions)
    for d in skip_dirs:
        keep = keep.where(~F.contains("path", F.lit((d if "/" in d else f"{top}/{d}").rstrip("/") + "/")))
    return keep


def read_corpus(spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), exclude: DataFrame | Sequence[str] = (), skip_dirs: Sequence[str] = ("_quarantine",)) -> DataFrame:
    """path, text, encoding of the files to scan. Names are settled first, and only files with a suffix are opened; what can't
    be read is left out (unreadable() has it)."""
    keep = chosen_files(spark, root, options, exclude, skip_dirs)
    files = read_files(spark, root, options.suffixes).select("path", "content")
    return decoded(files.join(F.broadcast(keep) if keep.count() <= MAX_PATHS else keep, "path", "left_semi"))


def unreadable(chosen: DataFrame, read: DataFrame) -> DataFrame:
    """Bad files: chosen paths that no text was read from."""
    row = {"category": "unreadable", "item": "", "message": "the file could not be read", "quarantined_file": ""}
    return chosen.join(read.select("path"), "path", "left_anti").select("path", *[F.lit(v).alias(k) for k, v in row.items()])


def from_table(df: DataFrame, path: str, text: str) -> DataFrame:
    """Any table of texts as a corpus."""
    return df.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"), F.lit("utf-8-sig").alias("encoding"))


def word_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """word: trimmed, without what follows #, blank lines dropped, distinct."""
    word = F.trim(F.regexp_extract(column, "^\ufeff?([^#]*)", 1))
    return lines.select(word.alias("word")).where("word <> ''").distinct()


def read_word_list(spark: SparkSession, path: str) -> frozenset[str]:
    """The words of a small list file, none if there is no file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return frozenset()
    return frozenset(r[0] for r in word_list(spark.read.text(path)).collect())


def read_bad_files(spark: SparkSession, path: str) -> DataFrame:
    """Earlier bad files; missing columns are empty."""
    df = spark.read.csv(path, sep="\t", header=True, schema=BAD_FILES, mode="PERMISSIVE")
    return df.na.fill("").withColumn("path", F.regexp_replace("path", "^﻿", ""))


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a split manifest whose numbers are numbers."""
    df = spark.read.csv(path, sep="\t", header=True, schema=SPLIT_MANIFEST, mode="PERMISSIVE")
    n = {c: F.expr(f"try_cast({c} AS int)") for c in ("block_number", "total_blocks")}
    return df.withColumns(n).where("block_number IS NOT NULL AND total_blocks IS NOT NULL")
