"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python call handles at a time; Arrow batches are re-cut to this.
SLICE_BYTES = 4 << 20
#: A key of more rows than this, and than the HOT_KEYS-th part of all rows, is hot: there are fewer than HOT_KEYS such keys.
HOT_ROWS, HOT_KEYS = 512, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written and not yet removed, by application.
_FOLDERS: dict[str, list[str]] = {}
_LOCAL_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir. Where that is unset, a local master gets a
    temporary folder that goes when Python ends (the session's settings stay as they are); any other master is refused."""
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL_ROOTS.get(app)
        if root is None:
            folder = tempfile.mkdtemp(prefix="sqlquarry-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            root = _LOCAL_ROOTS[app] = "file://" + folder
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    _FOLDERS.setdefault(app, []).append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again: cuts lineage and survives lost executors. The folder stays until
    removed() or release()."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def removed(spark: SparkSession, *frames: DataFrame) -> None:
    """Drops folders made by written() that are read no more."""
    folders = _FOLDERS.get(spark.sparkContext.applicationId, [])
    for df in frames:
        own = {f.rstrip("/").rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()[:1]}
        for path in [x for x in folders if x.rpartition("/")[2] in own]:
            _delete(spark, path)
            folders.remove(path)


def mark(spark: SparkSession) -> int:
    """How many folders there are: what release() takes to spare them."""
    return len(_FOLDERS.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, but: Sequence[DataFrame] = ()) -> None:
    """Drops the folders that operators of this application have written (since a mark), when their results have been used;
    those of the frames in `but` stay."""
    folders = _FOLDERS.get(spark.sparkContext.applicationId, [])
    kept = {f.rstrip("/").rpartition("/")[0].rpartition("/")[2] for df in but for f in df.inputFiles()}
    for path in folders[since:]:
        if path.rpartition("/")[2] not in kept:
            _delete(spark, path)
            folders.remove(path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about limit bytes of the given string column; a longer row is a piece of its own."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def give_back() -> None:
    """Returns freed memory to the system, as a worker that idles holds it beside the others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow, with its memory given back at the end of each task."""

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return cleaned


def map_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, limit: int = SLICE_BYTES):
    """fn over slices of each Arrow batch, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield fn(part)
            give_back()

    return tidy(run)


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (of a few numbers each), else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def salted_join(rows: DataFrame, values: DataFrame, key: str, counted: DataFrame, most: int = HOT_ROWS) -> DataFrame:
    """rows joined with values (one row for each key, of any size) on key, so that no task gets over about `most` rows of a key.

    A key of more rows gets that many salts, and its value a copy for each. counted: a cheap frame with the key of each row.
    """
    salts = written(counted.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_n")).where("_n > 1"))
    n = F.coalesce("_n", F.lit(1))
    dealt = rows.join(sized(salts), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), n).cast("int")).drop("_n")
    copies = values.join(sized(salts), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def spread_join(rows: DataFrame, classes: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with classes (one row for each key) on key, without the column n of classes: the key's rows, of total in all.

    Hot keys are broadcast, so their rows stay where they are and never meet in one task; the others are shuffled. Both
    sides are read twice, so they should be written tables or cheap.
    """
    many = F.col(n) > max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = F.broadcast(classes.where(many).drop(n)), classes.where(~many).drop(n)
    rest = rows.join(F.broadcast(classes.where(many).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))
