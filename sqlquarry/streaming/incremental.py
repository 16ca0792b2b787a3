"""New files as a stream: each batch is scanned once, and results are added to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..options import ScanOptions
from ..plans.scan import scan_table
from ..sources.corpus import decoded, matching

RELATIONS = ("findings", "tables", "columns", "functions", "edges", "identities", "bad_files")


def stream_files(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """path and content of files as they appear below root."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    return matching(raw, options)


def scan_stream(spark: SparkSession, root: str, out: str, checkpoint: str, options: ScanOptions = ScanOptions(), available_now: bool = True) -> StreamingQuery:
    """Scans files once each; every relation is a folder of Parquet files below out, in a subfolder for each batch.

    A batch that is run again after a failure overwrites its own subfolder, so nothing is counted twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        done = scan_table(decoded(batch), options).persist()
        for name in RELATIONS:
            getattr(done, name)().write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        done.rows.unpersist()

    q = stream_files(spark, root, options).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()
