"""The scan: one Arrow stage that reads each text once, and relations as native plans on its result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.lex import lex
from ..functions.scan_text import scan_text
from ..operators import identity, relations
from ..options import ScanOptions
from ..schemas import SCANNED, TOKENS
from ..sources.corpus import read_corpus


#: Tokens after which a batch is handed on.
TOKENS_HELD = 50_000


def scanned(corpus: DataFrame, options: ScanOptions) -> DataFrame:
    """path, encoding and what scan_text finds, one row for each text. No shuffle; rows go to Python in small batches."""
    schema = f"path string, encoding string, {SCANNED}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for path, text, encoding in zip(*(batch.column(c).to_pylist() for c in ("path", "text", "encoding")), strict=True):
                out.append({"path": path, "encoding": encoding} | scan_text(text or "", options))
                held += out[-1]["n_tokens"]
                if held >= TOKENS_HELD or len(out) == 256:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, arrow)

    return corpus.select("path", "text", "encoding").mapInArrow(run, schema)


def tokens(corpus: DataFrame) -> DataFrame:
    """path, tokens, errors."""
    schema = f"path string, {TOKENS}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                toks, errs = lex(t or "")
                rows.append({"path": p, "tokens": [x._asdict() for x in toks], "errors": [x._asdict() for x in errs]})
                held += len(toks)
                if held >= TOKENS_HELD:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return corpus.select("path", "text").mapInArrow(run, schema)


@dataclass
class Scan:
    """Relations of a scanned corpus. persist() once if several are wanted: all come from one pass over the texts."""

    rows: DataFrame
    options: ScanOptions

    def persist(self) -> Scan:
        self.rows = self.rows.persist()
        return self

    def _exploded(self, column: str) -> DataFrame:
        return self.rows.select("path", "encoding", F.explode(column).alias("r")).select(F.col("path").alias("file"), "encoding", "r.*")

    def findings(self) -> DataFrame:
        return self._exploded("findings")

    def tables(self) -> DataFrame:
        return self._exploded("tables").drop("encoding")

    def columns(self) -> DataFrame:
        return self._exploded("columns").drop("encoding")

    def functions(self) -> DataFrame:
        return self._exploded("functions").drop("encoding")

    def edges(self) -> DataFrame:
        return self._exploded("edges").drop("encoding")

    def rollup(self) -> DataFrame:
        return relations.rollup(self.edges())

    def identities(self) -> DataFrame:
        return identity.rows(self._exploded("identities").drop("encoding"), self.options.identity_granularity)

    def clusters(self, most: int | None = 10) -> DataFrame:
        return identity.clusters(self.identities(), most)

    def similarity(self, threshold: float = 0.5) -> DataFrame:
        return identity.similarity(self.identities(), threshold)

    def name_counts(self) -> DataFrame:
        return self.rows.select(F.explode("names").alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word")

    def bad_files(self) -> DataFrame:
        return self.rows.where("bad IS NOT NULL").select("path", "bad.*", F.lit("").alias("quarantined_file"))

    def blocks(self) -> DataFrame:
        return self.rows.select("path", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("n", "text"))

    def stats(self) -> DataFrame:
        """n_partial: statements that were not read to their end (max_chunk_iterations)."""
        return self.rows.select("path", "n_chunks", "n_tokens", "n_partial", F.size("blocks").alias("select_block_count"))


def scan_table(corpus: DataFrame, options: ScanOptions = ScanOptions()) -> Scan:
    """corpus: path, text, encoding (sources.corpus.from_table makes one of any table)."""
    return Scan(scanned(corpus, options), options)


def scan(spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), exclude: DataFrame | tuple[str, ...] = ()) -> Scan:
    """Scans the files below a folder."""
    return scan_table(read_corpus(spark, root, options, exclude), options)
