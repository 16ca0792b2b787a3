"""A training-corpus pipeline: each stage is a function (spark, docs, sf_dir) -> DataFrame that calls one operator of sqlquarry.llm.

Every stage judges rows one by one: null and repeated ids, null texts, repeated rows and empty tables go through like any
other. Columns of documents keep their values, also those named like an operator's own. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlquarry.llm import decontaminate, near_copies, quality, secrets, sentencepiece_codec, simhash
from sqlquarry.llm.common import mark, release, sized, table, written


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns under names that no operator uses, and these by column."""
    names = {c: f"_u{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(u) for c, u in names.items()]), names


def _shown(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(u).alias(c) for c, u in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects; null and empty texts abstain and are judged by the bias alone."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    hidden, names = _hidden(docs)
    return _shown(quality.scored(hidden, model, names["text"]).where(~F.col("rejected")), names)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the row with the smallest id (null ids last; of equal ids one); drops its other rows and no more.

    A group is what pairs connect whose five-word shingles have a Jaccard similarity of 0.8 at least; null and wordless texts
    are one group. Candidates are SimHash links over five-word shingles and pairs that share a banded MinHash key, as 4 of 64
    bits alone miss most edited copies.
    """
    before, (hidden, names) = mark(spark), _hidden(docs)
    rows = written(hidden.withColumn("_row", F.monotonically_increasing_id()))
    text, doc_id = names["text"], names["doc_id"]
    linked = simhash.near_duplicates(rows.select("_row", text), "_row", text, shingle=near_copies.SHINGLE).select(F.col("_row").alias("a"), F.col("component_id").alias("b"))
    groups = near_copies.similar_groups(rows, "_row", text, candidates=linked)
    named = written(rows.select("_row", doc_id).join(groups, "_row"))
    kept = named.groupBy("component").agg(F.min(F.struct(F.col(doc_id).isNull().alias("none"), doc_id, "_row")).alias("first")).select("first._row")
    gone = written(named.join(kept, "_row", "left_anti").select("_row"))
    release(spark, before, but=[rows, gone])
    return _shown(rows.join(sized(gone), "_row", "left_anti"), names)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null and wordless texts hold none."""
    hidden, names = _hidden(docs)
    found = decontaminate.find_contamination(hidden, table(spark, sf_dir, "benchmark"), names["doc_id"], names["text"], keep=True)
    return _shown(found.where(~F.col("contaminated")), names)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the texts; null texts stay null."""
    return secrets.redacted(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled token ids of each document; null and empty texts have none."""
    return sentencepiece_codec.encode_documents(docs).select("doc_id", "token_ids", "n_pieces", "lossless")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: EM, training and sampling are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`, each result written to the shared folder and read again; what a stage
    wrote besides is removed."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = mark(spark)
        docs = written(stage(spark, docs, sf_dir))
        release(spark, before, but=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
