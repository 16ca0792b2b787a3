"""Command line: scans a folder and writes the artifacts to the working folder (python -m sqlquarry.cli ROOT)."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import rewrite, sinks
from .options import GRANULARITIES, ScanOptions
from .plans.scan import Scan, scanned
from .sources import corpus, effects

ARTIFACTS = ("summary.md", "findings.tsv", "strings.txt", "stopwords.txt", "known_names.txt", "bad_files.tsv", "refs_tables.tsv", "refs_columns.tsv", "refs_functions.tsv", "refs_relations.tsv", "refs_query_identity.tsv", "refs_query_similarity.tsv", "split_manifest.tsv", "quarantine_manifest.tsv")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sqlquarry")
    p.add_argument("root")
    p.add_argument("--sensitive-columns", nargs="+", default=list(ScanOptions().sensitive_columns))
    p.add_argument("--extensions", nargs="+", default=list(ScanOptions().extensions))
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--workers", type=int, default=1, help="tasks at a time")
    p.add_argument("--max-chunk-iterations", type=int, default=ScanOptions().max_chunk_iterations)
    p.add_argument("--extract-metadata", action="store_true")
    p.add_argument("--identity-granularity", choices=GRANULARITIES, default="structure")
    p.add_argument("--query-similarity", action="store_true")
    p.add_argument("--split-selects", action="store_true")
    p.add_argument("--un-split-selects", action="store_true")
    p.add_argument("--mask-literals", action="store_true")
    return p


def wizard(ask=input) -> list[str]:
    """Arguments from answers to questions, in the order of the options; an empty answer keeps the default."""
    out = [ask("Folder: ").strip()]
    for name, kind in (("sensitive-columns", "list"), ("extensions", "list"), ("verbose", "flag"), ("workers", "value"), ("max-chunk-iterations", "value"), ("extract-metadata", "flag"), ("identity-granularity", "value"), ("query-similarity", "flag"), ("split-selects", "flag"), ("un-split-selects", "flag"), ("mask-literals", "flag")):
        answer = ask(f"{name}{' (y/N)' if kind == 'flag' else ''}: ").strip()
        if kind == "flag" and answer.lower() in ("y", "yes"):
            out.append(f"--{name}")
        elif kind != "flag" and answer:
            out += [f"--{name}", *(answer.replace(",", " ").split() if kind == "list" else [answer])]
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, out: str = ".") -> int:
    """Exit code: 1 if there are findings, 0 if not, 2 for wrong arguments."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv:
        try:
            argv = wizard()
        except EOFError:
            return 2
    p = parser()
    a = p.parse_args(argv)
    if a.query_similarity and not a.extract_metadata:
        p.error("--query-similarity needs --extract-metadata")
    if a.identity_granularity != "structure" and not a.extract_metadata:
        p.error("--identity-granularity needs --extract-metadata")
    if a.split_selects and a.un_split_selects:
        p.error("--split-selects and --un-split-selects exclude each other")
    if not os.path.isdir(a.root):
        print(f"{a.root} is no folder", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.master(f"local[{a.workers}]").appName("sqlquarry").getOrCreate()
    root, at = "file:" + os.path.abspath(a.root), lambda name: os.path.join(out, name)

    def listed(name: str):
        return corpus.read_word_list(spark, "file:" + os.path.abspath(at(name)))

    on = a.extract_metadata
    options = ScanOptions(tuple(a.sensitive_columns), listed("stopwords.txt"), listed("known_names.txt"), tuple(a.extensions), on, on, on, on, on, a.identity_granularity, a.query_similarity, a.split_selects, a.max_chunk_iterations)
    sinks.create_list(at("stopwords.txt"), "Names to ignore")
    sinks.create_list(at("known_names.txt"), "Names to report")
    previous = corpus.read_bad_files(spark, "file:" + os.path.abspath(at("bad_files.tsv"))).cache() if os.path.exists(at("bad_files.tsv")) else None
    own = ["file:" + os.path.abspath(at(n)) for n in ARTIFACTS]
    if previous is not None:
        previous.count()
    skip = spark.createDataFrame([(x,) for x in own], "path string")
    skip = skip.unionByName(previous.select("path")) if previous is not None else skip
    manifest = None
    if os.path.exists(at("split_manifest.tsv")):
        manifest = corpus.read_split_manifest(spark, "file:" + os.path.abspath(at("split_manifest.tsv")))
    if a.un_split_selects and manifest is not None:
        every = corpus.decoded(corpus.read_files(spark, root).select("path", "content"))
        done, rest = rewrite.unsplit_plan(manifest, every)
        done, rest = done.cache(), rest.cache()
        kept = [r.asDict() for r in rest.collect()]
        effects.restore(done, manifest)
        sinks.write_tsv(spark.createDataFrame(kept, "original_file string, split_file string, block_number int, total_blocks int"), at("split_manifest.tsv"), ("original_file", "block_number"))
    plan = rewrite.quarantine_plan(corpus.read_files(spark, root).select("path"), root, options.suffixes, tuple(own))
    moved = effects.move(plan)
    sinks.write_tsv(spark.createDataFrame(moved, "original_file string, quarantined_file string"), at("quarantine_manifest.tsv"), ("original_file",))
    chosen = corpus.chosen_files(spark, root, options, skip).cache()
    texts = corpus.read_corpus(spark, root, options, skip).cache()
    result = Scan(scanned(texts.repartition(max(1, a.workers)), options), options).persist()
    bad = rewrite.bad_file_plan(result.bad_files().unionByName(corpus.unreadable(chosen, texts)), root).cache()
    bad.count()
    gone = dict(effects.move(bad, "path"))
    rows = [r.asDict() | {"quarantined_file": gone.get(effects.local(r["path"]), "")} for r in bad.collect()]
    new = spark.createDataFrame(rows, "path string, category string, item string, message string, quarantined_file string")
    sinks.write_tsv(rewrite.merged_bad_files(previous, new) if previous is not None else new, at("bad_files.tsv"), ("path",))
    similar = result.similarity().cache() if a.query_similarity else None
    sinks.write_summary(result, at("summary.md"), {"files": str(result.rows.count()), **{k: " ".join(v) if isinstance(v, list) else str(v) for k, v in vars(a).items()}}, similar)
    found = sinks.write_tsv(sinks.findings_table(result.findings()), at("findings.tsv"), ("directory", "file_name", "line"))
    sinks.write_strings(result.name_counts(), at("strings.txt"))
    if on:
        sinks.write_tsv(result.tables().select("schema", "table", "file", "line"), at("refs_tables.tsv"), ("schema", "table", "file", "line"))
        sinks.write_tsv(result.columns().select("schema", "table", "column", "file", "line"), at("refs_columns.tsv"), ("schema", "table", "column", "file", "line"))
        sinks.write_tsv(result.functions().select("function", "parameters", "file", "line"), at("refs_functions.tsv"), ("function", "file", "line"))
        sinks.write_tsv(result.edges().select("table_a_schema", "table_a", "table_b_schema", "table_b", "join_type", "predicate", "file", "line"), at("refs_relations.tsv"), ("file", "line"))
        sinks.write_tsv(result.identities().select("core_id", "file", "line", "table_count", "join_count", "has_cte", "has_subquery", "has_union", "columns", "tables", "join_types", "relations"), at("refs_query_identity.tsv"), ("core_id", "file", "line"))
    if similar is not None:
        sinks.write_tsv(similar, at("refs_query_similarity.tsv"))
    if a.mask_literals:
        effects.write_masked(rewrite.masked(texts.select("path", "text"), result.findings()), texts)
    if a.split_selects:
        parts = rewrite.split_plan(result.blocks()).cache()
        leftovers = rewrite.backup_siblings(corpus.read_files(spark, root).select("path"), parts, options.extensions).cache()
        leftovers.count()
        table = parts.drop("text")
        if manifest is not None:
            table = manifest.unionByName(table)
        table = table.cache()
        table.count()
        effects.write_parts(parts)
        effects.delete(leftovers)
        sinks.write_tsv(table, at("split_manifest.tsv"), ("original_file", "block_number"))
    if a.verbose:
        for r in result.stats().toLocalIterator():
            print(r["path"], r["n_chunks"], r["n_tokens"], f"{r['n_partial']} not read to the end", file=sys.stderr)
    return 1 if found else 0


if __name__ == "__main__":
    sys.exit(main())
