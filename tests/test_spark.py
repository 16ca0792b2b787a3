"""Relations, sources, sinks, plans and the command line on small corpora."""

import os

import pytest
from pyspark.sql import functions as F

from sqlquarry import ScanOptions, scan, scan_table
from sqlquarry.operators import identity, rewrite, sinks
from sqlquarry.operators import tokens as token_ops
from sqlquarry.plans.scan import tokens
from sqlquarry.sources import corpus


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, *texts):
    return spark.createDataFrame([(f"/c/{i}.sql", t, "utf-8-sig") for i, t in enumerate(texts)], "path string, text string, encoding string")


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_native_chunks_match_the_stage(spark):
    texts = ["SELECT 1;", ")) ( ; ) ; SELECT 1", "-- x\nSELECT 1; SELECT (1; 2); \n", "", None]
    df = table(spark, *texts)
    native = {r[0]: r[1] for r in token_ops.chunked(token_ops.exploded(tokens(df)), ["path"]).groupBy("path").agg(F.max("chunk_id") + 1).collect()}
    staged = {r["path"]: r["n_chunks"] for r in scan_table(df).stats().collect() if r["n_chunks"]}
    assert native == staged


def test_rollup_similarity_and_clusters(spark):
    df = table(spark, "SELECT 1 FROM A X JOIN B Y ON X.K = Y.K", "SELECT 1 FROM B Y JOIN A X ON X.K = Y.K", "SELECT 1 FROM A X LEFT JOIN B Y ON X.K = Y.K", "SELECT 1 FROM Z")
    s = scan_table(df, ScanOptions.metadata())
    assert [(r["table_a"], r["table_b"], r["join_count"], r["predicates"]) for r in s.rollup().collect()] == [("A", "B", 3, ["X.K = Y.K"])]
    assert [r["n"] for r in s.clusters().collect()] == [2, 1, 1]
    (pair,) = s.similarity(0.5).collect()
    assert pair["similarity"] == 0.667 and sorted(pair["only_in_a"] + pair["only_in_b"]) == ["join-type INNER=1", "join-type LEFT=1"]
    with pytest.raises(ValueError):
        s.similarity(0)


def test_prefix_filter_against_brute_force(spark):
    import random

    random.seed(4)
    sets = {f"s{i}": sorted(random.sample("abcdefghij", random.randint(1, 7))) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id string, facts array<string>")
    for t in (0.3, 0.5, 0.8, 1.0):
        got = {(r["a"], r["b"]) for r in identity.pairs_by_facts(df, t).collect() if r["shared"] / (r["size_a"] + r["size_b"] - r["shared"]) >= t}
        want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= t}
        assert got == want


def written_rows(spark, group):
    """Rows that the jobs of a group wrote for shuffles."""
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(i).shuffleWriteRecords() for i in stages)


def test_pairs_that_are_not_similar_are_not_sent(spark):
    import random

    r = random.Random(5)
    sets = [(i, r.sample(range(40), 4)) for i in range(2000)]
    each = spark.createDataFrame([(i, f) for i, s in sets for f in s], "id long, fact long")
    spark.sparkContext.setJobGroup("pairs", "pairs")
    got = identity.pairs_by_facts(each.groupBy("id").agg(F.collect_set("fact").alias("facts")), 0.6)
    rows_ = {(x["a"], x["b"], x["shared"]) for x in got.collect()}
    spark.sparkContext.setJobGroup("others", "others")
    assert rows_ == {(a, b, n) for a, x in sets for b, y in sets if a < b and (n := len({*x} & {*y})) / (8 - n) >= 0.6}
    assert written_rows(spark, "pairs") < 4 * 8000


@pytest.mark.parametrize("carried", [0, 3, 6])
def test_pairs_of_large_sets(spark, monkeypatch, carried):
    import random

    r = random.Random(carried)
    sets = {i: sorted({min(r.randrange(30), r.randrange(30)) for _ in range(r.randrange(1, 14))}) for i in range(100)}
    monkeypatch.setattr(identity, "CARRIED", carried)
    got = identity.pairs_by_facts(spark.createDataFrame(list(sets.items()), "id int, facts array<int>"), 0.4).collect()
    want = [(a, b, n, x, y) for a, x in sets.items() for b, y in sets.items() if a < b and (n := len({*x} & {*y})) / len({*x} | {*y}) >= 0.4]
    assert sorted((g["a"], g["b"], g["shared"], sorted(g["fa"]), sorted(g["fb"])) for g in got) == sorted(want)


@pytest.mark.parametrize("name", [
    "join_forms",
    "statement_shapes",
    "scope_resolution",
    "nested_comment_rescan",
    "detect_insert_values",
    "comment_texts",
    "token_type_counts",
    "detect_negated",
    "snippets",
    "findings_in_comment_spans",
    "blank_literal_filter",
    "detect_like",
    "name_candidates",
    "known_name_findings",
    "lexer_error_gate",
    "detect_window_dq",
    "detect_reversed",
])
def test_rows_are_dealt_out_before_python(spark, name):
    """A file of one row group is read by one task: each Python stage needs rows from an exchange."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    cores = spark.sparkContext.defaultParallelism
    assert 0 < plan.count("MapInArrow") == plan.count(f"Repartition {cores}, true")


def test_sources(spark):
    assert rows(corpus.matching(paths(spark, "/d/a.SQL", "/d/b.txt", "/d/c.md", "/d/_q/x.sql"), skip_dirs=["/d/_q"])) == [("/d/a.SQL",), ("/d/b.txt",)]
    assert rows(corpus.deduped(paths(spark, "/d/q.sql", "/d/q.sql.bak", "/d/x.bak", "/d/x.sql", "/e/q.bak"), ("sql", "bak"))) == [("/d/q.sql",), ("/d/x.sql",), ("/e/q.bak",)]
    assert rows(corpus.without_stale_splits(paths(spark, "/d/r.sql", "/d/r-01.sql", "/d/s-01.sql", "/d/s-02.sql"))) == [("/d/r.sql",), ("/d/s-01.sql",), ("/d/s-02.sql",)]
    assert corpus.decode("길동".encode("cp949")) == ("길동", "cp949") and corpus.decode(b"\xef\xbb\xbfa\r\nb") == ("a\nb", "utf-8-sig")
    files = spark.createDataFrame([("a", bytearray(b"\xef\xbb\xbfx\r\ny")), ("b", bytearray("길동".encode("cp949")))], "path string, content binary")
    assert rows(corpus.decoded(files)) == [("a", "x\ny", "utf-8-sig"), ("b", "길동", "cp949")]
    assert rows(corpus.word_list(spark.createDataFrame([("a # b",), (" # c",), ("a",), ("",), ("\ufeff# d",)], "value string"))) == [("a",)]


def test_masking(spark):
    text = "WHERE ACCT_ID IN ('1', '22') AND CTRT_NO = 12.5"
    df = table(spark, text)
    out = rewrite.masked(df, scan_table(df).findings()).first()
    assert (out["masked_text"], out["masked"]) == ("WHERE ACCT_ID IN ('****', '****') AND CTRT_NO = 0000", 3)
    again = table(spark, out["masked_text"])
    assert rewrite.masked(again, scan_table(again).findings()).first()["masked_text"] == out["masked_text"]
    spans = spark.createDataFrame([("/c/0.sql", 0, 4), ("/c/0.sql", 3, 6), ("/c/0.sql", 18, 20), ("/c/0.sql", 20, 22)], "file string, start_offset int, end_offset int")
    r = rewrite.masked(df, spans).first()
    assert (r["masked"], r["skipped_overlap"], r["skipped_unmaskable"]) == (1, 1, 2)


def test_masking_keeps_mixed_line_ends(spark, tmp_path):
    from sqlquarry.sources import effects

    old = b"\xef\xbb\xbfSELECT 1\r\nFROM T\nWHERE ACCT_ID = '12'\rAND CTRT_NO IN ('3',\r\n'45') -- \xea\xb8\xb8\r\n"
    (tmp_path / "m.sql").write_bytes(old)
    texts = corpus.read_corpus(spark, str(tmp_path)).cache()
    assert effects.write_masked(rewrite.masked(texts, scan_table(texts).findings()), texts) == 1
    assert (tmp_path / "m.sql").read_bytes() == old.replace(b"'12'", b"'****'").replace(b"'3'", b"'****'").replace(b"'45'", b"'****'")


def test_files_that_are_chosen_but_not_read(spark, tmp_path):
    (tmp_path / "a.SQL").write_text("SELECT 1")
    (tmp_path / "b.txt").write_text("SELECT 2")
    (tmp_path / "c.md").write_text("no")
    chosen = corpus.chosen_files(spark, str(tmp_path)).cache()
    assert chosen.count() == 2 and corpus.unreadable(chosen, corpus.read_corpus(spark, str(tmp_path))).count() == 0
    got = corpus.unreadable(chosen, corpus.read_corpus(spark, str(tmp_path)).where("path LIKE '%.txt'")).collect()
    assert [(r["path"].rpartition("/")[2], r["category"]) for r in got] == [("a.SQL", "unreadable")]


def test_split_and_unsplit(spark):
    df = table(spark, "SELECT 1 FROM A;\nSELECT 2 FROM B;", "SELECT 1;")
    plan = rewrite.split_plan(scan_table(df).blocks())
    got = rows(plan)
    assert got == [("/c/0.sql", "/c/0-01.sql", 1, 2, "SELECT 1 FROM A;"), ("/c/0.sql", "/c/0-02.sql", 2, 2, "SELECT 2 FROM B;")]
    manifest = plan.drop("text")
    done, rest = rewrite.unsplit_plan(manifest, plan.select(F.col("split_file").alias("path"), "text"))
    assert rows(done) == [("/c/0.sql", "SELECT 1 FROM A;\n\nSELECT 2 FROM B;")] and rest.count() == 0
    done, rest = rewrite.unsplit_plan(manifest, plan.where("block_number = 1").select(F.col("split_file").alias("path"), "text"))
    assert done.count() == 0 and rest.count() == 2


def test_quarantine_and_cells(spark):
    assert rows(rewrite.quarantine_plan(paths(spark, "/r/a.sql", "/r/x/b.md", "/r/_quarantine/excluded/c.md"), "/r", (".sql",))) == [("/r/x/b.md", "/r/_quarantine/excluded/x/b.md")]
    cells = sinks.as_cells(spark.createDataFrame([("a\tb", ["x", "y"], True, None)], "a string, b array<string>, c boolean, d int")).first()
    assert tuple(cells) == ("a b", "x; y", "True", "")


def test_command_line(spark, tmp_path):
    from sqlquarry.cli import main, wizard

    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir(), out.mkdir()
    (root / "a.sql").write_text("SELECT 1 FROM TBACCT A WHERE A.ACCT_ID = '1';\nSELECT 2 FROM TBCTRT;")
    (root / "bad.sql").write_text("==========\n")
    (root / "note.md").write_text("x")
    code = main([str(root), "--extract-metadata", "--query-similarity", "--mask-literals", "--split-selects"], spark, str(out))
    assert code == 1
    lines = (out / "findings.tsv").read_text(encoding="utf-8-sig").splitlines()
    assert lines[0].split("\t")[:4] == ["severity", "in_comment", "directory", "file_name"] and len(lines) == 2
    assert (root / "_quarantine/excluded/note.md").exists() and (root / "_quarantine/bad_files/bad.sql").exists()
    assert {p.name for p in root.glob("*.sql")} == {"a-01.sql", "a-02.sql"}
    summary = (out / "summary.md").read_text(encoding="utf-8-sig")
    titles = [x.removeprefix("## ") for x in summary.splitlines() if x.startswith("## ")]
    assert titles == ["Run", "Query Identity", "Query Similarity", "Relations", "Functions", "Table References", "Column References", "String Occurrences", "Bad Files", "Stopwords", "Known Names", "Select Blocks", "Sensitive Findings", "Details"]
    assert "- max_chunk_iterations: 200000" in summary and "2 statements have 2 identities." in summary and "2 blocks in all; 1 files have several." in summary
    assert (out / "strings.txt").read_text(encoding="utf-8-sig").startswith("#") and (out / "stopwords.txt").exists()
    assert "bad.sql" in (out / "bad_files.tsv").read_text(encoding="utf-8-sig") and len((out / "split_manifest.tsv").read_text(encoding="utf-8-sig").splitlines()) == 3
    assert main([str(tmp_path / "none")], spark, str(out)) == 2
    answers = iter(["r", "", "", "y"] + [""] * 8)
    assert wizard(lambda _: next(answers)) == ["r", "--verbose"]
    with pytest.raises(SystemExit):
        main([str(root), "--query-similarity"], spark, str(out))


def test_stream(spark, tmp_path):
    from sqlquarry.streaming.incremental import scan_stream

    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.sql").write_text(f"SELECT 1 FROM T WHERE ACCT_ID = '{n}'")
        scan_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out/findings")).select("value").collect()) == ["'0'", "'1'"]


def test_folder_and_functions(spark, tmp_path):
    from sqlquarry.functions.udfs import register

    (tmp_path / "a.sql").write_text("SELECT 1 FROM T WHERE ACCT_ID = '1'")
    assert scan(spark, str(tmp_path)).findings().count() == 1
    register(spark)
    assert spark.sql("SELECT size(sql_tokens('SELECT 1')), sql_facts('SELECT 1 FROM T')[0][1], sql_quality('========')").first()[:] == (2, "TBL|(no-schema)|T", "repeated-char-run")


def test_queries_have_sql_and_run(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    from sqlquarry.plans import queries

    assert set(queries.QUERIES) == set(queries.ORACLES)
    assert entry.entry(spark).count() > 0 and queries.QUERIES["findings"](spark, sf).count() > 0
