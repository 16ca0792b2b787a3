"""More registered queries: statement forms (one for each customer, by c_custkey % 10), file plans and scalar functions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity, rewrite, sinks
from ..operators import tokens as token_ops
from ..options import ScanOptions
from ..sources import corpus as sources
from .queries import _CALLS, _core, _FACTS, _FINDINGS, ALL, _query, _scan, customers
from .scan import Scan, scan, scan_table, tokens

# ¤ is a quote inside a text, § the customer's key
FORMS = (
    "SELECT 1 FROM T1 A RIGHT JOIN T2 B ON A.K = B.K;",
    "SELECT 1 FROM T1 A FULL OUTER JOIN T2 B ON A.K = B.K;",
    "SELECT 1 FROM T1 A CROSS JOIN T2 B;",
    "SELECT 1 FROM T1 A JOIN T2 B USING (K);",
    "SELECT A.X FROM T1 A WHERE EXISTS (SELECT 1 FROM T2 A WHERE A.Y = 1);",
    "SELECT K FROM T1 UNION SELECT K FROM T2;",
    "SELECT D.K FROM (SELECT K FROM T1) D;",
    "INSERT INTO T3 SELECT K FROM T1;",
    "SELECT B.Y FROM T1 B GROUP BY B.Y HAVING COUNT(B.X) > 5;",
    "SELECT 1 FROM T1 WHERE ACCT_ID NOT IN (¤§¤) AND CTRT_NO NOT BETWEEN ¤§¤ AND ¤§9¤;",
)
_CASE = "CASE c_custkey % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(FORMS)) + " END"
_SPARK_FORM = f"replace(replace({_CASE}, '¤', \"'\"), '§', CAST(c_custkey AS string))"
_FILE = "concat('f', c_custkey, '.sql') AS file"
_K = "c_custkey::VARCHAR"


def _texts(spark: SparkSession, sf_dir: str, expr: str, name: str = "concat('f', c_custkey, '.sql')") -> DataFrame:
    rows = customers(spark, sf_dir).selectExpr(f"{name} AS path", f"{expr} AS text")
    return sources.from_table(rows, "path", "text")


def _forms(spark: SparkSession, sf_dir: str, options: ScanOptions = ALL) -> Scan:
    return scan_table(_texts(spark, sf_dir, _SPARK_FORM), options)


def _values(columns: str, *rows: str) -> str:
    """SQL for the given rows, (form, values...), of each customer with that form."""
    return f"SELECT {_FILE}, v.* EXCLUDE (k) FROM customer, (VALUES {', '.join(f'({r})' for r in rows)}) v(k, {columns}) WHERE c_custkey % 10 = k"


@_query(_values("table_a, table_b, join_type, predicate", "0, 'T1', 'T2', 'RIGHT', 'A.K = B.K'", "1, 'T1', 'T2', 'FULL', 'A.K = B.K'", "2, 'T1', 'T2', 'CROSS', ''", "3, 'T1', 'T2', 'JOIN', '(K)'"))
def join_forms(spark, sf_dir):
    return _forms(spark, sf_dir).edges().select("file", "table_a", "table_b", "join_type", "predicate")


@_query(_values('"table", "column"', "0, 'T1', 'K'", "0, 'T2', 'K'", "1, 'T1', 'K'", "1, 'T2', 'K'", "4, 'T1', 'X'", "4, 'T2', 'Y'", "8, 'T1', 'Y'", "8, 'T1', 'Y'", "8, 'T1', 'X'") + " AND k IN (0, 1, 4, 8)")
def scope_resolution(spark, sf_dir):
    cols = _forms(spark, sf_dir).columns().where("table <> '(no-table)'")
    return cols.where(F.regexp_extract("file", r"(\d+)", 1).cast("long") % 10 != 6).select("file", "table", "column")


_BLOCKS = {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 2, 8: 1, 9: 1}


@_query(_values("has_subquery, has_union, n_blocks", *(f"{k}, {k in (4, 6)}, {k == 5}, '{n}'" for k, n in _BLOCKS.items())))
def statement_shapes(spark, sf_dir):
    shape = F.element_at(identity.of_kind("facts", "SHAPE"), 1)
    return _forms(spark, sf_dir).identities().select("file", "has_subquery", "has_union", F.regexp_extract(shape, r"=(\d+)", 1).alias("n_blocks"))


@_query(_values("operator, value", "9, 'NOT IN', '''§'''", "9, 'NOT BETWEEN', '''§'''", "9, 'NOT BETWEEN', '''§9'''").replace("v.* EXCLUDE (k)", f"v.operator, replace(v.value, '§', {_K}) AS value"))
def detect_negated(spark, sf_dir):
    return _forms(spark, sf_dir, ScanOptions()).findings().select("file", "operator", "value")


@_query(f"SELECT f AS fact, count(*)::BIGINT AS n FROM (SELECT unnest(f) AS f FROM ({_FACTS})) GROUP BY 1")
def fact_counts(spark, sf_dir):
    return _scan(spark, sf_dir).identities().select(F.explode("facts").alias("fact")).groupBy("fact").agg(F.count("*").alias("n"))


@_query(f"""SELECT DISTINCT CASE split_part(f, '|', 1) WHEN 'TBL' THEN 'table ' || split_part(f, '|', 2) || '.' || split_part(f, '|', 3) WHEN 'JOINTYPE' THEN 'join-type ' || split_part(f, '|', 2)
 WHEN 'REL' THEN 'join ' || split_part(f, '|', 3) || ' ' || split_part(f, '|', 2) || ' ' || split_part(f, '|', 4) WHEN 'PRED' THEN 'predicate ' || split_part(f, '|', 2) || ' ' || split_part(f, '|', 3)
 WHEN 'GROUPBY' THEN 'group-by ' || split_part(f, '|', 2) ELSE 'shape ' || split_part(f, '|', 2) END AS shown FROM (SELECT unnest(f) AS f FROM ({_FACTS}))""")
def humanized_facts(spark, sf_dir):
    return _scan(spark, sf_dir).identities().select(F.explode("facts").alias("fact")).distinct().select(identity.humanized(F.col("fact")).alias("shown"))


@_query(f"SELECT function, parameters, count(*)::BIGINT AS n FROM ({_CALLS}) GROUP BY ALL ORDER BY n DESC, function, parameters LIMIT 10")
def top_function_calls(spark, sf_dir):
    return _scan(spark, sf_dir).functions().groupBy("function", "parameters").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "function", "parameters").limit(10)


@_query("SELECT concat('f', c_custkey, '.sql') AS file, CASE WHEN c_custkey % 2 = 0 THEN 'ACCT_ID' ELSE 'CTRT_NO' END AS column_name, '''' || c_custkey || '''' AS value, 2 AS line, 'Y' AS in_comment FROM customer")
def nested_comment_rescan(spark, sf_dir):
    text = r"concat('SELECT 1 /* a /* \n -- ', CASE WHEN c_custkey % 2 = 0 THEN 'ACCT_ID' ELSE 'CTRT_NO' END, ' = \'', c_custkey, '\'\n */ b */ FROM T;')"
    return scan_table(_texts(spark, sf_dir, text), ScanOptions()).findings().select("file", "column_name", "value", "line", "in_comment")


@_query("SELECT concat('f', c_custkey, '.sql') AS file, 'ACCT_ID' AS column_name, '=' AS operator, '''' || c_custkey || '''' AS value FROM customer")
def detect_insert_values(spark, sf_dir):
    text = r"concat('INSERT INTO T (ACCT_ID, X) VALUES (\'', c_custkey, '\', \'z\');')"
    return scan_table(_texts(spark, sf_dir, text), ScanOptions(detect_insert_values=True)).findings().select("file", "column_name", "operator", "value")


@_query("""SELECT concat('f', c_custkey, '.sql') AS file, substr('SELECT 1 FROM T WHERE ACCT_ID = ''' || c_custkey || ''' AND X = ''' || repeat('y', 200), 1, 160) || '...' AS snippet FROM customer""")
def snippets(spark, sf_dir):
    text = r"concat('   SELECT 1 FROM T WHERE ACCT_ID = \'', c_custkey, '\' AND X = \'', repeat('y', 200), '\'')"
    return scan_table(_texts(spark, sf_dir, text), ScanOptions()).findings().select("file", "snippet")


@_query(f"SELECT 'FINDING' AS severity, in_comment, 'd/' || (c % 3) AS directory, 'q' || c || '.sql' AS file_name, line, column_name, operator, value FROM (SELECT *, regexp_extract(file, '(\\d+)', 1)::BIGINT AS c FROM ({_FINDINGS}))")
def findings_report_rows(spark, sf_dir):
    key = F.regexp_extract("file", r"(\d+)", 1).cast("long")
    found = _scan(spark, sf_dir, ScanOptions()).findings().withColumn("file", F.concat(F.lit("d/"), (key % 3).cast("string"), F.lit("/"), F.col("file")))
    return sinks.findings_table(found).drop("snippet")


@_query("""SELECT concat('f', c_custkey) AS path, CASE c_custkey % 4 WHEN 0 THEN 'A' || chr(10) || c_custkey WHEN 1 THEN 'B' || c_custkey WHEN 2 THEN '가' || c_custkey ELSE '한글' || chr(10) END AS text,
 CASE WHEN c_custkey % 4 = 2 THEN 'cp949' ELSE 'utf-8-sig' END AS encoding FROM customer""")
def decoded_encodings(spark, sf_dir):
    content = "CASE c_custkey % 4 WHEN 0 THEN CAST(concat('A\\r\\n', c_custkey) AS binary) WHEN 1 THEN concat(unhex('EFBBBF'), CAST(concat('B', c_custkey) AS binary)) WHEN 2 THEN concat(unhex('B0A1'), CAST(CAST(c_custkey AS string) AS binary)) ELSE CAST('한글\\r' AS binary) END"
    return sources.decoded(spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('f', c_custkey) AS path", f"{content} AS content"))


_NAMES = "concat('/r/', c_custkey % 5, '/f', c_custkey, CASE c_custkey % 4 WHEN 0 THEN '.SQL' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' ELSE '.sql.bak' END)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(f"{_NAMES} AS path")


@_query(f"SELECT path FROM (SELECT {_NAMES} AS path, c_custkey FROM customer) WHERE c_custkey % 4 IN (0, 2) AND c_custkey % 5 <> 3")
def matching_files(spark, sf_dir):
    return sources.matching(_files(spark, sf_dir), skip_dirs=["/r/3"])


@_query(f"SELECT path AS original_file, '/r/_quarantine/excluded/' || substr(path, 4) AS quarantined_file FROM (SELECT {_NAMES} AS path, c_custkey FROM customer) WHERE c_custkey % 4 IN (1, 3)")
def quarantine_moves(spark, sf_dir):
    return rewrite.quarantine_plan(_files(spark, sf_dir), "/r", (".sql", ".txt"))


@_query("SELECT 'q' || c_custkey || '.sql' AS path, '/r/_quarantine/bad_files/q' || c_custkey || '.sql' AS quarantined_file FROM customer WHERE c_custkey % 8 = 7")
def bad_file_moves(spark, sf_dir):
    return rewrite.bad_file_plan(_scan(spark, sf_dir, ScanOptions()).bad_files(), "/r").select("path", "quarantined_file")


@_query("SELECT '/r/' || c_custkey || '/a.sql.bak' AS path FROM customer WHERE c_custkey % 2 = 0")
def backups_of_split_files(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    files = c.selectExpr("explode(array(concat('/r/', c_custkey, '/a.sql'), concat('/r/', c_custkey, '/a.sql.bak'), concat('/r/', c_custkey, '/b.sql'))) AS path")
    return rewrite.backup_siblings(files, c.where("c_custkey % 2 = 0").selectExpr("concat('/r/', c_custkey, '/a.sql') AS original_file"), ("sql", "txt"))


@_query("SELECT o_custkey, o_custkey % 3 AS n_parts FROM orders WHERE o_custkey % 3 > 0 GROUP BY ALL")
def unsplit_rows_kept(spark, sf_dir):
    """Of three parts a file, o_custkey % 3 are there: those with all (here: 0 stands for 3) are joined, of the others the rows stay."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct()
    parts = keys.select("o_custkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("block_number")).select("o_custkey", F.concat(F.lit("o"), "o_custkey").alias("original_file"), F.concat(F.lit("o"), "o_custkey", F.lit("-"), "block_number").alias("split_file"), "block_number", F.lit(3).alias("total_blocks"))
    there = parts.where((F.col("o_custkey") % 3 == 0) | (F.col("block_number") <= F.col("o_custkey") % 3)).select(F.col("split_file").alias("path"), F.lit("x").alias("text"))
    _, stay = rewrite.unsplit_plan(parts.drop("o_custkey"), there)
    left = stay.join(there.select(F.col("path").alias("split_file")), "split_file", "left_semi")
    return left.groupBy(F.substring("original_file", 2, 20).cast("long").alias("o_custkey")).agg(F.count("*").alias("n_parts"))


@_query("SELECT doc_id, md5(replace(replace(translate(text, chr(9) || chr(10) || chr(13), '   '), '|', '\\|'), '`', '''')) AS cell FROM documents")
def markdown_cells(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(sinks.markdown(F.col("text"))).alias("cell"))


@_query("SELECT o_custkey::VARCHAR AS o_custkey, string_agg(o_orderkey, '; ' ORDER BY o_orderkey) AS orders, CASE WHEN count(*) > 10 THEN 'True' ELSE 'False' END AS many FROM orders GROUP BY 1")
def tsv_cells(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"), (F.count("*") > 10).alias("many"))
    return sinks.as_cells(o)


@_query("SELECT concat('q', c_custkey, '.sql') AS path, ' ACCT_ID = ''' || c_custkey || '''' AS inner_text FROM customer WHERE c_custkey % 8 = 6")
def comment_texts(spark, sf_dir):
    from .queries import statements

    found = token_ops.exploded(tokens(statements(spark, sf_dir, dealt=True))).where(F.col("type").isin("LINE_COMMENT", "SQL_COMMENT"))
    return found.select("path", F.regexp_replace("text", r"^(--|/\*)|\*/$", "").alias("inner_text"))


# Files: a text for each nation, by n_nationkey % 5, written below the shared folder and scanned as a corpus.
_NATION_TEXT = r"""CASE n_nationkey % 5
 WHEN 0 THEN concat('SELECT 1 FROM T WHERE ACCT_ID = \'', n_nationkey, '\';')
 WHEN 1 THEN concat('-- CTRT_NO IN (\'', n_nationkey, '\', \'9', n_nationkey, '\')\nSELECT 1 FROM T;')
 WHEN 2 THEN '========' WHEN 3 THEN concat('SELECT 1 FROM A;\nUPDATE T SET ACCT_NM = \'', n_nationkey, '\';\nSELECT 2 FROM B;')
 ELSE '## $$ @@ SELECT 1' END"""


def _folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, a temporary one that goes when Python ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = tempfile.mkdtemp(prefix="sqlquarry-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = "file://" + local
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _nation_files(spark: SparkSession, sf_dir: str) -> str:
    out = _folder(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS k", f"{_NATION_TEXT} AS value").write.partitionBy("k").text(out)
    return out


def _number(c: str):
    return F.regexp_extract(c, r"/k=(\d+)/", 1).cast("int").alias("k")


@_query("""SELECT n_nationkey::INT AS k, v.c AS column_name, v.o AS operator, replace(v.v, '<k>', n_nationkey::VARCHAR) AS value, v.line AS line, v.i AS in_comment FROM nation,
(VALUES (0, 'ACCT_ID', '=', '''<k>''', 1, 'N'), (1, 'CTRT_NO', 'IN', '''<k>''', 1, 'Y'), (1, 'CTRT_NO', 'IN', '''9<k>''', 1, 'Y'), (3, 'ACCT_NM', '=', '''<k>''', 2, 'N')) v(t, c, o, v, line, i)
WHERE n_nationkey % 5 = v.t""".replace("\'", "'"))
def file_scan_findings(spark, sf_dir):
    return scan(spark, _nation_files(spark, sf_dir)).findings().select(_number("file"), "column_name", "operator", "value", "line", "in_comment")


@_query("SELECT n_nationkey::INT AS k, CASE n_nationkey % 5 WHEN 2 THEN 'repeated-char-run' ELSE 'lexer-error-ratio' END AS category FROM nation WHERE n_nationkey % 5 IN (2, 4)")
def file_scan_bad_files(spark, sf_dir):
    return scan(spark, _nation_files(spark, sf_dir)).bad_files().select(_number("path"), "category")


@_query("SELECT n_nationkey::INT AS k FROM nation WHERE n_nationkey % 5 NOT IN (2, 4)")
def file_scan_skips_bad_files(spark, sf_dir):
    """Bad files of one run, written and read as a list, are not read by the next."""
    root, listed = _nation_files(spark, sf_dir), _folder(spark)
    sinks.write_tsv_folder(scan(spark, root).bad_files(), listed)
    return sources.read_corpus(spark, root, exclude=sources.read_bad_files(spark, listed)).select(_number("path"))


@_query("SELECT n_nationkey::INT AS k, n AS block_number, 2 AS total_blocks FROM nation, (VALUES (1), (2)) v(n) WHERE n_nationkey % 5 = 3")
def file_split_manifest(spark, sf_dir):
    """The split manifest of scanned files, written and read again; rows with odd numbers go."""
    listed = _folder(spark)
    plan = rewrite.split_plan(scan(spark, _nation_files(spark, sf_dir)).blocks()).drop("text")
    odd = plan.withColumn("block_number", F.lit("x"))
    sinks.write_tsv_folder(plan.withColumn("block_number", F.col("block_number").cast("string")).unionByName(odd), listed)
    return sources.read_split_manifest(spark, listed).select(_number("original_file"), "block_number", "total_blocks")


# A statement for each part over tables TA0..99 and TB0..49: up to 5,000 structures, of which many are alike.
_PART_FACTS = """SELECT core_id, f FROM (SELECT *, row_number() OVER (PARTITION BY core_id ORDER BY file, f) AS r FROM (
 SELECT concat('s', p_partkey, '.sql') AS file, f, """ + _core("structure") + """ AS core_id FROM (
 SELECT p_partkey, ['TBL|(no-schema)|TA' || p_partkey % 100, 'TBL|(no-schema)|TB' || p_partkey // 100 % 50, 'JOINTYPE|INNER=1', 'REL|=|TA' || p_partkey % 100 || '.K|TB' || p_partkey // 100 % 50 || '.K',
  'PRED|TA' || p_partkey % 100 || '.F' || p_partkey % 7 || '|=', 'SHAPE|BLOCKS=1'] AS f FROM part))) WHERE r = 1"""


@_query(f"""WITH s AS ({_PART_FACTS}), e AS (SELECT core_id, unnest(f) AS x FROM s),
p AS (SELECT a.core_id AS core_id_a, b.core_id AS core_id_b, count(*) AS n FROM e a JOIN e b USING (x) WHERE a.core_id < b.core_id GROUP BY 1, 2)
SELECT core_id_a, core_id_b, round_even(n / (12 - n), 3) AS similarity, n::INT AS shared_facts FROM p WHERE n / (12 - n) >= 0.5""")
def similarity_many_ids(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "concat('s', p_partkey, '.sql') AS path",
        "concat('SELECT 1 FROM TA', p_partkey % 100, ' X JOIN TB', CAST(floor(p_partkey / 100) AS bigint) % 50, ' Y ON X.K = Y.K WHERE X.F', p_partkey % 7, ' = 1;') AS text",
    )
    return scan_table(sources.from_table(rows, "path", "text").repartition(spark.sparkContext.defaultParallelism), ALL).similarity().select("core_id_a", "core_id_b", "similarity", "shared_facts")
