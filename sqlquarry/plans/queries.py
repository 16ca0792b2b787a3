"""Registered queries over a corpus made from `customer` (a statement for each row, by c_custkey % 8) and over other tables,
and SQL that computes the same rows from the tables' fields without reading any statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity, relations, rewrite, sinks
from ..operators import tokens as token_ops
from ..options import ScanOptions
from ..sources import corpus as sources
from .scan import Scan, scan_table, tokens

ALL = ScanOptions.metadata()

# ¤ is a quote inside a text, ¶ a line feed
TEXT = """CASE c_custkey % 8
 WHEN 0 THEN concat('SELECT A.ACCT_ID FROM TBACCT A WHERE A.ACCT_ID = ¤', c_custkey, '¤;')
 WHEN 1 THEN concat('SELECT * FROM S1.TBACCT A INNER JOIN TBCTRT B ON A.ACCT_ID = B.ACCT_ID WHERE B.CTRT_NO IN (¤', c_custkey, '¤,¤', c_custkey, '1¤);')
 WHEN 2 THEN concat('SELECT * FROM S1.TBACCT A LEFT OUTER JOIN TBCTRT B ON A.ACCT_ID = B.ACCT_ID WHERE B.CTRT_NO IN (¤', c_custkey, '¤,¤', c_custkey, '1¤);')
 WHEN 3 THEN concat('SELECT * FROM TBACCT A, TBCTRT B WHERE A.ACCT_ID = B.ACCT_ID AND B.SEG = ¤', c_mktsegment, '¤;')
 WHEN 4 THEN 'WITH C1 AS (SELECT X.ID FROM TBORD X) SELECT * FROM C1 Y JOIN TBITEM Z ON Y.ID = Z.ID;'
 WHEN 5 THEN concat('UPDATE TBACCT SET ACCT_NM = ¤', c_custkey, '¤ WHERE ACCT_ID BETWEEN ¤', c_custkey, '¤ AND ¤', c_custkey, '9¤;')
 WHEN 6 THEN concat('-- ACCT_ID = ¤', c_custkey, '¤¶SELECT UPPER(A.NM) FROM TBACCT A WHERE UPPER(A.NM) LIKE ¤x%¤ GROUP BY A.NM;¶SELECT 1 FROM TBCODE;')
 ELSE '========¶SELECT 1 FROM T1;' END"""
_SPARK_TEXT = TEXT.replace("¤", "\\'").replace("¶", "\\n")
_DUCK_TEXT = TEXT.replace("¤", "''").replace("¶", "' || chr(10) || '")


def customers(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """c_custkey, c_mktsegment. Dealt out, as a Python stage that makes texts of them is to use every core: a file has few row
    groups, often one for a million rows, and each is read by one task. Keys are less to send than their texts."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    return rows.repartition(spark.sparkContext.defaultParallelism) if dealt else rows


def statements(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """path, text, encoding: one text for each customer. The same for any size of table; no shuffle unless dealt."""
    rows = customers(spark, sf_dir, dealt).selectExpr("concat('q', c_custkey, '.sql') AS path", f"{_SPARK_TEXT} AS text")
    return sources.from_table(rows, "path", "text")


def _scan(spark: SparkSession, sf_dir: str, options: ScanOptions = ALL) -> Scan:
    return scan_table(statements(spark, sf_dir, dealt=True), options)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_F = "concat('q', c_custkey, '.sql') AS file"
_K = "c_custkey::VARCHAR"
_FINDINGS = f"""
SELECT {_F}, 1 AS line, 'ACCT_ID' AS column_name, '=' AS operator, '''' || {_K} || '''' AS value, 'N' AS in_comment FROM customer WHERE c_custkey % 8 = 0
UNION ALL SELECT {_F}, 1, 'CTRT_NO', 'IN', '''' || {_K} || '''', 'N' FROM customer WHERE c_custkey % 8 IN (1, 2)
UNION ALL SELECT {_F}, 1, 'CTRT_NO', 'IN', '''' || {_K} || '1''', 'N' FROM customer WHERE c_custkey % 8 IN (1, 2)
UNION ALL SELECT {_F}, 1, 'ACCT_NM', '=', '''' || {_K} || '''', 'N' FROM customer WHERE c_custkey % 8 = 5
UNION ALL SELECT {_F}, 1, 'ACCT_ID', 'BETWEEN', '''' || {_K} || '''', 'N' FROM customer WHERE c_custkey % 8 = 5
UNION ALL SELECT {_F}, 1, 'ACCT_ID', 'BETWEEN', '''' || {_K} || '9''', 'N' FROM customer WHERE c_custkey % 8 = 5
UNION ALL SELECT {_F}, 1, 'ACCT_ID', '=', '''' || {_K} || '''', 'Y' FROM customer WHERE c_custkey % 8 = 6"""


@_query(_FINDINGS)
def findings(spark, sf_dir):
    return _scan(spark, sf_dir, ScanOptions()).findings().select("file", "line", "column_name", "operator", "value", "in_comment")


def _detect(name: str, where: str) -> None:
    def fn(spark, sf_dir):
        return findings(spark, sf_dir).where(where)

    fn.__name__ = name
    _query(f"SELECT * FROM ({_FINDINGS}) WHERE {where}")(fn)


_detect("detect_eq", "operator = '=' AND column_name = 'ACCT_ID' AND in_comment = 'N'")
_detect("detect_in", "operator = 'IN'")
_detect("detect_between", "operator = 'BETWEEN'")
_detect("detect_set", "column_name = 'ACCT_NM'")
_detect("detect_in_comment", "in_comment = 'Y'")


@_query("SELECT column_name, count(*)::BIGINT AS n FROM (" + _FINDINGS + ") GROUP BY 1")
def findings_by_column(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("column_name").agg(F.count("*").alias("n"))


def _variant(name: str, spark_text: str, rows: str) -> None:
    """A query of findings in one statement a customer."""

    def fn(spark, sf_dir):
        df = customers(spark, sf_dir).selectExpr("concat('q', c_custkey, '.sql') AS path", f"{spark_text} AS text")
        return scan_table(sources.from_table(df, "path", "text"), ScanOptions()).findings().select("file", "column_name", "operator", "value")

    fn.__name__ = name
    _query(rows)(fn)


_variant("detect_like", r"concat('SELECT 1 FROM T WHERE T.ACCT_NM NOT LIKE \'', c_custkey, '%\'')", f"SELECT {_F}, 'ACCT_NM' AS column_name, 'NOT LIKE' AS operator, '''' || {_K} || '%''' AS value FROM customer")
_variant("detect_reversed", r"concat('SELECT 1 FROM T WHERE ', c_custkey, ' >= T.CTRT_NO')", f"SELECT {_F}, 'CTRT_NO' AS column_name, '>=' AS operator, {_K} AS value FROM customer")
_variant("detect_window_dq", r"""concat('SELECT 1 FROM T WHERE ACCT_ID = "', c_custkey, '"')""", f"""SELECT {_F}, 'ACCT_ID' AS column_name, '=' AS operator, '"' || {_K} || '"' AS value FROM customer""")
_variant("blank_literal_filter", r"concat('SELECT 1 FROM T WHERE ACCT_ID IN (\'\', \'  \', \'', c_custkey, '\')')", f"SELECT {_F}, 'ACCT_ID' AS column_name, 'IN' AS operator, '''' || {_K} || '''' AS value FROM customer")


@_query("SELECT 'ACCT_ID' AS column_name, 'IN' AS operator, i::VARCHAR AS value FROM range(1, 250001) AS t(i)")
def detect_long_in(spark, sf_dir):
    """One statement with a list of 250,000 literals: more than the budget of statement-level steps."""
    df = spark.range(1).selectExpr("'long.sql' AS path", "concat('SELECT 1 FROM T WHERE ACCT_ID IN (', array_join(sequence(1, 250000), ','), ')') AS text")
    return scan_table(sources.from_table(df, "path", "text"), ScanOptions()).findings().select("column_name", "operator", "value")


@_query("SELECT word, count(*)::BIGINT AS n FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN '홍길동' WHEN 1 THEN '김영희' ELSE '서울' END AS word FROM customer) WHERE word <> '서울' GROUP BY 1")
def name_candidates(spark, sf_dir):
    df = customers(spark, sf_dir).selectExpr("concat('q', c_custkey) AS path", r"concat('SELECT \'', CASE c_custkey % 3 WHEN 0 THEN '홍길동' WHEN 1 THEN '김영희' ELSE '서울' END, '\' FROM T') AS text")
    return scan_table(sources.from_table(df, "path", "text"), ScanOptions(stopwords=frozenset({"서울"}))).name_counts()


@_query(f"SELECT concat('q', c_custkey) AS file, '-' AS column_name, '''홍길동''' AS value FROM customer")
def known_name_findings(spark, sf_dir):
    df = customers(spark, sf_dir).selectExpr("concat('q', c_custkey) AS path", r"""'-- "홍길동"' AS text""")
    return scan_table(sources.from_table(df, "path", "text"), ScanOptions(known_names=frozenset({"홍길동"}))).findings().select("file", "column_name", "value")


@_query("SELECT t, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM (SELECT c_custkey % 8 AS t, " + _DUCK_TEXT + " AS text FROM customer) GROUP BY 1")
def corpus_scan_counts(spark, sf_dir):
    df = statements(spark, sf_dir).withColumn("t", F.regexp_extract("path", r"(\d+)", 1).cast("long") % 8)
    return df.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@_query("""WITH f AS (SELECT c_custkey // 3 AS d, CASE c_custkey % 3 WHEN 0 THEN 'q.sql' WHEN 1 THEN 'q.sql.bak' ELSE 'Q.bak' END AS n FROM customer)
SELECT path FROM (SELECT 'r/' || d || '/' || n AS path, row_number() OVER (PARTITION BY d ORDER BY n <> 'q.sql', length(n), n) AS r FROM f) WHERE r = 1""")
def dedupe_backup_names(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('r/', CAST(floor(c_custkey / 3) AS bigint), '/', CASE c_custkey % 3 WHEN 0 THEN 'q.sql' WHEN 1 THEN 'q.sql.bak' ELSE 'Q.bak' END) AS path")
    return sources.deduped(files)


_SPLITS = "SELECT concat('r/', c_custkey // 3, '/', CASE c_custkey % 3 WHEN 0 THEN 'a.sql' WHEN 1 THEN 'a-01.sql' ELSE 'b-02.sql' END) AS path, c_custkey % 3 AS k, c_custkey // 3 AS d FROM customer"


@_query(f"WITH f AS ({_SPLITS}) SELECT path FROM f WHERE NOT (k = 1 AND EXISTS (SELECT 1 FROM f g WHERE g.d = f.d AND g.k = 0))")
def stale_split_outputs(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('r/', CAST(floor(c_custkey / 3) AS bigint), '/', CASE c_custkey % 3 WHEN 0 THEN 'a.sql' WHEN 1 THEN 'a-01.sql' ELSE 'b-02.sql' END) AS path")
    return sources.without_stale_splits(files)


@_query("SELECT DISTINCT trim(split_part(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' # note' ELSE '' END, '#', 1)) AS word FROM part WHERE trim(p_name) <> ''")
def wordlist_filter(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' # note' ELSE '' END) AS value")
    return sources.word_list(lines)


@_query("""SELECT type, sum(n)::BIGINT AS n FROM customer, (VALUES (0, 'SELECT', 1), (0, 'FROM', 1), (0, 'WHERE', 1), (0, ';', 1), (1, 'SELECT', 1), (1, 'FROM', 1), (1, 'WHERE', 1), (1, 'JOIN', 1), (1, ';', 1),
 (2, 'SELECT', 1), (2, 'FROM', 1), (2, 'WHERE', 1), (2, 'JOIN', 1), (2, ';', 1), (3, 'SELECT', 1), (3, 'FROM', 1), (3, 'WHERE', 1), (3, ';', 1), (4, 'SELECT', 2), (4, 'FROM', 2), (4, 'JOIN', 1), (4, ';', 1),
 (5, 'WHERE', 1), (5, ';', 1), (6, 'SELECT', 2), (6, 'FROM', 2), (6, 'WHERE', 1), (6, ';', 2), (7, 'SELECT', 1), (7, 'FROM', 1), (7, ';', 1)) v(t, type, n) WHERE c_custkey % 8 = t GROUP BY 1""")
def token_type_counts(spark, sf_dir):
    return token_ops.exploded(tokens(statements(spark, sf_dir, dealt=True))).where(F.col("type").isin("SELECT", "FROM", "WHERE", "JOIN", ";")).groupBy("type").agg(F.count("*").alias("n"))


@_query("SELECT concat('q', c_custkey, '.sql') AS path, CASE WHEN c_custkey % 8 = 6 THEN 2 ELSE 1 END::BIGINT AS n_chunks FROM customer")
def chunk_counts(spark, sf_dir):
    return _scan(spark, sf_dir, ScanOptions()).stats().select("path", F.col("n_chunks").cast("long").alias("n_chunks"))


@_query("""WITH s AS (SELECT user_id, event_id, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, (s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS depth FROM s""")
def paren_depth_clamped(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    return token_ops.clamped_depth(ev, ["user_id"], ["event_id"], F.when(F.col("event_id") % 3 == 0, 1).otherwise(-1)).select("user_id", "event_id", F.col("depth").cast("long").alias("depth"))


@_query("SELECT concat('q', c_custkey, '.sql') AS path, 'repeated-char-run' AS category, '========' AS item FROM customer WHERE c_custkey % 8 = 7")
def quality_gate(spark, sf_dir):
    return _scan(spark, sf_dir, ScanOptions()).bad_files().select("path", "category", "item")


@_query("""WITH c AS (SELECT doc_id, i, substr(text, i, 1) AS m FROM documents, unnest(range(1, length(text) + 1)) AS t(i)),
p AS (SELECT doc_id, i, m FROM c WHERE regexp_matches(m, '""" + token_ops.MARKS + """')),
g AS (SELECT doc_id, m, i - row_number() OVER (PARTITION BY doc_id, m ORDER BY i) AS k FROM p)
SELECT doc_id, max(n)::BIGINT AS longest_run FROM (SELECT doc_id, m, k, count(*) AS n FROM g GROUP BY ALL) GROUP BY 1""")
def punct_run_islands(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", token_ops.longest_run(F.col("text")).cast("long").alias("longest_run")).where("longest_run IS NOT NULL")


# pieces: c_custkey % 10 marks that no token takes, a space, and five times A;
@_query("""SELECT concat('q', c_custkey) AS path, 'lexer-error-ratio' AS category, repeat('#', (c_custkey % 10)::INT) AS item FROM customer
WHERE c_custkey % 10 > 0.2 * (c_custkey % 10 + 11)""")
def lexer_error_gate(spark, sf_dir):
    df = customers(spark, sf_dir).selectExpr("concat('q', c_custkey) AS path", "concat(repeat('#', CAST(c_custkey % 10 AS int)), ' ', repeat('A;', 5)) AS text")
    return scan_table(sources.from_table(df, "path", "text"), ScanOptions()).bad_files().select("path", "category", "item")


_S = "'(no-schema)'"
_TABLES = f"""
SELECT {_F}, {_S} AS "schema", 'TBACCT' AS "table", 1 AS line FROM customer WHERE c_custkey % 8 IN (0, 3, 5)
UNION ALL SELECT {_F}, 'S1', 'TBACCT', 1 FROM customer WHERE c_custkey % 8 IN (1, 2)
UNION ALL SELECT {_F}, {_S}, 'TBCTRT', 1 FROM customer WHERE c_custkey % 8 IN (1, 2, 3)
UNION ALL SELECT {_F}, {_S}, t, 1 FROM customer, (VALUES ('TBORD'), ('TBITEM')) v(t) WHERE c_custkey % 8 = 4
UNION ALL SELECT {_F}, {_S}, 'TBACCT', 2 FROM customer WHERE c_custkey % 8 = 6
UNION ALL SELECT {_F}, {_S}, 'TBCODE', 3 FROM customer WHERE c_custkey % 8 = 6"""


@_query(_TABLES)
def table_refs(spark, sf_dir):
    return _scan(spark, sf_dir).tables()


@_query(f'SELECT "schema", "table", count(*)::BIGINT AS n FROM ({_TABLES}) GROUP BY 1, 2')
def table_ref_counts(spark, sf_dir):
    return table_refs(spark, sf_dir).groupBy("schema", "table").agg(F.count("*").alias("n"))


@_query(f"""SELECT {_F}, s AS "schema", t AS "table", c AS "column", l AS line FROM customer, (VALUES
 (0, {_S}, 'TBACCT', 'ACCT_ID', 1), (0, {_S}, 'TBACCT', 'ACCT_ID', 1), (1, 'S1', 'TBACCT', 'ACCT_ID', 1), (1, {_S}, 'TBCTRT', 'ACCT_ID', 1), (1, {_S}, 'TBCTRT', 'CTRT_NO', 1),
 (2, 'S1', 'TBACCT', 'ACCT_ID', 1), (2, {_S}, 'TBCTRT', 'ACCT_ID', 1), (2, {_S}, 'TBCTRT', 'CTRT_NO', 1), (3, {_S}, 'TBACCT', 'ACCT_ID', 1), (3, {_S}, 'TBCTRT', 'ACCT_ID', 1), (3, {_S}, 'TBCTRT', 'SEG', 1),
 (4, {_S}, 'TBORD', 'ID', 1), (4, {_S}, '(no-table)', 'ID', 1), (4, {_S}, 'TBITEM', 'ID', 1), (5, {_S}, '(no-table)', 'ACCT_NM', 1), (5, {_S}, '(no-table)', 'ACCT_ID', 1),
 (6, {_S}, 'TBACCT', 'NM', 2), (6, {_S}, 'TBACCT', 'NM', 2), (6, {_S}, 'TBACCT', 'NM', 2)) v(k, s, t, c, l) WHERE c_custkey % 8 = k""")
def column_refs(spark, sf_dir):
    return _scan(spark, sf_dir).columns()


_CALLS = f"""SELECT {_F}, f AS function, replace(replace(p, '<k>', {_K}), '<s>', c_mktsegment) AS parameters, l AS line FROM customer, (VALUES
 (0, '=', 'A.ACCT_ID, ''<k>''', 1), (1, '=', 'A.ACCT_ID, B.ACCT_ID', 1), (1, 'IN', 'B.CTRT_NO, (''<k>'',''<k>1'')', 1), (2, '=', 'A.ACCT_ID, B.ACCT_ID', 1), (2, 'IN', 'B.CTRT_NO, (''<k>'',''<k>1'')', 1),
 (3, '=', 'A.ACCT_ID, B.ACCT_ID', 1), (3, '=', 'B.SEG, ''<s>''', 1), (4, '=', 'Y.ID, Z.ID', 1), (5, 'BETWEEN', 'ACCT_ID, ''<k>'', ''<k>9''', 1),
 (6, 'UPPER', 'A.NM', 2), (6, 'UPPER', 'A.NM', 2), (6, 'LIKE', 'UPPER(A.NM), ''x%''', 2)) v(t, f, p, l) WHERE c_custkey % 8 = t"""


@_query(_CALLS)
def function_calls(spark, sf_dir):
    return _scan(spark, sf_dir).functions()


@_query(f"SELECT function, count(*)::BIGINT AS n FROM ({_CALLS})  GROUP BY 1")
def predicate_ops(spark, sf_dir):
    return function_calls(spark, sf_dir).groupBy("function").agg(F.count("*").alias("n"))


_EDGES = f"""SELECT {_F}, 1 AS line, s AS table_a_schema, 'TBACCT' AS table_a, {_S} AS table_b_schema, 'TBCTRT' AS table_b, j AS join_type, p AS predicate FROM customer, (VALUES
 (1, 'S1', 'INNER', 'A.ACCT_ID = B.ACCT_ID'), (2, 'S1', 'LEFT', 'A.ACCT_ID = B.ACCT_ID'), (3, {_S}, 'WHERE-IMPLICIT', 'TBACCT.ACCT_ID = TBCTRT.ACCT_ID')) v(t, s, j, p) WHERE c_custkey % 8 = t"""


@_query(_EDGES)
def join_edges(spark, sf_dir):
    return _scan(spark, sf_dir).edges()


@_query(f"SELECT * FROM ({_EDGES}) WHERE join_type = 'WHERE-IMPLICIT'")
def where_implicit_edges(spark, sf_dir):
    return join_edges(spark, sf_dir).where("join_type = 'WHERE-IMPLICIT'")


@_query("""SELECT o_orderkey, a AS table_a, b AS table_b, 'JOIN' AS join_type FROM (SELECT o_orderkey, 'T' || o_custkey % 5 AS a, 'T' || o_orderkey % 5 AS b FROM orders)
UNION ALL SELECT o_orderkey, 'T' || o_orderkey % 7, 'T' || o_custkey % 7, 'WHERE-IMPLICIT' FROM orders
 WHERE NOT (least('T' || o_orderkey % 7, 'T' || o_custkey % 7) = least('T' || o_custkey % 5, 'T' || o_orderkey % 5) AND greatest('T' || o_orderkey % 7, 'T' || o_custkey % 7) = greatest('T' || o_custkey % 5, 'T' || o_orderkey % 5))""")
def edge_dedup(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = lambda a, b, kind: o.selectExpr("o_orderkey", "'' AS table_a_schema", f"concat('T', {a}) AS table_a", "'' AS table_b_schema", f"concat('T', {b}) AS table_b", f"'{kind}' AS join_type")
    both = relations.without_implied_duplicates(base("o_custkey % 5", "o_orderkey % 5", "JOIN"), base("o_orderkey % 7", "o_custkey % 7", "WHERE-IMPLICIT"), ["o_orderkey"])
    return both.select("o_orderkey", "table_a", "table_b", "join_type")


@_query(f"""SELECT s[1] AS table_a_schema, 'TBACCT' AS table_a, s[2] AS table_b_schema, 'TBCTRT' AS table_b, n AS join_count, p AS predicates FROM (
 SELECT CASE WHEN table_a_schema = 'S1' THEN [{_S}, 'S1'] ELSE [{_S}, {_S}] END AS s, count(*)::BIGINT AS n, string_agg(DISTINCT predicate, '; ' ORDER BY predicate) AS p, any_value(table_a_schema) AS a FROM ({_EDGES}) GROUP BY 1)
 WHERE a <> 'S1' UNION ALL SELECT {_S}, 'TBCTRT', 'S1', 'TBACCT', count(*)::BIGINT, string_agg(DISTINCT predicate, '; ' ORDER BY predicate) FROM ({_EDGES}) WHERE table_a_schema = 'S1' HAVING count(*) > 0""")
def relation_rollup(spark, sf_dir):
    return _scan(spark, sf_dir, ScanOptions(extract_relations=True)).rollup().withColumn("predicates", F.array_join("predicates", "; "))


_FACTS = f"""SELECT c_custkey, k, f FROM customer, (VALUES
 (0, 1, ['TBL|(no-schema)|TBACCT', 'PRED|TBACCT.ACCT_ID|=', 'SHAPE|BLOCKS=1']),
 (1, 1, ['TBL|S1|TBACCT', 'TBL|(no-schema)|TBCTRT', 'JOINTYPE|INNER=1', 'REL|=|TBACCT.ACCT_ID|TBCTRT.ACCT_ID', 'PRED|TBCTRT.CTRT_NO|IN', 'SHAPE|BLOCKS=1']),
 (2, 1, ['TBL|S1|TBACCT', 'TBL|(no-schema)|TBCTRT', 'JOINTYPE|LEFT=1', 'REL|=|TBACCT.ACCT_ID|TBCTRT.ACCT_ID', 'PRED|TBCTRT.CTRT_NO|IN', 'SHAPE|BLOCKS=1']),
 (3, 1, ['TBL|(no-schema)|TBACCT', 'TBL|(no-schema)|TBCTRT', 'JOINTYPE|INNER=1', 'REL|=|TBACCT.ACCT_ID|TBCTRT.ACCT_ID', 'PRED|TBCTRT.SEG|=', 'SHAPE|BLOCKS=1']),
 (4, 1, ['TBL|(no-schema)|TBORD', 'TBL|(no-schema)|TBITEM', 'JOINTYPE|INNER=1', 'REL|=|C1.ID|TBITEM.ID', 'SHAPE|BLOCKS=3']),
 (5, 1, ['TBL|(no-schema)|TBACCT', 'PRED|ACCT_ID|BETWEEN', 'SHAPE|BLOCKS=1']),
 (6, 2, ['TBL|(no-schema)|TBACCT', 'PRED|UPPER(TBACCT.NM)|LIKE', 'GROUPBY|TBACCT.NM', 'SHAPE|BLOCKS=1']),
 (6, 3, ['TBL|(no-schema)|TBCODE', 'SHAPE|BLOCKS=1'])) v(t, k, f) WHERE c_custkey % 8 = t"""


def _core(granularity: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in identity.TIERS[granularity])
    return f"substr(sha256(array_to_string(list_sort(list_filter(f, lambda x: split_part(x, '|', 1) IN ({kinds}))), chr(10))), 1, 16)"


@_query(f"SELECT {_core('structure')} AS core_id, {_F}, k AS line, len(list_filter(f, lambda x: x LIKE 'TBL|%'))::INT AS table_count, len(list_filter(f, lambda x: x LIKE 'REL|%'))::INT AS join_count, c_custkey % 8 = 4 AS has_cte, false AS has_subquery, false AS has_union FROM ({_FACTS})")
def identity_rows(spark, sf_dir):
    return _scan(spark, sf_dir).identities().select("core_id", "file", "line", "table_count", "join_count", "has_cte", "has_subquery", "has_union")


@_query(f"SELECT core_id, n, example_file FROM (SELECT {_core('structure')} AS core_id, count(*)::BIGINT AS n, min({_F.split(' AS ')[0]}) AS example_file FROM ({_FACTS}) GROUP BY 1) ORDER BY n DESC, core_id LIMIT 10")
def core_id_clusters(spark, sf_dir):
    return _scan(spark, sf_dir).clusters().select("core_id", "n", "example_file")


def _tier(granularity: str) -> None:
    def fn(spark, sf_dir):
        return _scan(spark, sf_dir, ScanOptions.metadata(identity_granularity=granularity)).identities().select("core_id", "file", "line")

    fn.__name__ = f"core_id_granularity_{granularity}"
    _query(f"SELECT {_core(granularity)} AS core_id, {_F}, k AS line FROM ({_FACTS})")(fn)


for _g in identity.TIERS:
    _tier(_g)

_PAIRS = f"""WITH s AS (SELECT {_core('structure')} AS id, any_value(f) AS f FROM ({_FACTS}) GROUP BY 1),
p AS (SELECT a.id AS core_id_a, b.id AS core_id_b, len(list_intersect(a.f, b.f)) AS n, a.f AS fa, b.f AS fb FROM s a JOIN s b ON a.id < b.id)"""


@_query(_PAIRS + " SELECT core_id_a, core_id_b, round_even(n / (len(fa) + len(fb) - n), 3) AS similarity, n::INT AS shared_facts FROM p WHERE n / (len(fa) + len(fb) - n) >= 0.5")
def statement_similarity(spark, sf_dir):
    return _scan(spark, sf_dir).similarity().select("core_id_a", "core_id_b", "similarity", "shared_facts")


@_query(_PAIRS + """ SELECT core_id_a, core_id_b, len(list_filter(fa, lambda x: NOT list_contains(fb, x)))::INT AS n_only_a, len(list_filter(fb, lambda x: NOT list_contains(fa, x)))::INT AS n_only_b FROM p WHERE n / (len(fa) + len(fb) - n) >= 0.5""")
def similarity_diff(spark, sf_dir):
    return _scan(spark, sf_dir).similarity().select("core_id_a", "core_id_b", F.size("only_in_a").alias("n_only_a"), F.size("only_in_b").alias("n_only_b"))


@_query("""WITH s AS (SELECT l_orderkey AS id, list_distinct(list(l_partkey)) AS f FROM lineitem GROUP BY 1), e AS (SELECT id, len(f) AS n, unnest(f) AS x FROM s),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b USING (x) WHERE a.id < b.id GROUP BY 1, 2)
SELECT a, b, shared::INT AS shared, round_even(shared / (na + nb - shared), 3) AS similarity FROM p WHERE shared / (na + nb - shared) >= 0.3""")
def jaccard_pairs(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("fact"))
    li = li.where("id IS NOT NULL AND fact IS NOT NULL").repartition("fact")  # the one exchange that distinct rows and their counts need
    both = identity.pairs_by_rows(li.distinct(), 0.3)
    sim = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    return both.select("a", "b", "shared", F.bround(sim, 3).alias("similarity"))


@_query(f"""SELECT concat('q', c_custkey, '.sql') AS path, replace(replace(replace(replace(text, '''' || {_K} || '''', '''****'''), '''' || {_K} || '1''', '''****'''), '''' || {_K} || '9''', '''****'''), '', '') AS masked_text FROM (SELECT c_custkey, {_DUCK_TEXT} AS text FROM customer)""")
def mask_literals(spark, sf_dir):
    return rewrite.masked(statements(spark, sf_dir), _scan(spark, sf_dir, ScanOptions()).findings()).select("path", "masked_text")


@_query("""SELECT concat('q', c_custkey, '.sql') AS original_file, concat('q', c_custkey, '-0', n, '.sql') AS split_file, n AS block_number, 2 AS total_blocks FROM customer, (VALUES (1), (2)) v(n) WHERE c_custkey % 8 = 6""")
def split_blocks(spark, sf_dir):
    return rewrite.split_plan(_scan(spark, sf_dir, ScanOptions()).blocks()).select("original_file", "split_file", "block_number", "total_blocks")


@_query("SELECT 'o' || o_custkey || '.sql' AS path, string_agg(o_orderstatus, chr(10) || chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey")
def unsplit_text(spark, sf_dir):
    from pyspark.sql import Window

    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_custkey")
    rows = o.select(F.concat(F.lit("o"), "o_custkey", F.lit(".sql")).alias("original_file"), F.concat(F.lit("o"), "o_custkey", F.lit("-"), "o_orderkey", F.lit(".sql")).alias("split_file"), F.row_number().over(w.orderBy("o_orderkey")).alias("block_number"), F.count("*").over(w).cast("int").alias("total_blocks"), F.col("o_orderstatus").alias("text"))
    return rewrite.unsplit_plan(rows.drop("text"), rows.select(F.col("split_file").alias("path"), "text"))[0]


@_query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 15")
def topk_per_file(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line"))
    return sinks.first_per_file(o, 15).select(F.col("file").alias("o_custkey"), F.col("line").alias("o_orderkey"))


@_query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:10], ', ') || CASE WHEN count(*) > 10 THEN ' (+' || (count(*) - 10) || ' more...)' ELSE '' END AS shown FROM orders GROUP BY 1")
def grouped_values(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    return o.select("o_custkey", sinks.shown_values(F.transform("v", lambda x: x.cast("string"))).alias("shown"))


@_query(f"SELECT file, count(*)::BIGINT AS findings FROM ({_FINDINGS}) GROUP BY ROLLUP (file)")
def totals_rollup(spark, sf_dir):
    return sinks.totals(_scan(spark, sf_dir, ScanOptions()).findings())


@_query("SELECT concat('d/q', c_custkey, '.sql') AS path FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 7 = 0)")
def skip_list_anti_join(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('d/q', c_custkey, '.sql') AS path")
    skip = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 7 = 0").selectExpr("concat('d/q', o_custkey, '.sql') AS path")
    return sources.matching(files, exclude=skip)


@_query("SELECT 'p' || c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS category FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def bad_file_merge(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    of = lambda k, name: c.where(F.col("c_custkey") % k == 0).select(F.concat(F.lit("p"), "c_custkey").alias("path"), F.lit(name).alias("category"))
    return rewrite.merged_bad_files(of(2, "old"), of(3, "new"))


@_query("SELECT doc_id, md5(translate(text, chr(9) || chr(10) || chr(13), '   ')) AS cleaned FROM documents")
def tsv_clean(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(sinks.clean(F.col("text"))).alias("cleaned"))


@_query("SELECT concat('q', c_custkey, '.sql') AS path, CASE c_custkey % 8 WHEN 5 THEN 0 WHEN 6 THEN 2 WHEN 7 THEN 0 ELSE 1 END AS select_block_count FROM customer")
def select_block_counts(spark, sf_dir):
    return _scan(spark, sf_dir, ScanOptions()).stats().select("path", "select_block_count")


@_query("SELECT concat('q', c_custkey, '.sql') AS path, 'Y' AS in_comment FROM customer WHERE c_custkey % 8 = 6")
def findings_in_comment_spans(spark, sf_dir):
    corpus = statements(spark, sf_dir, dealt=True)
    spans = _scan(spark, sf_dir, ScanOptions()).findings().select(F.col("file").alias("path"), "start_offset")
    return token_ops.in_comment(spans, tokens(corpus)).where("in_comment = 'Y'").select("path", "in_comment")
