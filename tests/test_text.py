"""Lexing, chunking, scopes and detection on texts alone."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sqlquarry.functions.lex import chunks, lex, quality
from sqlquarry.functions.scan_text import scan_text
from sqlquarry.functions.scope import Scopes
from sqlquarry.options import ScanOptions

ALL = ScanOptions.metadata()


def found(text, **o):
    return [(f["column_name"], f["operator"], f["value"], f["line"], f["in_comment"]) for f in scan_text(text, ScanOptions(**o))["findings"]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aS'\"-/*\n ;().1eE홍#ₓ\\", max_size=40))
def test_tokens_and_errors_tile_the_text(text):
    tokens, errors = lex(text)
    pieces = sorted([(t.start, t.text) for t in tokens] + [(e.start, e.text) for e in errors])
    assert "".join(p for _, p in pieces) == text
    assert sum(map(len, chunks(tokens)), 0) == len(tokens)


def test_lexer_shapes():
    kinds = lambda s: [t.type for t in lex(s)[0] if not t.hidden]
    assert kinds("'it''s' 1 1.5 .5e3 x1 <> ||") == ["STRING_LITERAL", "DECIMAL_LITERAL", "FLOAT_LITERAL", "REAL_LITERAL", "ID", "<>", "||"]
    assert [t.type for t in lex("/* a /* b */ c */ x")[0]] == ["SQL_COMMENT", "WHITE_SPACE", "ID"]
    assert len(lex('""')[1]) == 1 and len(lex('"abc')[1]) == 1
    assert kinds("'opened") == ["SINGLE_QUOTE", "ID"] and kinds("/* opened") == ["/", "*", "ID"]


def test_detection():
    assert found("SELECT 1 FROM T WHERE ACCT_ID\n = '1'") == [("ACCT_ID", "=", "'1'", 1, "N")]
    assert found("SELECT 1 FROM T WHERE '1' = T.CTRT_NO AND ACCT_NM NOT LIKE 'a%'") == [("CTRT_NO", "=", "'1'", 1, "N"), ("ACCT_NM", "NOT LIKE", "'a%'", 1, "N")]
    assert found("SELECT 1 FROM T WHERE ACCT_ID IN (SELECT X FROM U WHERE CTRT_NO = '0000123')") == [("CTRT_NO", "=", "'0000123'", 1, "N")]
    assert found("SELECT 1 FROM T WHERE ACCT_ID_X = '1' AND ACCT_ID = B.ACCT_ID AND ACCT_ID = :H AND CTRT_NO IS NOT NULL") == []
    assert found("WHERE ACCT_ID = 12345") == [("ACCT_ID", "=", "12345", 1, "N")]
    assert found("WHERE ACCT_ID IN (('1'), '2')") == [("ACCT_ID", "IN", "'1'", 1, "N"), ("ACCT_ID", "IN", "'2'", 1, "N")]
    assert found("/* x -- ACCT_ID = '1'\n ACCT_ID = '2' */ SELECT '-- ACCT_ID = 3' FROM T")[-1] == ("ACCT_ID", "=", "'2'", 2, "Y")
    assert found('WHERE ACCT_ID = "0001"') == [("ACCT_ID", "=", '"0001"', 1, "N")]
    assert found("INSERT INTO T (ACCT_ID, B) VALUES ('1', '2')") == []
    assert found("INSERT INTO T (ACCT_ID, B) VALUES ('1', '2')", detect_insert_values=True) == [("ACCT_ID", "=", "'1'", 1, "N")]


def test_names():
    text = "SELECT '홍길동', \"김영희\" FROM T"
    assert scan_text(text, ScanOptions(stopwords=frozenset({"김영희"})))["names"] == ["홍길동"]
    assert found(text, known_names=frozenset({"홍길동"})) == [("-", "-", "'홍길동'", 1, "N")]


def test_quality():
    assert quality(*lex("========\nSELECT 1"))[0] == "repeated-char-run"
    assert quality(*lex("####$$$$@@@@ a"))[0] == "lexer-error-ratio"
    assert quality(*lex("")) is None and quality(*lex("SELECT ((((( 1")) is None


def core(text, tier=("TBL", "JOINTYPE", "REL", "SHAPE")):
    facts = scan_text(text, ALL)["identities"][0]["facts"]
    return hashlib.sha256("\n".join(sorted(f for f in facts if f.split("|")[0] in tier)).encode()).hexdigest()[:16], facts


BASE = """SELECT A.ACCT_ID, CASE WHEN C.STAT_CD = '1' THEN A.AMT * 1.05 ELSE 0 END AS Z FROM TBACCT A
INNER JOIN TBCTRT B ON A.ACCT_ID = B.ACCT_ID {join} JOIN TBSTAT C ON B.CTRT_NO = C.CTRT_NO
INNER JOIN TBSAMPLE001 D ON A.ACCT_ID = D.ACCT_ID {more} WHERE A.X_CD = '1' AND B.Y_CD = '2' AND C.Z_CD = '3' GROUP BY A.ACCT_ID"""


def test_golden_identities():
    assert core(BASE.format(join="LEFT", more=""))[0] == "88499a34355030b2"
    assert core(BASE.format(join="INNER", more=""))[0] == "c776b2874f3f34d5"
    assert core(BASE.format(join="LEFT", more="LEFT JOIN TBCODE E ON B.CTRT_TYPE_CD = E.CODE_CD"))[0] == "a421ecfeb3c7f8ac"
    assert core("SELECT A.X FROM TBACCT A WHERE A.X = '1'")[0] == "a19c38a2b3e49b39"
    assert core("SELECT * FROM TBEMP A JOIN TBDEPT B ON A.DEPT_CD = B.DEPT_CD LEFT JOIN TBPOS C ON A.POS_CD = C.POS_CD")[0] == "c818abc3f123eed0"


def test_golden_similarity():
    a, b, c = (set(core(BASE.format(join=j, more=m))[1]) for j, m in (("LEFT", ""), ("INNER", ""), ("LEFT", "LEFT JOIN TBCODE E ON B.CTRT_TYPE_CD = E.CODE_CD")))
    assert len(a) == 13
    assert round(len(a & b) / len(a | b), 3) == 0.786 and round(len(a & c) / len(a | c), 3) == 0.75


def scopes(text):
    return Scopes([t for t in lex(text)[0] if not t.hidden])


def test_scopes():
    assert [len(scopes(t).blocks) for t in ("SELECT 1 FROM A", "WITH C AS (SELECT 1 FROM B) SELECT * FROM C", "UPDATE T SET A = 1", "INSERT INTO T SELECT 1 FROM U", "SELECT 1 FROM A UNION SELECT 1 FROM B", "SELECT * FROM (SELECT 1 FROM A) X", "(SELECT 1 FROM A) UNION (SELECT 1 FROM B)")] == [1, 3, 1, 2, 2, 2, 3]
    s = scopes("SELECT * FROM S.A X JOIN B USING (K) CROSS JOIN C, D WHERE X.K = 1")
    assert [(t.schema, t.table, t.alias) for t in s.tables()] == [("S", "A", "X"), ("(no-schema)", "B", None), ("(no-schema)", "C", None), ("(no-schema)", "D", None)]
    assert [(c.join_type, c.predicate) for c in s.connectors()] == [("JOIN", "(K)"), ("CROSS", ""), ("COMMA", "")]
    assert [t.table for t in scopes("SELECT EXTRACT(YEAR FROM D) FROM A WHERE X IS DISTINCT FROM Y FOR UPDATE OF C").tables()] == ["A"]
    assert [t.table for t in scopes("WITH RECURSIVE R(N) AS (SELECT 1 FROM A) SELECT * FROM R").tables()] == ["A"]
    assert [t.table for t in scopes("SELECT 1 FROM A JOIN B ON A.X = B.X UNION SELECT 1 FROM C JOIN D ON C.X = D.X").tables()] == ["A", "B", "C", "D"]


def test_exists_is_not_join():
    exists = "SELECT 1 FROM TBACCT A WHERE EXISTS (SELECT 1 FROM TBCTRT B WHERE B.ACCT_ID = A.ACCT_ID)"
    row = scan_text(exists, ALL)["identities"][0]
    assert row["has_subquery"] and core(exists)[0] != core("SELECT 1 FROM TBACCT A JOIN TBCTRT B ON A.ACCT_ID = B.ACCT_ID")[0]


def test_functions():
    rows = scan_text("SELECT NOW(), UPPER(LOWER(A.X)) FROM T A WHERE A.Y BETWEEN 1 AND 2 AND A.Z IS NULL", ALL)["functions"]
    assert [(r["function"], r["parameters"]) for r in rows] == [("NOW", ""), ("UPPER", "LOWER(A.X)"), ("LOWER", "A.X"), ("BETWEEN", "A.Y, 1, 2"), ("IS NULL", "A.Z")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="SELECTFROMWHR ACCT_ID='1'();,.\n-", max_size=60))
def test_no_text_crashes(text):
    bad = scan_text(text, ALL)["bad"]
    assert bad is None or bad["category"] != "crash"


def test_long_lists_lose_nothing():
    n = 210_000
    r = scan_text("SELECT 1 FROM T WHERE ACCT_ID IN (" + ",".join(f"'{i}'" for i in range(n)) + ") AND CTRT_NO = '7'", ScanOptions())
    assert r["bad"] is None and len(r["findings"]) == n + 1 and r["n_partial"] == 0
    cut = scan_text("SELECT 1 FROM T WHERE " + "] } " * 50 + " ACCT_ID = '1'", ScanOptions(max_chunk_iterations=10))
    assert cut["n_partial"] == 1  # said, and the window scan still finds the literal
    assert [f["value"] for f in cut["findings"]] == ["'1'"]


def test_deep_texts():
    deep = 1500
    r = scan_text("/*" * deep + " ACCT_ID = '5' " + "*/" * deep + "\nSELECT 1 FROM T WHERE ACCT_ID = '8'", ScanOptions())
    assert [(f["line"], f["value"], f["in_comment"]) for f in r["findings"]] == [(1, "'5'", "Y"), (2, "'8'", "N")]
    r = scan_text("SELECT 1 FROM T WHERE X = " + "(1 + " * deep + "2" + " )" * deep + " AND ACCT_ID = '8'", ScanOptions())
    assert r["bad"] is None or r["bad"]["category"] == "repeated-char-run"
    r = scan_text("SELECT 1 FROM T WHERE X IN " + "(SELECT Y FROM U WHERE ACCT_ID = '1' AND Y IN " * 400 + "('5') OR Z = 1 " + ") OR Z = 2 " * 400, ScanOptions())
    assert r["bad"] is None and len(r["findings"]) == 400


def test_long_dividers_take_linear_time():
    import time

    began = time.perf_counter()
    assert scan_text("=" * 300_000, ScanOptions())["bad"]["category"] == "repeated-char-run"
    assert time.perf_counter() - began < 20


def test_merge_and_definitions():
    on = ScanOptions.metadata()
    r = scan_text("MERGE INTO S1.TBACCT A USING (SELECT ACCT_ID, NM FROM STG) B ON A.ACCT_ID = B.ACCT_ID WHEN MATCHED AND A.ST = '9' THEN UPDATE SET A.ACCT_NM = '12' WHEN NOT MATCHED THEN INSERT (ACCT_ID) VALUES (B.ACCT_ID);", on)
    assert [(t["schema"], t["table"]) for t in r["tables"]] == [("S1", "TBACCT"), ("(no-schema)", "STG")]
    assert [(f["column_name"], f["value"]) for f in r["findings"]] == [("ACCT_NM", "'12'")]
    assert "B" not in {c["column"] for c in r["columns"]} and ("TBACCT", "ST") in {(c["table"], c["column"]) for c in r["columns"]}
    for text in ("CREATE TABLE S1.T1 (ACCT_ID CHAR(10) NOT NULL, AMT DECIMAL(15,2), PRIMARY KEY (ACCT_ID)) IN TS1;", "ALTER TABLE T1 ADD COLUMN X INT;", "GRANT SELECT ON T1 TO U;", "DROP VIEW V1;", "CREATE INDEX I1 ON T1 (A, B);"):
        r = scan_text(text, on)
        assert r["columns"] == r["functions"] == r["identities"] == [], text
    r = scan_text("CREATE VIEW V1 AS SELECT A.X FROM T1 A JOIN T2 B ON A.K = B.K WHERE A.ACCT_ID = '5';", on)
    assert {c["column"] for c in r["columns"]} == {"X", "K", "ACCT_ID"} and len(r["edges"]) == len(r["findings"]) == len(r["identities"]) == 1
    r = scan_text("CREATE TABLE T (A INT CHECK (ACCT_ID = '7'));", on)
    assert [f["value"] for f in r["findings"]] == ["'7'"]
