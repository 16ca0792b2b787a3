"""Every registered query with SQL gives the rows that DuckDB gives for it."""

from collections import Counter
from pathlib import Path

import pytest

from sqlquarry.plans import feature_queries, queries

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.is_dir():
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_feature_queries_are_registered():
    assert queries.QUERIES["join_forms"] is feature_queries.join_forms


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    answer = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in answer.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = Counter(tuple(str(r[names.index(c)]) for c in cols) for r in answer.fetchall())
    assert Counter(tuple(str(r[c]) for c in cols) for r in df.collect()) == want
