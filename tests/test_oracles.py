"""Every query of the evaluation part beside its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from gradus import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    got = rows_of(df.columns, df.collect())
    assert got[1], "no rows"
    assert got == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).collect()


def test_checks_of_nulls(spark, duck, tmp_path):
    """Texts and languages that are null, as the SQL takes them."""
    duck.sql(f"COPY (SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN text END AS text, CASE WHEN doc_id % 5 <> 2 THEN lang END AS lang FROM documents) TO '{tmp_path}/documents.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    for name in ("checker_summary", "checker_results"):
        df, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
        assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
