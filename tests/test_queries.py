"""Every query that has SQL gives what the SQL gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from proofline.plans import audits, reconciliation, sequences, streams, values

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = {n: (q, m.ORACLE_SQL.get(n)) for m in (values, reconciliation, sequences, audits, streams) for n, q in m.QUERIES.items()}


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir_module):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir_module}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def sf_dir_module():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, sf_dir_module, name):
    query, sql = CORE[name]
    assert sql, "every query of the core has SQL"
    got = query(spark, sf_dir_module)
    columns = sorted(got.columns)
    wanted = duck.sql(sql)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    assert sorted(tuple(text(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(text(r[i]) for i in at) for r in wanted.fetchall())


def test_entry_points(spark):
    assert set(CORE) <= set(entry_points.queries()) and set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert os.path.exists("/root/testdata/sf0.001") and entry_points.entry(spark).count() > 0
