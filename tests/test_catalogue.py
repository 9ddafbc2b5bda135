"""Every query against its SQL twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from leadloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    out = catalogue.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted(tuple(map(plain, r)) for r in out.select(columns).collect())
    if name in catalogue.ORACLES:
        rel = sql.sql(catalogue.ORACLES[name])
        assert sorted(rel.columns) == columns
        rows = rel.select(", ".join(f'"{c}"' for c in columns)).fetchall()
        assert got == sorted(tuple(map(plain, r)) for r in rows)
