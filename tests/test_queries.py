"""Every query with SQL against DuckDB on the smallest tables; the others must run and keep their columns."""

import math
from collections import Counter
from pathlib import Path

import pytest

from parlatrace.plans import core, oracle

DATA = Path("/root/testdata/sf0.001")


def tables(con, folder=DATA):
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p if p.is_file() else p / '*.parquet'}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def same(spark, query, sql, folder=DATA):
    import duckdb

    df = query(spark, str(folder))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = tables(duckdb.connect(), folder).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", list(oracle.ORACLE))
def test_against_sql(spark, name):
    same(spark, core.QUERIES[name], oracle.ORACLE[name])


@pytest.mark.parametrize("name", [n for n in core.QUERIES if n not in oracle.ORACLE])
def test_runs(spark, name):
    assert core.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_without_the_subpackage(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
