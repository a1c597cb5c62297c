"""The queries of the subpackage on the smallest tables, those with SQL against DuckDB."""

from pathlib import Path

import pytest

from parlatrace.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")

COLUMNS = {
    "p1_found": ["payload_id", "start_ms", "speaker"],
    "p2_found": ["payload_id", "kind", "start_pos"],
    "p4_found": ["payload_id", "kind"],
    "p5_found": ["job_id", "edge", "seg_no", "turn_no"],
    "p8_found": ["doc_id", "start_pos", "lang"],
}


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_against_sql(spark, name):
    from tests.test_queries import same

    same(spark, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_runs(spark, name):
    out = queries.QUERIES[name](spark, str(DATA))
    assert out.count() > 0
    if name in COLUMNS:
        assert out.columns == COLUMNS[name] and out.distinct().count() == out.count()
