import random

import numpy as np
import pytest

from parlatrace.llm.nearest import ERROR, lower_bounds, nearest_in_time, pieces

SCHEMA = "job_id bigint, edge int, no int, t bigint"


def brute(queries, table, tolerance):
    out = set()
    for j, e, no, t in queries:
        if None in (j, e, no, t):
            continue
        near = [(abs(v - t), n) for jj, ee, n, v in table if None not in (jj, ee, n, v) and (jj, ee) == (j, e) and abs(v - t) <= tolerance]
        if near:
            away, n = min(near)
            out.add((j, e, no, n, away))
    return sorted(out)


@pytest.mark.parametrize("kind", ["even", "bursts", "one", "far"])
def test_learned_index_is_exact(kind):
    rng = np.random.default_rng(4)
    keys = {"even": np.arange(0, 50_000, 7), "bursts": np.unique(np.concatenate([rng.integers(a, a + 50, 40) for a in range(0, 10**6, 50_000)])), "one": np.array([5]), "far": np.array([0, 1, 2, 2**40, 2**41])}[kind]
    firsts, slopes = pieces(keys)
    queries = np.concatenate([keys, keys + 1, keys - 1, rng.integers(-100, keys[-1] + 100, 500)])
    assert (lower_bounds(keys, firsts, slopes, queries) == np.searchsorted(keys, queries)).all()
    ends = np.append(firsts[1:], len(keys))
    for a, b, s in zip(firsts, ends, slopes, strict=True):  # every key is predicted to within the error
        assert (np.abs(a + s * (keys[a:b] - keys[a]) - np.arange(a, b)) <= ERROR + 1e-6).all()
    assert len(lower_bounds(np.array([], dtype=int), firsts, slopes, queries)) == len(queries)


@pytest.mark.parametrize("shard", [1100, 5000, 600_000])
def test_random(spark, rows, shard):
    rng = random.Random(shard)
    make = lambda n: [(rng.randrange(3), rng.randrange(2), i, rng.randrange(-3000, 30_000)) for i in range(n)]
    queries, table = make(300), make(200)
    queries += queries[:30]
    table += table[:30] + [(j, e, n + 1000, t) for j, e, n, t in table[:20]]
    out = nearest_in_time(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(table, SCHEMA), ["job_id", "edge"], 500, shard)
    assert rows(out) == brute(queries, table, 500)


def test_edges(spark, rows):
    table = [(1, 0, 9, 1000), (1, 0, 4, 2000), (1, 0, 2, 2000), (None, 0, 1, 1), (1, 0, None, 5), (1, 0, 3, None)]
    queries = [(1, 0, 1, 1500), (1, 0, 2, 1501), (1, 0, 3, 500), (1, 0, 4, 499), (2, 0, 5, 1000), (1, 0, None, 1000), (1, 0, 7, None), (1, 1, 8, 1000)]
    q, k = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(table, SCHEMA)
    want = [(1, 0, 1, 2, 500), (1, 0, 2, 2, 499), (1, 0, 3, 9, 500)]
    assert rows(nearest_in_time(q, k, ["job_id", "edge"], 500, 2000)) == want
    clash = q.selectExpr("*", "1 as _shard", "2 as _side", "3 as match_no", "4 as away")
    assert rows(nearest_in_time(clash, k.selectExpr("*", "0 as _t"), ["job_id", "edge"], 500, 2000)) == want
    assert nearest_in_time(q.limit(0), k, ["job_id", "edge"], 500).count() == nearest_in_time(q, k.limit(0), ["job_id", "edge"], 500).count() == 0


def test_group_longer_than_a_batch(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        table, queries = [(1, 0, i, 10 * i) for i in range(200)], [(1, 0, i, 10 * i + 4) for i in range(200)]
        assert rows(nearest_in_time(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(table, SCHEMA), ["job_id", "edge"], 5)) == [(1, 0, i, i, 4) for i in range(200)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
