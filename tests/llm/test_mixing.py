import random

import pytest
from pyspark.sql import functions as F

from parlatrace.llm.mixing import mixed, plan_mix, shares, source_name

ITEMS = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def data(seed=1, n=3000):
    rng = random.Random(seed)
    return [(i, rng.choice("aaaaaaabbc"), int(rng.lognormvariate(5, 1)) + 1) for i in range(n)]


MIX = [("m", "a", 0.5, 3), ("m", "b", 0.3, 3), ("m", "c", 0.1, 3), ("m", "none", 0.1, 3), ("n", "a", 1.0, 2), ("n", "b", 0.0, 2)]


def test_shares(spark, rows):
    items, targets = spark.createDataFrame(data(), ITEMS), spark.createDataFrame(MIX, TARGETS)
    chosen = mixed(items, targets)
    report = {(r.mix_name, r.source): r for r in shares(items, targets, chosen).collect()}
    for source, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert report["m", source].actual_share == pytest.approx(share, abs=0.01)
    assert report["m", "none"].actual_share == 0 and report["n", "b"].chosen_tokens == 0 and report["n", "a"].actual_share == 1
    assert max(r.most_copies for r in report.values()) <= 3 and report["n", "a"].most_copies == 2
    assert rows(chosen) == rows(mixed(items.repartition(7), targets))  # the same whatever the layout
    assert rows(chosen) != rows(mixed(items, targets, seed=2))


def test_against_plain_sampling(spark, rows):
    """One source: prefix sums over documents in order, one offset, one copy per whole number crossed."""
    items = spark.createDataFrame(data(3, 500), ITEMS)
    targets = spark.createDataFrame([("m", "a", 0.6, 2), ("m", "b", 0.4, 2)], TARGETS)
    rates = {r.source: r.rate for r in plan_mix(items, targets).collect()}
    got = {(r.source, r.doc_id): r.copies for r in mixed(items, targets).collect()}
    for source, rate in rates.items():
        mine = [d for d in data(3, 500) if d[1] == source]
        total = sum(got.get((source, d[0]), 0) for d in mine)
        assert abs(total - rate * len(mine)) <= 1
        assert all(int(rate) <= got.get((source, d[0]), 0) <= int(rate) + 1 for d in mine)


def test_edges(spark, rows):
    items = [(1, "a", 10), (2, "a", None), (3, "a", 0), (4, None, 5), (None, "a", 7), (5, "b", 1)]
    df = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as rate", "2 as copies", "'x' as mix_name")
    targets = spark.createDataFrame([("m", "a", 1.0, 2), ("m", "b", None, 2), (None, "a", 1.0, 1), ("m", None, 1.0, 1)], TARGETS)
    assert {r[0] for r in rows(mixed(df, targets), "doc_id")} <= {1}
    assert mixed(df.limit(0), targets).count() == mixed(df, targets.limit(0)).count() == 0
    names = spark.createDataFrame([(" Meeting_Recorder ",), ("meeting recorder",), ("",), (None,)], "s string")
    assert [r[0] for r in names.select(source_name(F.col("s"))).collect()] == ["meeting-recorder", "meeting-recorder", None, None]


def test_equal_sizes_spread(spark):
    """A source of one size only, a third of all rows, is sampled at its rate."""
    items = [(i, "a" if i % 3 else "b", 100) for i in range(3000)]
    out = mixed(spark.createDataFrame(items, ITEMS), spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], TARGETS))
    assert {r.source: r["count"] for r in out.groupBy("source").count().collect()} == {"a": 1000, "b": 1000}


def test_a_mix_of_a_size(spark, monkeypatch):
    from parlatrace.llm import mixing

    monkeypatch.setattr(mixing, "ROWS_A_SPREAD", 10)  # many hashes: the shares stay
    items, targets = spark.createDataFrame(data(), ITEMS), spark.createDataFrame(MIX[:3], TARGETS)
    out = mixed(items, targets, most=60_000).selectExpr("source", "n_tokens * copies as t").groupBy("source").sum("t").collect()
    got = {r.source: r[1] for r in out}
    assert sum(got.values()) == pytest.approx(60_000, rel=0.03) and got["a"] / sum(got.values()) == pytest.approx(5 / 9, abs=0.02)
