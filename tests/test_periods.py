import random

import pytest

from parlatrace.operators.periods import periods_and_gaps

SCHEMA = "job_id bigint, speaker string, start_ms bigint, end_ms bigint"


def brute(data):
    out = []
    entities = {}
    for j, sp, s, e in data:
        if j is not None and sp is not None and s is not None and e is not None and e > s:
            entities.setdefault((j, sp), []).append((s, e))
    for (j, sp), items in entities.items():
        merged = []
        for s, e in sorted(items):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(j, sp, "period", s, e) for s, e in merged]
        out += [(j, sp, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)]
    return sorted(out)


@pytest.mark.parametrize("shard", [50, 1000, 10_000_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, rows, seed, shard):
    rng = random.Random(seed)
    data = [(rng.randrange(4), f"S0{rng.randrange(2)}", s := rng.randrange(-500, 6000), s + rng.choice([-5, 0, 1, 10, 30, 400, 2500])) for _ in range(400)]
    data += data[:40]
    assert rows(periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["job_id", "speaker"], shard_ms=shard)) == brute(data)


def test_edges(spark, rows):
    data = [(1, "S00", 0, 10), (1, "S00", 10, 20), (1, "S00", 21, 30), (1, "S00", 5, 5), (1, "S00", 9, 3), (None, "S00", 0, 1), (1, None, 0, 1), (1, "S00", None, 1), (1, "S00", 0, None), (1, "S01", 3, 4)]
    want = [(1, "S00", "gap", 20, 21), (1, "S00", "period", 0, 20), (1, "S00", "period", 21, 30), (1, "S01", "period", 3, 4)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(periods_and_gaps(df, ["job_id", "speaker"])) == want
    assert rows(periods_and_gaps(df.selectExpr("*", "'x' as kind", "1 as _s", "2 as _shard", "3 as r"), ["job_id", "speaker"])) == want
    assert periods_and_gaps(df.limit(0), ["job_id", "speaker"]).count() == 0


def test_one_long_interval_over_many_shards(spark, rows):
    data = [(1, "S00", 0, 100_000)] + [(1, "S00", 100 * i, 100 * i + 10) for i in range(900)] + [(1, "S00", 100_000, 100_001), (1, "S00", 200_000, 200_001)]
    assert rows(periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["job_id", "speaker"], shard_ms=1000)) == [(1, "S00", "gap", 100_001, 200_000), (1, "S00", "period", 0, 100_001), (1, "S00", "period", 200_000, 200_001)]
