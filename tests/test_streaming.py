from pyspark.sql import functions as F

from parlatrace.operators.attribution import timed_segments
from parlatrace.operators.paragraphs import with_gaps
from parlatrace.streaming import live

SCHEMA = "job_id bigint, seg_no int, start_s double, end_s double, text string"


def test_live_equals_batch_over_several_files(spark, rows, tmp_path):
    data = [(j, k, 3.0 * k + j, 3.0 * k + j + 1.5, "x") for j in range(3) for k in range(12)]
    for part in range(4):
        now = [r for r in data if r[1] // 3 == part]
        spark.createDataFrame([*now, now[0], (0, 0, 0.0, 1.0, "again"), (1, 90, None, 1.0, "no bound")], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/s/segments.parquet", mode="append")
    out = live.run_to_end(live.live_gaps(live.table_stream(spark, f"file://{tmp_path}/s", "segments", 1), interval_ms=6000), "test")
    want = rows(with_gaps(timed_segments(spark.createDataFrame(data, SCHEMA))), "job_id", "seg_no", "gap_ms")
    assert rows(out, "job_id", "seg_no", "gap_ms") == want
    assert [r[0] for r in rows(out.where("shown and job_id = 0"), "seg_no")] == [0, 3, 6, 9]


def test_bursts(spark, rows):
    at = lambda s: f"2025-01-01 00:00:{s:06.3f}"
    data = [("a", at(0)), ("a", at(1.5)), ("a", at(3.4)), ("a", at(9)), ("b", at(2)), (None, at(1)), ("c", None)]
    df = spark.createDataFrame(data, "path string, t string").withColumn("t", F.col("t").cast("timestamp"))
    out = live.debounced(df, "path", "t").select("path", F.date_format("last_at", "ss.SSS").alias("last"), "events")
    assert rows(out) == [("a", "03.400", 3), ("a", "09.000", 1), ("b", "02.000", 1)]


def test_failures_stay_alone(spark):
    done = []

    def handle(row):
        if row.id == 1:
            raise ValueError("bad")
        done.append(row.id)

    run = live.each_alone(handle)
    run(spark.range(3).coalesce(1), 0)
    assert done == [0, 2] and run.failed[0][2] == "bad"
