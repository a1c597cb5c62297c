"""Silence between speech chunks, and segments moved out of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlatrace.operators.sequence import sharded, within

RATE = 16_000


def silences(chunks: DataFrame, jobs: DataFrame, extend_s: float = 0.2) -> DataFrame:
    """The pause after each chunk, widened by extend_s on both sides: (job_id, chunk_no, pause_start, pause_end) in seconds.

    The last pause goes on to the end of the recording; a job whose duration isn't known has none there. Silence before the
    first chunk is no pause. Chunks without a bound are left out, repeated ones count once.
    """
    rows = chunks.where("job_id is not null and start_sample is not null and end_sample is not null").dropDuplicates(["job_id", "chunk_no"])
    rows = sharded(rows.select("job_id", "chunk_no", "start_sample", "end_sample"), "job_id", "chunk_no")
    heads = rows.groupBy("job_id", "shard").agg(F.min_by("start_sample", "chunk_no").alias("head"))
    heads = heads.select("job_id", "shard", F.lead("head").over(Window.partitionBy("job_id").orderBy("shard")).alias("next_head"))
    rows = rows.join(heads, ["job_id", "shard"]).withColumn("next_start", F.coalesce(F.lead("start_sample").over(within("job_id", "chunk_no")), F.col("next_head")))
    rows = rows.join(jobs.select("job_id", F.when(~F.isnan("duration_s"), F.col("duration_s")).alias("duration_s")), "job_id", "left")
    stop = F.when(F.col("next_start").isNotNull(), F.col("next_start") / F.lit(float(RATE)) + F.lit(extend_s)).otherwise(F.col("duration_s") + F.lit(extend_s))
    out = rows.select("job_id", "chunk_no", (F.col("end_sample") / F.lit(float(RATE)) - F.lit(extend_s)).alias("pause_start"), stop.alias("pause_end"))
    return out.where("pause_end is not null")


def snap(segments: DataFrame, pauses: DataFrame, extend_s: float = 0.2, bucket_s: int = 60) -> DataFrame:
    """Segments with bounds (job_id, seg_no, start_s, end_s) moved out of the pauses they lie in: snapped_start, snapped_end.

    The pauses are gone through in order, and a moved bound is tested against the next one again, so the result is a fold, over
    the few pauses that touch the segment. A segment with both bounds in one pause comes out with a negative length.
    """
    first = lambda c: F.floor(c / F.lit(bucket_s))
    p = pauses.where("pause_end > pause_start").select(
        F.col("job_id").alias("p_job"), "pause_start", "pause_end", F.explode(F.sequence(first(F.col("pause_start")), first(F.col("pause_end")))).alias("p_bucket")
    )
    seg = segments.where("job_id is not null and seg_no is not null and start_s is not null and end_s is not null")
    low, high = F.least("start_s", "end_s"), F.greatest("start_s", "end_s")
    s = seg.select("job_id", "seg_no", "start_s", "end_s", F.explode(F.sequence(first(low), first(high))).alias("bucket"))
    meet = (
        (s.job_id == p.p_job) & (s.bucket == p.p_bucket) & (p.pause_end > F.least(s.start_s, s.end_s)) & (p.pause_start <= s.end_s)
        & (s.bucket == F.greatest(F.floor(F.least(s.start_s, s.end_s) / F.lit(bucket_s)), F.floor(p.pause_start / F.lit(bucket_s))))
    )
    near = s.join(p, meet, "left").groupBy("job_id", "seg_no").agg(
        F.first("start_s").alias("start_s"), F.first("end_s").alias("end_s"),
        F.array_sort(F.collect_list(F.when(F.col("p_job").isNotNull(), F.struct("pause_start", "pause_end")))).alias("near"),
    )

    def move(b, x):
        inside = lambda v: (v > x["pause_start"]) & (v < x["pause_end"])
        reached = x["pause_start"] <= b["e"]
        return F.struct(
            F.when(reached & inside(b["s"]), x["pause_end"] - F.lit(extend_s)).otherwise(b["s"]).alias("s"),
            F.when(reached & inside(b["e"]), x["pause_start"] + F.lit(extend_s)).otherwise(b["e"]).alias("e"),
        )

    moved = F.aggregate("near", F.struct(F.col("start_s").alias("s"), F.col("end_s").alias("e")), move)
    return near.select("job_id", "seg_no", "start_s", "end_s", moved.alias("m")).select("job_id", "seg_no", "start_s", "end_s", F.col("m.s").alias("snapped_start"), F.col("m.e").alias("snapped_end"))
