"""Who speaks a segment: the turn that overlaps it best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlatrace.functions.labels import with_speaker
from parlatrace.functions.time import seconds_to_ms

BUCKET_MS = 60_000


def timed_segments(segments: DataFrame) -> DataFrame:
    """Segments with both bounds, in ms: (job_id, seg_no, start_ms, end_ms, text). Segments without a bound have no place in time and are left out."""
    return segments.select("job_id", "seg_no", seconds_to_ms(F.col("start_s")).alias("start_ms"), seconds_to_ms(F.col("end_s")).alias("end_ms"), "text").where(
        "job_id is not null and seg_no is not null and start_ms is not null and end_ms is not null"
    )


def named_turns(turns: DataFrame) -> DataFrame:
    """Turns with both bounds whose label names a speaker: (job_id, turn_no, start_ms, end_ms, speaker)."""
    whole = turns.select("job_id", "turn_no", "start_ms", "end_ms", "label").where("job_id is not null and start_ms is not null and end_ms is not null")
    return with_speaker(whole).where("speaker is not null")


def attribute(segments: DataFrame, turns: DataFrame, threshold: float = 0.8, bucket_ms: int = BUCKET_MS, texts: bool = True) -> DataFrame:
    """Segments (as timed_segments) with their speaker ('' where none) and whether the speech overlaps.

    A turn's share is (overlap + 1) / length of the segment, touching included. Of the turns with a share of at least the
    threshold the shortest wins, the earliest of equals; it counts as overlapping if another of them came first. Without such a
    turn the largest share wins, the earliest of equals. Segments of no or negative length get ''. Turns are taken in order of
    start, then of number. Repeated turns change nothing. Without texts the column text is left out.

    Both sides meet in buckets of time, so that a long recording spreads; a pair is looked at in the first bucket both have.
    """
    first = lambda c: F.floor(F.col(c) / F.lit(bucket_ms))
    turn = turns.where("end_ms >= start_ms").select(
        F.col("job_id").alias("t_job"), "turn_no", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end"), F.col("speaker").alias("t_speaker"),
        F.explode(F.sequence(first("start_ms"), first("end_ms"))).alias("t_bucket"),
    )
    usable = F.col("end_ms") > F.col("start_ms")
    seg = segments.select("job_id", "seg_no", "start_ms", "end_ms", F.explode(F.when(usable, F.sequence(first("start_ms"), first("end_ms"))).otherwise(F.array(first("start_ms")))).alias("bucket"))
    meet = (
        (seg.job_id == turn.t_job) & (seg.bucket == turn.t_bucket) & (turn.t_start <= seg.end_ms) & (turn.t_end >= seg.start_ms) & (seg.end_ms > seg.start_ms)
        & (seg.bucket == F.greatest(F.floor(seg.start_ms / F.lit(bucket_ms)), F.floor(turn.t_start / F.lit(bucket_ms))))
    )
    share = (F.least("end_ms", "t_end") - F.greatest("start_ms", "t_start") + 1) / (F.col("end_ms") - F.col("start_ms")).cast("double")
    pairs = seg.join(turn, meet, "left").withColumn("share", F.when(F.col("t_job").isNotNull(), share))
    fits = F.col("share") >= threshold
    rank = F.struct("t_start", "turn_no")
    best = pairs.groupBy("job_id", "seg_no").agg(
        F.min("start_ms").alias("start_ms"), F.min("end_ms").alias("end_ms"),
        F.min(F.when(fits, F.struct((F.col("t_end") - F.col("t_start")).alias("len"), rank.alias("rank"), F.col("t_speaker").alias("speaker")))).alias("fit"),
        F.min(F.when(fits, rank)).alias("first_fit"),
        F.min(F.when(F.col("share") > 0, F.struct((-F.col("share")).alias("share"), rank.alias("rank"), F.col("t_speaker").alias("speaker")))).alias("most"),
    )
    found = best.select(
        "job_id", "seg_no", "start_ms", "end_ms",
        F.coalesce("fit.speaker", "most.speaker", F.lit("")).alias("new_speaker"),
        F.coalesce(F.col("fit.rank") != F.col("first_fit"), F.lit(False)).alias("overlapping"),
    )
    # texts are joined back once: they take no part in the joins and aggregates above
    return found.join(segments.select("job_id", "seg_no", "text"), ["job_id", "seg_no"]).select(*found.columns[:4], "text", *found.columns[4:]) if texts else found
