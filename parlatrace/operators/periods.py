"""Continuous periods of overlapping intervals, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_MS = 3_600_000


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", shard_ms: int = SHARD_MS) -> DataFrame:
    """(keys.., kind, start_ms, end_ms): the `period` rows of each entity and a `gap` row between consecutive ones.

    Intervals are in whole ms. Those that overlap, nest or touch make one period. Rows with a null key or bound, or a length of
    zero or below, take no part; repeated rows change nothing; other columns are ignored; an empty table gives an empty result.

    Sessions: every interval is a session that lasts as long as itself, and session_window merges the ones that overlap. That
    happens per entity and stretch of time, so that an entity that holds a large part of all rows is spread. The sessions are
    then held against the latest end before them, in their own stretch and, by one summary row per stretch, in the earlier
    ones: those starting later than it begin a period, which joins what touches or reaches over a stretch. A period ends with the latest end before the next one
    begins, and lead gives that next one, again within the stretch or from the summaries of the later ones.
    """
    k = [F.col(c) for c in keys]
    usable = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start))
    for c in k:
        usable = usable & c.isNotNull()
    rows = intervals.where(usable).select(*keys, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
    rows = rows.withColumn("_shard", F.floor(F.col("_s") / F.lit(shard_ms)))
    lasts = F.make_interval(secs=((F.col("_e") - F.col("_s")) / 1000).cast("decimal(18,6)"))
    sessions = rows.groupBy(*keys, "_shard", F.session_window(F.timestamp_millis(F.col("_s")), lasts).alias("_w")).agg(F.count("*").alias("_n"))
    # with the count in use, all readers of the sessions want the same columns and share one scan and one shuffle
    sessions = sessions.where("_n > 0").select(*keys, "_shard", F.unix_millis("_w.start").alias("_s"), F.unix_millis("_w.end").alias("_e"))

    own = Window.partitionBy(*keys, "_shard").orderBy("_s", "_e")
    stretch = Window.partitionBy(*keys).orderBy("_shard")
    before, after = stretch.rowsBetween(Window.unboundedPreceding, -1), stretch.rowsBetween(1, Window.unboundedFollowing)

    ends = sessions.groupBy(*keys, "_shard").agg(F.max("_e").alias("_max"))
    ends = ends.select(*keys, "_shard", F.max("_max").over(before).alias("_carry"))
    sessions = sessions.join(ends, [*keys, "_shard"])
    reached = F.greatest(F.max("_e").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    sessions = sessions.withColumn("_reached", reached)
    opens = F.col("_reached").isNull() | (F.col("_s") > F.col("_reached"))
    firsts = sessions.withColumn("_opens", opens)

    summary = firsts.groupBy(*keys, "_shard").agg(F.max("_e").alias("_max"), F.min(F.when(F.col("_opens"), F.struct("_s", "_reached"))).alias("_first"))
    summary = summary.select(
        *keys, "_shard", F.first("_first", True).over(after).alias("_next"), F.max("_max").over(stretch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last")
    )
    # within a stretch, the next row that opens a period
    begun = firsts.where("_opens").withColumn("_lead", F.lead(F.struct("_s", "_reached")).over(own)).join(summary, [*keys, "_shard"])
    upcoming = F.coalesce("_lead", "_next")
    begun = begun.select(*keys, "_s", F.coalesce(upcoming["_reached"], F.col("_last")).alias("_end"), upcoming["_s"].alias("_then"))
    period = F.struct(F.lit("period").alias("kind"), F.col("_s").alias("start_ms"), F.col("_end").alias("end_ms"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("_end").alias("start_ms"), F.col("_then").alias("end_ms"))
    return begun.select(*keys, F.explode(F.when(F.col("_then").isNotNull(), F.array(period, gap)).otherwise(F.array(period))).alias("r")).select(*keys, "r.kind", "r.start_ms", "r.end_ms")
