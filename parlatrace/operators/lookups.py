"""Joins by key: languages, prompts, model paths, and lists matched by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most limit rows, as it is otherwise; the count looks at no more than that."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def language_codes(jobs: DataFrame, languages: DataFrame, column: str = "language_name", strict: bool = False) -> DataFrame:
    """jobs with language_code: the column may hold a code or a name, codes are tried first, in any case.

    A value that is neither gives null, or ends the query where strict; so does null.
    """
    known = languages.where("name is not null and code is not null")
    either = known.select(F.lower("code").alias("_value"), F.col("code").alias("_code"), F.lit(0).alias("_rank")).union(known.select(F.lower("name"), F.col("code"), F.lit(1)))
    either = either.groupBy("_value").agg(F.min(F.struct("_rank", "_code"))["_code"].alias("language_code"))
    out = jobs.join(small(either), F.lower(F.trim(F.col(column))) == F.col("_value"), "left").drop("_value")
    if strict:
        out = out.withColumn("language_code", F.coalesce("language_code", F.raise_error(F.concat(F.lit("unknown language: "), F.coalesce(F.col(column), F.lit("null")))).cast("string")))
    return out


def with_prompts(jobs: DataFrame, prompts: DataFrame, code: str = "language_code") -> DataFrame:
    """jobs with the hint text of their language, '' where there is none. prompts: (code, prompt), one row per code."""
    return jobs.join(small(prompts.select(F.col("code").alias("_c"), "prompt")), F.col(code) == F.col("_c"), "left").drop("_c").withColumn("prompt", F.coalesce("prompt", F.lit("")))


def recognition_language(code: Column, model_is_english: Column) -> Column:
    """struct(language, multilingual, detect): English for an English model; none and a flag for 'multilingual'; none and detection for 'auto'; else the code."""
    low = F.lower(code)
    return F.struct(
        F.when(model_is_english, "en").when(low.isin("multilingual", "auto"), F.lit(None).cast("string")).otherwise(low).alias("language"),
        (~model_is_english & (low == "multilingual")).alias("multilingual"),
        (~model_is_english & (low == "auto")).alias("detect"),
    )


def zipped(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Two lists matched by position; a position only one of them has is left out."""
    return left.join(right, ordinal)


def calendar_matches(meetings: DataFrame, events: DataFrame, minutes: int = 5) -> DataFrame:
    """Each meeting (meeting_id, started_at) with the calendar event (event_id, event_start) nearest in time, at most `minutes` away.

    Ties go to the lower event_id. Events are looked up in time buckets as wide as the tolerance. Meetings without a match, or
    without a time, are left out.
    """
    width = minutes * 60_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    m = meetings.select("meeting_id", "started_at", micros("started_at").alias("_m")).where("_m is not null")
    m = m.withColumn("_b", F.explode(F.array(*[F.floor(F.col("_m") / width) + d for d in (-1, 0, 1)])))
    e = events.select("event_id", "event_start", micros("event_start").alias("_e")).where("_e is not null").withColumn("_b", F.floor(F.col("_e") / width))
    away = F.abs(F.col("_m") - F.col("_e"))
    near = m.join(e, "_b").where(away <= width)
    return near.groupBy("meeting_id").agg(F.first("started_at").alias("started_at"), F.min(F.struct(away.alias("away"), "event_id", "event_start")).alias("n")).select(
        "meeting_id", "started_at", "n.event_id", "n.event_start", (F.col("n.away") / 1000).cast("bigint").alias("away_ms")
    )
