"""The job queue: states, counts, the next job, conflicts, options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlatrace.operators.sequence import in_shards

RUNNING = ("audio_conversion", "speaker_identification", "transcription", "canceling")
PAUSE_OPTIONS = ("none", "1sec+", "2sec+", "3sec+")


def state(column: str = "status") -> Column:
    """Status in one spelling."""
    return F.lower(F.trim(F.col(column)))


def is_running(column: str = "status") -> Column:
    return state(column).isin(*RUNNING)


def summary(jobs: DataFrame) -> DataFrame:
    """One row: total, the count per group of states, done (neither waiting nor running), and whether any wait, any run, none are there."""
    s = state()
    count = lambda c: F.count_if(c)
    return jobs.agg(
        F.count("*").alias("total"), count(s == "waiting").alias("waiting"), count(is_running()).alias("running"), count(s == "finished").alias("finished"),
        count(s == "error").alias("failed"), count(s == "canceled").alias("canceled"),
    ).select("*", (F.col("total") - F.col("waiting") - F.col("running")).alias("done"), (F.col("waiting") > 0).alias("has_pending"), (F.col("running") > 0).alias("is_running"), (F.col("total") == 0).alias("is_empty"))


def by_state(jobs: DataFrame, *states: str) -> DataFrame:
    return jobs.where(state().isin(*states))


def next_waiting(jobs: DataFrame) -> DataFrame:
    """The waiting job that comes first, no row if none waits."""
    return by_state(jobs, "waiting").orderBy("ordinal").limit(1)


def last_finished(jobs: DataFrame) -> DataFrame:
    return by_state(jobs, "finished").orderBy(F.desc("ordinal")).limit(1)


def output_conflicts(jobs: DataFrame) -> DataFrame:
    """Jobs whose output path another job writes too, errors, canceled and canceling jobs aside (on the other side).

    Counts per path decide, so that a path many jobs share makes no pairs. A job without a path conflicts with none.
    """
    live = ~state().isin("error", "canceled", "canceling") | F.col("status").isNull()
    per_path = jobs.where(live & F.col("transcript_file").isNotNull()).groupBy("transcript_file").agg(F.count("*").alias("live_jobs"))
    joined = jobs.withColumn("live", live).join(per_path, "transcript_file")
    return joined.where(F.col("live_jobs") > F.when(F.col("live"), 1).otherwise(0)).drop("live", "live_jobs")


def elapsed(jobs: DataFrame, start: str, end: str) -> DataFrame:
    """Earliest start, latest end and the span between them in ms over all jobs."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return jobs.agg(F.min(start).alias("first_start"), F.max(end).alias("last_end"), (F.max(ms(end)) - F.min(ms(start))).alias("elapsed_ms"))


def effective_options(jobs: DataFrame) -> DataFrame:
    """Job options with defaults filled in; WebVTT output forces no pause marks, no overlapping speech and no times."""
    vtt = F.coalesce(F.lower("transcript_file").endswith(".vtt"), F.lit(False))
    return jobs.select(
        "job_id", F.coalesce("start_ms", F.lit(0)).alias("start_ms"), F.coalesce("stop_ms", F.lit(0)).alias("stop_ms"), F.coalesce("speaker_detection", F.lit("auto")).alias("speaker_detection"),
        (~vtt & F.coalesce("overlapping", F.lit(True))).alias("overlapping"), (~vtt & F.coalesce("timestamps", F.lit(False))).alias("timestamps"),
        F.when(vtt, 0).otherwise(F.coalesce("pause", F.lit(1))).alias("pause"), F.coalesce("timestamp_interval", F.lit(60_000)).alias("timestamp_interval"), F.coalesce("pause_marker", F.lit(".")).alias("pause_marker"),
    )


def pause_option(text: Column) -> Column:
    """0 to 3 for none, 1sec+, 2sec+, 3sec+; anything else counts as 1."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(o) for o in PAUSE_OPTIONS]), text), F.lit(0)) - 1, F.lit(1)).cast("int")


def option_line(jobs: DataFrame) -> DataFrame:
    """One line per job with its options; colons of the times are written as a look-alike so that they aren't taken for time marks."""
    from parlatrace.functions.time import ms_to_str

    clock = lambda c: F.translate(ms_to_str(F.col(c)), ":", "꞉")
    return jobs.select(
        "job_id",
        F.concat_ws(
            " | ",
            F.when(F.col("start_ms") > 0, F.concat(F.lit("Start "), clock("start_ms"))), F.when(F.col("stop_ms") > 0, F.concat(F.lit("Stop "), clock("stop_ms"))),
            F.concat(F.lit("Language "), F.col("language_name")), F.concat(F.lit("Speakers "), F.col("speaker_detection")), F.concat(F.lit("Overlapping "), F.col("overlapping").cast("string")),
            F.concat(F.lit("Timestamps "), F.col("timestamps").cast("string")), F.concat(F.lit("Pause "), F.col("pause").cast("string")),
        ).alias("options"),
    )


def job_summary(jobs: DataFrame) -> DataFrame:
    """A few lines of text per job for display: output name, clip, language, speakers, pause and marks for what is on; what is null has no line."""
    from parlatrace.functions.time import ms_to_str
    from parlatrace.operators.files import base_name

    sign = lambda c: F.when(F.col(c), "✓").otherwise("✗")
    line = lambda name, value: F.concat(F.lit(name + ": "), value)
    pause = F.coalesce(F.get(F.array(*[F.lit(o) for o in PAUSE_OPTIONS]), F.when(F.col("pause").between(0, 3), F.col("pause"))), F.col("pause").cast("string"))
    return jobs.select(
        "job_id",
        F.concat_ws(
            "\n",
            line("Transcript", base_name(F.col("transcript_file"))), line("Start", F.when(F.col("start_ms") > 0, ms_to_str(F.col("start_ms"))).otherwise("00:00:00")),
            line("Stop", F.when(F.col("stop_ms") > 0, ms_to_str(F.col("stop_ms"))).otherwise("end")), line("Language", F.col("language_name")), line("Pause", pause),
            line("Speakers", F.col("speaker_detection")), line("Overlapping", sign("overlapping")), line("Timestamps", sign("timestamps")),
        ).alias("summary"),
    )


def transitions(events: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """The state of each key after its events, and how many of its changes aren't allowed ones.

    Allowed: forward along waiting, audio_conversion, speaker_identification, transcription, finished (steps may be left out); to error or canceling from
    any running state; canceling to canceled; and back to waiting from an end state.
    """
    order = F.create_map(*[x for i, s in enumerate(("waiting", "audio_conversion", "speaker_identification", "transcription", "finished")) for x in (F.lit(s), F.lit(i))])
    w = Window.partitionBy(key).orderBy(at)
    rows = events.withColumn("_s", state(status)).withColumn("_p", F.lag("_s").over(w))
    p, s = F.col("_p"), F.col("_s")
    ok = p.isNull() | (order[s] > order[p]) | (s.isin("error", "canceling") & p.isin(*RUNNING)) | ((p == "canceling") & (s == "canceled")) | ((s == "waiting") & p.isin("finished", "error", "canceled")) | (s == p)
    return rows.groupBy(key).agg(F.max_by("_s", at).alias("state"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad_changes"), F.count("*").alias("events"))


def appended(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with new jobs behind those it has: they get the next ordinals in the order of their own, wait, and columns only one side has are null.

    New jobs that would write what a job of the queue writes, as output_conflicts sees it, are not taken.
    """
    live = jobs.where(~state().isin("error", "canceled", "canceling") | F.col("status").isNull()).where("transcript_file is not null").select("transcript_file").distinct()
    last = jobs.agg(F.coalesce(F.max("ordinal"), F.lit(-1))).first()[0]
    rows = in_shards(new.join(live, "transcript_file", "left_anti"), "ordinal")
    shards = rows.groupBy("shard").agg(F.count("*").alias("_rows"))  # a row for thousands
    shards = shards.select("shard", (F.sum("_rows").over(Window.orderBy("shard")) - F.col("_rows")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("ordinal")) + F.col("_before")
    rows = rows.join(shards, "shard").withColumn("ordinal", (rank + last).cast("int")).withColumn("status", F.lit("waiting")).drop("shard", "_before")
    return jobs.unionByName(rows, allowMissingColumns=True)
