"""Streams run with the same column functions as the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlatrace.functions.time import seconds_to_ms
from parlatrace.session import scratch


def table_stream(spark: SparkSession, directory: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table read as a stream, some files at a time; the table is a file or a folder of files."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{directory}/{name}.parquet*")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there (availableNow), with checkpoint and output in the shared folder, and return what it wrote."""
    spark = stream.sparkSession
    at = scratch(spark, f"stream-{name}")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def live_gaps(segments: DataFrame, interval_ms: int = 60_000) -> DataFrame:
    """Gap before each segment and whether its time is shown, from state carried per job: (job_id, seg_no, gap_ms, shown).

    One producer per job sends segments in order; within a micro-batch they are put in order of seg_no. A segment that comes
    again, or late (its number is not above the last one seen), is dropped. Segments without a bound are dropped.
    """
    rows = segments.select("job_id", "seg_no", seconds_to_ms(F.col("start_s")).alias("start_ms"), seconds_to_ms(F.col("end_s")).alias("end_ms")).where("job_id is not null and seg_no is not null and start_ms is not null and end_ms is not null")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, end, shown_at, first = state.get if state.exists else (-(2**31), 0, 0, True)
        rows = pd.concat(list(frames)).drop_duplicates("seg_no").sort_values("seg_no")
        rows = rows[rows["seg_no"] > seen]
        if not len(rows):
            return
        gaps = rows["start_ms"] - rows["end_ms"].shift(fill_value=end)
        shown = []
        for start in rows["start_ms"]:
            show = first or start - shown_at > interval_ms
            shown.append(show)
            first, shown_at = False, start if show else shown_at
        state.update((int(rows["seg_no"].iloc[-1]), int(rows["end_ms"].iloc[-1]), int(shown_at), False))
        yield pd.DataFrame({"job_id": key[0], "seg_no": rows["seg_no"].to_numpy(), "gap_ms": gaps.to_numpy(), "shown": shown})

    return rows.groupBy("job_id").applyInPandasWithState(
        step, "job_id bigint, seg_no int, gap_ms bigint, shown boolean", "seen int, end bigint, shown_at bigint, first boolean", "append", GroupStateTimeout.NoTimeout
    )


def debounced(events: DataFrame, key: str, at: str, quiet: str = "2 seconds", lateness: str = "0 seconds") -> DataFrame:
    """One row per key and burst of events: (key, first_at, last_at, events). A burst ends when nothing came for the quiet time.

    Works on tables and on streams; in a stream a burst is given out once the watermark, lateness behind the latest event, has
    passed its end, and events later than that are dropped.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    if rows.isStreaming:
        rows = rows.withWatermark(at, lateness)
    return rows.groupBy(key, F.session_window(at, quiet)).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("events")).drop("session_window")


def files_arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """(path, length, modified) of non-empty .wav files as they arrive, some at a time; those already done are known by the checkpoint."""
    stream = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("maxFilesPerTrigger", files_per_trigger).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return stream.select("path", "length", F.col("modificationTime").alias("modified")).where("length > 0")


def each_alone(handle):
    """For foreachBatch: handle is given one row at a time; a row that fails is kept with its error and doesn't stop the others."""

    failed: list[tuple[int, str, str]] = []

    def run(batch: DataFrame, batch_id: int) -> None:
        for row in batch.toLocalIterator():
            try:
                handle(row)
            except Exception as e:  # noqa: BLE001
                failed.append((batch_id, str(row.asDict()), str(e)))

    run.failed = failed
    return run


def auto_saved(stream: DataFrame, save, seconds: int = 5, at_end: bool = False):
    """Starts a query that calls save(batch) for what arrived, every `seconds` at most and only if something did; at_end: once for what is there, then ends.

    save gets each row once per batch, and a batch that runs again with the same number: it writes by that number, which is its second argument.
    """

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            save(batch, number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", scratch(stream.sparkSession, "autosave"))
    return (writer.trigger(availableNow=True) if at_end else writer.trigger(processingTime=f"{seconds} seconds")).start()
