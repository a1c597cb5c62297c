"""Reading the input tables and removing the repeated rows they arrive with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def segments(spark: SparkSession, directory: str) -> DataFrame:
    """Segments without repeated rows: a row that came again later differs in received_at only."""
    return table(spark, directory, "segments").select("job_id", "seg_no", "start_s", "end_s", "text").dropDuplicates(["job_id", "seg_no"])


def turns(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "turns").select("job_id", "turn_no", "start_ms", "end_ms", "label").dropDuplicates(["job_id", "turn_no"])


def speech_chunks(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "speech_chunks").dropDuplicates(["job_id", "chunk_no"])
