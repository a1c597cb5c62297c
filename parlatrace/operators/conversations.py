"""Transcripts as stored conversations, and the overlapping pieces of their text that are searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 2000
CHUNK_OVERLAP = 200


def conversations(payloads: DataFrame, text: str = "text") -> DataFrame:
    """(conversation_id, started_at, duration_s, source_tool, transcript): one row per transcript; those that come again under one id count once."""
    rows = payloads.where("payload_id is not null").select(F.col("payload_id").alias("conversation_id"), "started_at", F.col("audio_duration_seconds").alias("duration_s"), "source_tool", F.col(text).alias("transcript"))
    return rows.dropDuplicates(["conversation_id"])


def chunks(rows: DataFrame, key: str, text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_index, content): pieces of `size` characters, each repeating the last `overlap` of the one before. Null and empty texts have none."""
    n = F.char_length(text)
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / F.lit(size - overlap))).cast("int"))
    cut = rows.where(n > 0).select(key, text, F.explode(at).alias("chunk_index"))
    return cut.select(key, "chunk_index", F.substring(F.col(text), F.col("chunk_index") * (size - overlap) + 1, F.lit(size)).alias("content"))


def with_conversation(pieces: DataFrame, whole: DataFrame) -> DataFrame:
    """Each piece with its conversation's fields, by the key they refer to; a piece of no known conversation is left out."""
    return pieces.join(whole.drop("transcript"), "conversation_id")


def latest_first(whole: DataFrame) -> DataFrame:
    """Ordered by start, the latest first, those without a start last; equal ones by id."""
    return whole.orderBy(F.desc_nulls_last("started_at"), "conversation_id")


def store(whole: DataFrame, pieces: DataFrame, folder: str) -> None:
    """Both tables as files, pieces beside each other by conversation so that a lookup reads few of them; a second run replaces the first."""
    whole.write.mode("overwrite").parquet(f"{folder}/conversations")
    pieces.repartitionByRange("conversation_id", "chunk_index").sortWithinPartitions("conversation_id", "chunk_index").write.mode("overwrite").parquet(f"{folder}/conversation_chunks")


def store_jdbc(whole: DataFrame, pieces: DataFrame, url: str, properties: dict[str, str], connections: int = 8) -> None:
    """The same into a database, through a bounded number of connections."""
    for df, name in ((whole, "conversations"), (pieces, "conversation_chunks")):
        df.coalesce(connections).write.mode("append").jdbc(url, name, properties=properties)
