"""Files into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlatrace.functions.html import html_unescape
from parlatrace.functions.text import anchor_parts
from parlatrace.operators.files import notes

WORD = "struct<word:string,start:double,end:double,prob:double>"
SEGMENTS = f"job_id bigint, seg_no int, start_s double, end_s double, text string, words array<{WORD}>, received_at timestamp_ntz"
MESSAGES = f"type string, level string, msg string, pct double, ok boolean, segment struct<start_s:double,end_s:double,text:string,words:array<{WORD}>>"


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html) of the .html files of a folder, by path; not of its subfolders."""
    return spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")).orderBy("path")


def note_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of Markdown and suffix-less files of a folder, each once, by path."""
    return notes(spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of the .wav files of a folder, in any case, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))


def models(spark: SparkSession, names: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(names, "name string, path string")


def transcript_anchors(documents: DataFrame, key: str, html: str) -> DataFrame:
    """The anchored segments of transcripts: (key, position, start_ms, end_ms, speaker, text).

    Anchors whose name isn't ours are skipped but counted, so position is that of the cue. Inner tags are transparent.
    """
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<a\s[^>]*?name="[^"]*"[^>]*>.*?</a>'), 0)
    text = html_unescape(F.regexp_replace(F.regexp_replace("anchor", r"(?s)<br\s*/?>", "\n"), r"<[^>]+>", ""))
    rows = documents.select(key, F.posexplode(found).alias("position", "anchor")).withColumn("a", anchor_parts(F.regexp_extract("anchor", r'name="([^"]*)"', 1)))
    return rows.where("a is not null").select(key, (F.col("position") + 1).alias("position"), "a.start_ms", "a.end_ms", "a.speaker", text.alias("text"))


def messages(rows: DataFrame, kind: str) -> DataFrame:
    """The messages of one type: log, progress, segment or result."""
    return rows.where(F.col("type") == kind)


def clipped(segments: DataFrame, start_ms: Column, stop_ms: Column) -> DataFrame:
    """Segments that begin at start_ms or later and, where stop_ms is above 0, end by it. Pushed down to the scan where both are literals."""
    return segments.where((F.col("start_ms") >= start_ms) & ((stop_ms <= 0) | (F.col("end_ms") <= stop_ms)))


def settings(path: str) -> dict:
    """A flat settings file, one 'key: value' a line, as a dict; '#' begins a comment. A missing file gives an empty dict."""
    try:
        lines = open(path, encoding="utf-8").read().splitlines()
    except FileNotFoundError:
        return {}
    pairs = (line.split("#", 1)[0].partition(":") for line in lines)
    return {k.strip(): v.strip().strip("'\"") for k, sep, v in pairs if sep and k.strip()}


def payload_schema() -> T.StructType:
    return T._parse_datatype_string("transcript_path string, transcript_html string, started_at string, audio_duration_seconds int, source_tool string")
