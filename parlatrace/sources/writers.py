"""Rows into files: transcripts as HTML, text or WebVTT, payloads as JSON, settings."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlatrace.functions.text import html_escape, vtt_escape
from parlatrace.functions.time import ms_to_webvtt

FORMATS = ("html", "txt", "vtt")
ROWS_A_PART = 4096


def file_format(path: str) -> str:
    """html, txt or vtt by suffix; TypeError for any other."""
    kind = path.rpartition(".")[2].lower()
    if kind not in FORMATS:
        raise TypeError(f"no such transcript format: {path}")
    return kind


def _joined(rows: DataFrame, line: Column, order: str) -> DataFrame:
    """Lines of a document joined in order, in parts of bounded size: (job_id, part, body)."""
    lines = rows.select("job_id", F.floor(F.col(order) / F.lit(ROWS_A_PART)).alias("part"), F.col(order).alias("_o"), line.alias("_l"))
    return lines.groupBy("job_id", "part").agg(F.array_sort(F.collect_list(F.struct("_o", "_l"))).alias("_r")).select("job_id", "part", F.array_join(F.transform("_r", lambda r: r["_l"]), "").alias("body"))


def vtt_cues(document: DataFrame) -> DataFrame:
    """One WebVTT cue per document row (document_rows): number, times (those below zero written as zero), voice, text. No row goes without a cue."""
    time = lambda c: ms_to_webvtt(F.greatest(F.lit(0), F.col(c)))
    text = F.concat(
        F.col("cue_no").cast("string"), F.lit("\n"), time("start_ms"), F.lit(" --> "), time("end_ms"), F.lit("\n<v "), F.coalesce("speaker", F.lit("")), F.lit(">"),
        F.regexp_replace(vtt_escape(F.coalesce("text", F.lit(""))), r"^\s+", ""), F.lit("\n\n"),
    )
    return document.select("job_id", "cue_no", text.alias("cue"))


def html_parts(document: DataFrame) -> DataFrame:
    """Anchors with their escaped text, a new paragraph where one opens: (job_id, part, body)."""
    opening = F.when(F.col("action").isin("para", "para_close"), "</p>\n<p>").otherwise("")
    return _joined(document, F.concat(opening, F.lit('<a name="'), html_escape(F.col("anchor")), F.lit('">'), F.col("html"), F.lit("</a>")), "cue_no")


def text_parts(document: DataFrame) -> DataFrame:
    opening = F.when(F.col("action").isin("para", "para_close"), "\n\n").otherwise("")
    return _joined(document, F.concat(opening, F.col("text")), "cue_no")


def rendered(document: DataFrame, heads: DataFrame, kind: str) -> DataFrame:
    """(job_id, part, body): the document in one format, part -1 its head and, for HTML, the last its foot. heads: (job_id, title, info, media)."""
    file_format(f".{kind}")
    e = html_escape
    if kind == "html":
        top = F.concat(
            F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><meta name="audio_source" content="'), e(F.col("media")), F.lit('"></head>\n<body><div class="transcript"><p style="font-weight:600">'), e(F.col("title")),
            F.lit("</p><p><span>"), e(F.col("info")), F.lit("</span></p><p>"),
        )
        body, foot = html_parts(document), F.lit("</p></div></body></html>\n")
    elif kind == "txt":
        top, body, foot = F.concat(F.col("title"), F.lit("\n\n"), F.col("info"), F.lit("\n")), text_parts(document), F.lit("\n")
    else:
        top = F.concat(F.lit("WEBVTT "), vtt_escape(F.col("title")), F.lit("\n\nNOTE\n"), vtt_escape(F.col("info")), F.lit("\n\nNOTE media: "), F.col("media"), F.lit("\n\n"))
        body, foot = _joined(vtt_cues(document), F.col("cue"), "cue_no"), F.lit("")
    ends = heads.select("job_id", F.lit(-1).cast("bigint").alias("part"), top.alias("body")).unionByName(heads.select("job_id", F.lit(2**62).alias("part"), foot.alias("body")))
    return ends.unionByName(body)


def write_transcripts(document: DataFrame, heads: DataFrame, kind: str, folder: str) -> None:
    """One folder per job with its parts in order; Spark's commit replaces a folder as a whole. A line break follows each part, which no format minds."""
    parts = rendered(document, heads, kind).repartitionByRange("job_id", "part").sortWithinPartitions("job_id", "part")
    parts.select(F.col("body").alias("value"), "job_id").write.mode("overwrite").partitionBy("job_id").text(folder)


def payloads_json(payloads: DataFrame) -> DataFrame:
    """The body posted for each transcript."""
    fields = [c for c in ("transcript_path", "transcript_html", "started_at", "audio_duration_seconds", "source_tool") if c in payloads.columns]
    return payloads.select("payload_id", F.to_json(F.struct(*fields)).alias("body"))


def webhook_batches(folder: str):
    """For foreachBatch: writes each batch of payloads as JSON lines, a batch run again replaces itself. A stand-in for posting."""

    def write(batch: DataFrame, batch_id: int) -> None:
        payloads_json(batch).select(F.col("body").alias("value")).write.mode("overwrite").text(f"{folder}/batch={batch_id}")

    return write


def write_settings(path: str, values: dict) -> None:
    """The whole dict, one 'key: value' a line; put in place at once."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.writelines(f"{k}: {v}\n" for k, v in values.items())
    os.replace(f"{path}.new", path)


def rescue_name(path: str, taken: set[str], tries: int = 999) -> str:
    """A name to save under when path can't be written: path with the first free _n."""
    head, dot, tail = re.match(r"^(.*?)(?:(\.)([^./]*))?$", path).groups()
    for n in range(1, tries + 1):
        name = f"{head}_{n}{dot or ''}{tail or ''}"
        if name not in taken:
            return name
    raise RuntimeError(f"no free name for {path}")
