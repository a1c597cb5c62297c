"""Text functions that stay in the JVM: escaping, anchors, estimates, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks an error message as one of the graphics card.
GPU_ERROR_WORDS = ("cuda", "cublas", "cudnn", "cufft", "device-side assert", "invalid device function", "nccl", "gpu driver", "compute capability", "hip error")


def html_escape(text: Column) -> Column:
    """& < > " ' as character references, the ampersand first."""
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(ref))
    return text


def vtt_escape(text: Column) -> Column:
    """Escaped, and no empty line inside: one would end the cue."""
    return F.regexp_replace(html_escape(text), "\n{2,}", "\n")


def anchor_name(start_ms: Column, end_ms: Column, speaker: Column) -> Column:
    """'ts_start_end_speaker'; a null speaker is written as an empty one."""
    return F.concat_ws("_", F.lit("ts"), start_ms.cast("string"), end_ms.cast("string"), F.coalesce(speaker, F.lit("")))


def anchor_parts(name: Column) -> Column:
    """struct(start_ms, end_ms, speaker) of an anchor name, null for names that aren't ours. What follows a further '_' is lost."""
    parts = F.split(name, "_", 5)
    get = lambda i: F.get(parts, F.lit(i))
    ours = (F.size(parts) > 1) & (get(0) == "ts")
    return F.when(ours, F.struct(get(1).try_cast("bigint").alias("start_ms"), get(2).try_cast("bigint").alias("end_ms"), get(3).alias("speaker")))


def collapse_space(text: Column) -> Column:
    """Runs of Unicode white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(collapse_space(text), " "), lambda w: w != ""))


def duration_from_text(text: Column) -> Column:
    """Seconds of the latest m:ss in the text; without one above zero, by words at 150 a minute, a minute at least. Null for null."""
    times = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}:\d{2})\b"), 1)
    seconds = F.transform(times, lambda t: F.split(t, ":")[0].cast("int") * 60 + F.split(t, ":")[1].cast("int"))
    latest = F.array_max(seconds)
    words = F.greatest(F.lit(60), F.floor(word_count(text) / F.lit(150)).cast("int") * 60)
    return F.when(text.isNotNull(), F.when(latest > 0, latest).otherwise(words)).cast("int")


def duration_from_html_size(size_bytes: Column) -> Column:
    """Seconds: thirty for each KB, a minute at least."""
    return F.greatest(F.lit(60), (size_bytes / F.lit(1024.0) * 30).cast("int"))


def duration_from_wav_size(size_bytes: Column, bytes_per_second: int = 32_000) -> Column:
    """Seconds of 16 kHz mono 16-bit audio behind a 44-byte header; wrong for other formats, whose rate is the parameter."""
    return F.bround(F.greatest(F.lit(0.0), (size_bytes - 44) / F.lit(float(bytes_per_second)))).cast("int")


def version_compare(a: Column, b: Column, depth: int = 99) -> Column:
    """1 if version a is higher, 2 if b is, 0 if their first depth parts are equal. Missing parts count as 0; null or a part that is no number gives null."""
    parts = lambda v: F.transform(F.slice(F.split(v, r"\."), 1, depth), lambda p: p.try_cast("int"))
    pa, pb = parts(a), parts(b)
    width = F.greatest(F.size(pa), F.size(pb))
    pad = lambda p: F.concat(p, F.array_repeat(F.lit(0), F.greatest(width - F.size(p), F.lit(0))))
    known = ~F.exists(pa, lambda x: x.isNull()) & ~F.exists(pb, lambda x: x.isNull())
    return F.when(known, F.when(pad(pa) > pad(pb), 1).when(pad(pa) < pad(pb), 2).otherwise(0))


def is_gpu_error(message: Column) -> Column:
    """Whether a message tells of the graphics card, and not of a run that had fallen back to the processor already."""
    return F.lower(message).rlike("|".join(GPU_ERROR_WORDS)) & ~F.contains(message, F.lit("(device_cpu)"))


def overall_progress(step: Column, value: Column, speakers: Column) -> Column:
    """Share of the whole job done, from the share of a step: conversion 5 %, speakers to 50 %, transcription the rest; .99 at most, -1 for other steps."""
    third = F.when(speakers, 0.5 + 0.5 * value).otherwise(0.05 + 0.95 * value)
    done = F.when(step == 1, 0.05 * value).when(step == 2, 0.05 + 0.45 * value).when(step == 3, third)
    return F.when(step.isin(1, 2, 3), F.least(F.lit(0.99), done)).otherwise(F.lit(-1.0))


def step_percent(done: Column, total: Column) -> Column:
    """Percent of a step, 100 at most; a total of 0 counts as done."""
    return F.when(total == 0, 100.0).otherwise(F.least(F.lit(100.0), done / total * 100.0))


def channel_weights(channels: Column) -> Column:
    """Equal weights for mixing more than two channels down, null for one or two."""
    return F.when(channels > 2, F.array_repeat(1.0 / channels, channels))
