"""Queries of the core operators. Each is run over whole tables; ORACLE has the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlatrace import tables as t
from parlatrace.functions import html as H
from parlatrace.functions import text as X
from parlatrace.functions import time as M
from parlatrace.functions.labels import speaker_of, with_speaker
from parlatrace.functions.markdown import markdown_to_html
from parlatrace.functions.names import unique_names
from parlatrace.operators import conversations, files, lookups, paragraphs, queue, silence, throttle, vectors
from parlatrace.operators.attribution import attribute, named_turns, timed_segments
from parlatrace.operators.periods import periods_and_gaps
from parlatrace.session import cut, spread
from parlatrace.sources import readers, writers
from parlatrace.streaming import live



def _timed(s: SparkSession, d: str) -> DataFrame:
    return timed_segments(t.segments(s, d))


def _attributed(s: SparkSession, d: str) -> DataFrame:
    return attribute(_timed(s, d), named_turns(t.turns(s, d)), texts=False)


def _actions(s: SparkSession, d: str) -> DataFrame:
    # read by the rows and by the summaries of their shards, which would each attribute them anew
    return paragraphs.speaker_actions(cut(_attributed(s, d), "attributed"), t.table(s, d, "jobs"))


def _shown(s: SparkSession, d: str, actions: DataFrame) -> DataFrame:
    option = queue.effective_options(t.table(s, d, "jobs"))
    rows = actions.join(option.where("timestamps").select("job_id", "timestamp_interval", (F.col("speaker_detection") != "none").alias("detect")), "job_id")
    para = F.col("action").isin("para", "para_close")
    return throttle.spaced(
        rows.select("job_id", "seg_no", "start_ms", (para | (~F.col("detect") & F.col("first_segment"))).alias("forced"), (F.col("action") == "same").alias("eligible"), F.col("timestamp_interval").alias("interval_ms"))
    )


def document(s: SparkSession, d: str) -> DataFrame:
    actions = cut(_actions(s, d), "actions")  # read by the throttle and by the rendering
    return paragraphs.document_rows(actions, t.table(s, d, "jobs"), _shown(s, d, actions), _timed(s, d))


def pause_gaps(s, d):
    return paragraphs.with_gaps(_timed(s, d)).select("job_id", "seg_no", "gap_ms", "first_segment")


def pause_rows(s, d):
    return paragraphs.pauses(_timed(s, d), t.table(s, d, "jobs"))


def pause_summary(s, d):
    return paragraphs.pauses(_timed(s, d), t.table(s, d, "jobs")).groupBy("job_id").agg(F.count("*").alias("pauses"), F.sum("gap_ms").alias("silent_ms"), F.max("gap_ms").alias("longest_ms"))


def pause_snap(s, d):
    return silence.snap(t.segments(s, d), silence.silences(t.speech_chunks(s, d), t.table(s, d, "jobs")))


def speaker_attribution(s, d):
    return _attributed(s, d)


def speaker_actions(s, d):
    return _actions(s, d).select("job_id", "seg_no", "gap_ms", "speaker", "action", "para_no")


def speaker_stats(s, d):
    rows = _attributed(s, d).where("new_speaker <> ''")
    return rows.groupBy("job_id", F.col("new_speaker").alias("speaker")).agg(F.count("*").alias("segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.count_if("overlapping").alias("overlapping"))


def document_rows(s, d):
    return document(s, d).select("job_id", "out_no", "cue_no", "kind", "start_ms", "end_ms", "speaker", "text", "para_no", "anchor")


def paragraph_texts(s, d):
    return paragraphs.paragraph_texts(document(s, d)).select("job_id", "para_no", "part", "start_ms", "end_ms", "n_rows", F.md5("text").alias("digest"))


def vtt_cues(s, d):
    return writers.vtt_cues(document(s, d))


def rendered_html(s, d):
    heads = t.table(s, d, "jobs").select("job_id", files.stem(F.col("audio_file")).alias("title"), F.lit("written offline").alias("info"), F.col("audio_file").alias("media"))
    return writers.rendered(document(s, d), heads, "html")


def timestamp_throttle(s, d):
    rows = _timed(s, d).join(t.table(s, d, "jobs").select("job_id", F.coalesce("timestamp_interval", F.lit(60_000)).alias("interval_ms")), "job_id")
    return throttle.spaced(rows.select("job_id", "seg_no", "start_ms", F.lit(False).alias("forced"), F.lit(True).alias("eligible"), "interval_ms"))


def _progress(s, d):
    jobs = t.table(s, d, "jobs").where("duration_s > 0 and not isnan(duration_s)").select("job_id", "duration_s", (F.coalesce("speaker_detection", F.lit("auto")) != "none").alias("speakers"))
    share = F.bround(F.col("end_s") / F.col("duration_s") * 100) / 100
    rows = t.segments(s, d).where("end_s is not null").join(jobs, "job_id")
    return rows.select("job_id", "seg_no", X.overall_progress(F.lit(3), share, F.col("speakers")).alias("progress"))


def progress_map(s, d):
    return _progress(s, d).select("job_id", "seg_no", F.bround("progress", 6).alias("progress"))


def progress_throttle(s, d):
    return throttle.stepped(_progress(s, d).select("job_id", "seg_no", F.bround(F.col("progress") * 1000).cast("int").alias("value")))


def queue_summary(s, d):
    return queue.summary(t.table(s, d, "jobs"))


def next_job(s, d):
    return queue.next_waiting(t.table(s, d, "jobs")).select("job_id", "ordinal")


def last_finished(s, d):
    return queue.last_finished(t.table(s, d, "jobs")).select("job_id", "ordinal")


def running_jobs(s, d):
    return queue.by_state(t.table(s, d, "jobs"), *queue.RUNNING).select("job_id", queue.state().alias("state"))


def output_conflicts(s, d):
    return queue.output_conflicts(t.table(s, d, "jobs")).select("job_id", "transcript_file")


def effective_options(s, d):
    return queue.effective_options(t.table(s, d, "jobs"))


def option_line(s, d):
    return queue.option_line(t.table(s, d, "jobs"))


def job_summaries(s, d):
    return queue.job_summary(t.table(s, d, "jobs"))


def markdown_html(s, d):
    return spread(t.table(s, d, "documents").where("doc_kind = 'md'").select("doc_id", "text")).select("doc_id", markdown_to_html("text").alias("html"))


def state_changes(s, d):
    return queue.transitions(t.table(s, d, "jobs").where("transcript_file is not null"), "transcript_file", "ordinal", "status")


def job_span(s, d):
    return queue.elapsed(t.table(s, d, "jobs"), "created_at", "created_at")


def language_codes(s, d):
    return lookups.language_codes(t.table(s, d, "jobs"), t.table(s, d, "languages")).select("job_id", "language_code", lookups.recognition_language(F.col("language_code"), F.lit(False)).alias("r")).select("job_id", "language_code", "r.language", "r.multilingual", "r.detect")


def speaker_labels(s, d):
    return t.turns(s, d).select("job_id", "turn_no", speaker_of(F.col("label")).alias("speaker"))


def clock_times(s, d):
    rows = _timed(s, d)
    text = M.ms_to_str(F.col("start_ms"))
    return rows.select("job_id", "seg_no", text.alias("clock"), M.ms_to_webvtt(F.col("start_ms")).alias("cue_time"), M.str_to_ms(text).alias("back_ms"), M.clock_minutes(F.col("start_ms")).alias("minutes"))


def file_times(s, d):
    jobs = t.table(s, d, "jobs")
    return jobs.select("job_id", M.file_time_utc(F.col("audio_file"), "UTC").alias("recorded_at"), files.stem(F.col("audio_file")).alias("stem"), files.suffix(F.col("audio_file")).alias("suffix"))


def anchor_codec(s, d):
    rows = _timed(s, d)
    name = X.anchor_name(F.col("start_ms"), F.col("end_ms"), F.lit("S01"))
    return rows.select("job_id", "seg_no", name.alias("anchor"), X.anchor_parts(name).alias("a")).select("job_id", "seg_no", "anchor", "a.start_ms", "a.end_ms", "a.speaker")


def escaped_texts(s, d):
    return _timed(s, d).select("job_id", "seg_no", X.html_escape(F.col("text")).alias("html"), X.vtt_escape(F.col("text")).alias("vtt"))


def html_plain(s, d):
    text = F.col("plain")
    return spread(t.table(s, d, "payloads")).select("payload_id", H.html_to_plain("transcript_html").alias("plain")).select("payload_id", F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


def html_blocks(s, d):
    return spread(t.table(s, d, "payloads")).select("payload_id", H.html_to_blocks("transcript_html").alias("text"))


def html_anchors(s, d):
    return readers.transcript_anchors(t.table(s, d, "payloads"), "payload_id", "transcript_html").select("payload_id", "position", "start_ms", "end_ms", "speaker")


def text_durations(s, d):
    return t.table(s, d, "documents").select("doc_id", X.duration_from_text(F.col("text")).alias("seconds"))


def size_durations(s, d):
    size = F.octet_length("transcript_html")
    return t.table(s, d, "payloads").select("payload_id", X.duration_from_html_size(size).alias("html_seconds"), X.duration_from_wav_size(size).alias("wav_seconds"))


def document_dates(s, d):
    return t.table(s, d, "documents").select("doc_id", M.document_date(F.col("text"), F.col("source"), "UTC", F.col("added_at").cast("timestamp_ntz")).alias("dated"))


def text_chunks(s, d):
    return conversations.chunks(t.table(s, d, "documents"), "doc_id", "text").select("doc_id", F.col("chunk_index").alias("chunk_no"), F.md5("content").alias("digest"))


def _conversations(s, d):
    return conversations.conversations(t.table(s, d, "payloads"), "transcript_html")


def conversation_chunks(s, d):
    whole = _conversations(s, d)
    pieces = conversations.with_conversation(conversations.chunks(whole, "conversation_id", "transcript"), whole)
    return pieces.select("conversation_id", "chunk_index", "started_at", "source_tool", F.md5("content").alias("digest"))


def conversations_latest(s, d):
    return conversations.latest_first(_conversations(s, d)).select("conversation_id", "started_at", "duration_s")


def queue_appended(s, d):
    jobs = t.table(s, d, "jobs")
    again = jobs.where("transcript_file is not null").select("job_id", "ordinal", F.concat("transcript_file", F.when(F.lower(F.trim("status")) == "finished", "").otherwise(".new")).alias("transcript_file"))
    return queue.appended(jobs.select("job_id", "ordinal", "status", "transcript_file"), again).select("job_id", "ordinal", queue.state().alias("state"), "transcript_file")


def dated_names(s, d):
    """Dates of notes by what they say, by their name, or the given time: a case for each way."""
    notes = [("Date/Time: 2024-03-05 14:30\nx", "24.01.02 a.md"), ("no date", "24.01.02 a.md"), ("no date", "a.md"), ("Date/Time: 2024-13-45 14:30", "23.12.31 b"), (None, "99.02.30 c"), ("", None)]
    rows = s.createDataFrame(notes, "text string, name string").withColumn("now", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    return rows.select("text", "name", M.date_in_text(F.col("text")).alias("said"), M.date_in_name(F.col("name"), "UTC").alias("named"), M.document_date(F.col("text"), F.col("name"), "UTC", F.col("now")).alias("dated"))


def untranscribed(s, d):
    audio = t.table(s, d, "jobs").select("job_id", F.col("audio_file").alias("path"))
    return files.untranscribed(audio, t.table(s, d, "payloads").select(F.col("transcript_path").alias("path"))).select("job_id", "path")


def recordings(s, d):
    return files.recordings(t.table(s, d, "jobs").select("job_id", F.col("audio_file").alias("path")))


def first_of_name(s, d):
    jobs = t.table(s, d, "jobs").where("transcript_file is not null").select("job_id", files.base_name(F.col("transcript_file")).alias("name"), F.col("transcript_file").alias("path"), queue.state().alias("state"))
    return files.first_of_name([jobs.where("state = 'finished'"), jobs.where("state <> 'finished'")])


def payload_outcomes(s, d):
    return files.outcome_counts(t.table(s, d, "payloads"), F.col("audio_duration_seconds") > 0)


def payload_bodies(s, d):
    return writers.payloads_json(t.table(s, d, "payloads"))


def output_names(s, d):
    day = F.to_date("created_at").alias("day")
    names = t.table(s, d, "jobs").where("transcript_file is not null").groupBy(day).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "transcript_file"))), lambda x: x["transcript_file"]).alias("wanted"))
    return names.select("day", "wanted", unique_names(F.col("wanted"), F.expr("cast(array() as array<string>)")).alias("given"))


def clipped(s, d):
    jobs = t.table(s, d, "jobs").select("job_id", F.coalesce("start_ms", F.lit(0)).alias("clip_start"), F.coalesce("stop_ms", F.lit(0)).alias("clip_stop"))
    return readers.clipped(_timed(s, d).join(jobs, "job_id"), F.col("clip_start"), F.col("clip_stop")).select("job_id", "seg_no", "start_ms", "end_ms")


def calendar_match(s, d):
    meetings = t.table(s, d, "payloads").select(F.col("payload_id").alias("meeting_id"), F.col("received_at").alias("started_at"))
    events = t.table(s, d, "jobs").select(F.col("job_id").alias("event_id"), F.col("created_at").alias("event_start"))
    return lookups.calendar_matches(meetings, events).select("meeting_id", "event_id", "away_ms")


def vector_topk(s, d):
    v = t.table(s, d, "embeddings")
    return vectors.nearest(v, v.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def versions(s, d):
    pairs = s.createDataFrame([("0.7", "0.6.2"), ("1.2", "1.2.0"), ("1.2.3", "1.10"), ("2", "10"), ("3.0.1", "3.0"), ("x", "1")], "a string, b string")
    return pairs.select("a", "b", X.version_compare(F.col("a"), F.col("b")).alias("higher"))


def gpu_errors(s, d):
    logs = s.createDataFrame([("CUDA error: out of memory",), ("cublas failed",), ("cuda failed (device_cpu)",), ("file not found",), ("NCCL timeout",)], "message string")
    return logs.select("message", X.is_gpu_error(F.col("message")).alias("gpu"))


def stream_gaps(s, d):
    return live.run_to_end(live.live_gaps(live.table_stream(s, d, "segments")), "gaps").select("job_id", "seg_no", "gap_ms", "shown")


def batch_bursts(s, d):
    return live.debounced(t.table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "2 hours").select("user_id", F.unix_micros("last_at").alias("last_us"), "events")


def stream_bursts(s, d):
    events = live.table_stream(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return live.run_to_end(live.debounced(events, "user_id", "ts", "2 hours"), "bursts").select("user_id", F.unix_micros("last_at").alias("last_us"), "events")


def p3_found(s, d):
    turns = with_speaker(t.table(s, d, "turns").select("job_id", "start_ms", "end_ms", "label"))
    return periods_and_gaps(turns, ["job_id", "speaker"])


def p3_coverage(s, d):
    rows = p3_found(s, d)
    ms = F.col("end_ms") - F.col("start_ms")
    return rows.groupBy("job_id", "speaker").agg(F.count_if(F.col("kind") == "period").alias("periods"), F.sum(F.when(F.col("kind") == "period", ms).otherwise(0)).alias("covered_ms"), F.sum(F.when(F.col("kind") == "gap", ms).otherwise(0)).alias("open_ms"))


QUERIES = {
    f.__name__: f
    for f in (
        pause_gaps, pause_rows, pause_summary, pause_snap, speaker_attribution, speaker_actions, speaker_stats, document_rows, paragraph_texts, vtt_cues, rendered_html, timestamp_throttle, progress_map, progress_throttle,
        queue_summary, next_job, last_finished, running_jobs, output_conflicts, effective_options, option_line, job_summaries, markdown_html, state_changes, job_span, language_codes, speaker_labels, clock_times, file_times, anchor_codec, escaped_texts,
        html_plain, html_blocks, html_anchors, text_durations, size_durations, document_dates, dated_names, text_chunks, conversation_chunks, conversations_latest, queue_appended, untranscribed, recordings, first_of_name, payload_outcomes, payload_bodies, output_names, clipped, calendar_match, vector_topk, versions,
        gpu_errors, stream_gaps, batch_bursts, stream_bursts, p3_found, p3_coverage,
    )
}

