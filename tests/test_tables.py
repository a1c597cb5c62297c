"""Queue, lookups, files, calendar and vectors on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parlatrace.operators import files, lookups, queue, vectors

JOBS = "job_id bigint, ordinal int, status string, transcript_file string"


def test_queue(spark, rows):
    jobs = spark.createDataFrame([(1, 0, "FINISHED", "/a"), (2, 1, "waiting", "/b"), (3, 2, " Waiting", "/a"), (4, 3, "transcription", "/c"), (5, 4, "error", "/b"), (6, 5, "canceling", None), (7, 6, None, "/d")], JOBS)
    s = queue.summary(jobs).first().asDict()
    assert s == {"total": 7, "waiting": 2, "running": 2, "finished": 1, "failed": 1, "canceled": 0, "done": 3, "has_pending": True, "is_running": True, "is_empty": False}
    assert queue.next_waiting(jobs).first().job_id == 2
    assert queue.last_finished(jobs).first().job_id == 1
    assert [r[0] for r in rows(queue.output_conflicts(jobs), "job_id")] == [1, 3, 5]
    empty = jobs.limit(0)
    assert queue.summary(empty).first().is_empty is True
    assert queue.next_waiting(empty).count() == queue.output_conflicts(empty).count() == 0


def test_options(spark):
    jobs = spark.createDataFrame([(1, None, None, None, "/x.VTT", True, True, 2, None, None), (2, 5, 9, "none", None, None, None, None, None, "-")], "job_id bigint, start_ms bigint, stop_ms bigint, speaker_detection string, transcript_file string, overlapping boolean, timestamps boolean, pause int, timestamp_interval bigint, pause_marker string")
    assert [tuple(r) for r in queue.effective_options(jobs).orderBy("job_id").collect()] == [(1, 0, 0, "auto", False, False, 0, 60000, "."), (2, 5, 9, "none", True, False, 1, 60000, "-")]
    texts = spark.createDataFrame([("none",), ("3sec+",), ("soon",), (None,)], "t string")
    assert [r[0] for r in texts.select(queue.pause_option(F.col("t"))).collect()] == [0, 3, 1, 1]


def test_transitions(spark, rows):
    events = [("a", 1, "waiting"), ("a", 2, "transcription"), ("a", 3, "finished"), ("a", 4, "waiting"), ("b", 1, "finished"), ("b", 2, "transcription"), ("c", 1, "transcription"), ("c", 2, "canceling"), ("c", 3, "canceled")]
    out = queue.transitions(spark.createDataFrame(events, "k string, at int, status string"), "k", "at", "status")
    assert rows(out) == [("a", "waiting", 0, 4), ("b", "transcription", 1, 2), ("c", "canceled", 0, 3)]


def test_languages(spark, rows):
    languages = spark.createDataFrame([("Auto", "auto"), ("German", "de"), ("English", "en"), (None, "xx")], "name string, code string")
    jobs = spark.createDataFrame([(1, "de"), (2, " german "), (3, "Klingon"), (4, None), (5, "AUTO")], "job_id bigint, language_name string")
    coded = lookups.language_codes(jobs, languages)
    assert rows(coded, "job_id", "language_code") == [(1, "de"), (2, "de"), (3, None), (4, None), (5, "auto")]
    with pytest.raises(Exception, match="unknown language"):
        lookups.language_codes(jobs, languages, strict=True).collect()
    prompts = spark.createDataFrame([("de", "Ähm ja.")], "code string, prompt string")
    assert rows(lookups.with_prompts(coded, prompts), "job_id", "prompt") == [(1, "Ähm ja."), (2, "Ähm ja."), (3, ""), (4, ""), (5, "")]
    r = coded.where("job_id in (1, 5)").orderBy("job_id").select(lookups.recognition_language(F.col("language_code"), F.lit(False))).collect()
    assert [tuple(x[0]) for x in r] == [("de", False, False), (None, False, True)]


def test_files(spark, rows):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    audio = paths("/in/a.wav", "/in/b.WAV", "/in/c.mp3", "/in/.wav", "/in/d.x.wav")
    assert [r[0] for r in rows(files.recordings(audio))] == ["/in/a.wav", "/in/b.WAV", "/in/d.x.wav"]
    assert [r[0] for r in rows(files.untranscribed(files.recordings(audio), paths("/out/a.html", "/out/b.txt", "/out/d.x.html")))] == ["/in/b.WAV"]
    assert [r[0] for r in files.notes(paths("/n/b.md", "/n/a", "/n/c.txt", "/n/b.md")).collect()] == ["/n/a", "/n/b.md"]
    first = files.first_of_name([spark.createDataFrame([("m", "/user/m")], "name string, path string"), spark.createDataFrame([("m", "/app/m"), ("n", "/app/n")], "name string, path string")])
    assert rows(first) == [("m", "/user/m", 0, 1), ("n", "/app/n", 1, 0)]
    assert [r.line for r in files.first_lines(spark.range(12), "id", 10, "id").collect()][-1] == "and 2 more"
    assert rows(files.outcome_counts(spark.createDataFrame([(True,), (False,), (None,)], "ok boolean"), F.col("ok"))) == [(1, 2)]


def test_zipped(spark, rows):
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "i int, a string"), spark.createDataFrame([(0, "p")], "i int, b string")
    assert rows(lookups.zipped(a, b, "i")) == [(0, "x", "p")]


def test_calendar(spark, rows):
    meetings = spark.createDataFrame([(1, "2025-01-01 10:00:00"), (2, "2025-01-01 12:00:00"), (3, None)], "meeting_id bigint, started_at string").withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
    events = [(7, "2025-01-01 09:55:00"), (8, "2025-01-01 10:05:00"), (9, "2025-01-01 12:05:01")]
    events = spark.createDataFrame(events, "event_id bigint, event_start string").withColumn("event_start", F.col("event_start").cast("timestamp_ntz"))
    assert rows(lookups.calendar_matches(meetings, events), "meeting_id", "event_id", "away_ms") == [(1, 7, 300_000)]


def test_vectors(spark, rows):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(120)] + [(200, None), (201, []), (202, [0.0] * 5), (203, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    got = rows(vectors.nearest(df, df.where("vec_id % 50 = 0"), 4), "query_id", "rank", "vec_id")
    f32 = {r.vec_id: r.embedding for r in df.where("vec_id < 200").collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    want = [(q, k + 1, v) for q in (0, 50, 100) for k, v in enumerate(sorted((v for v in f32 if v != q), key=lambda v: (-round(cos(f32[q], f32[v]), 9), v))[:4])]
    assert got == sorted(want)
    assert vectors.nearest(df.limit(0), df.limit(0)).count() == 0
