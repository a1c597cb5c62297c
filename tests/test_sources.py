import json

import pytest
from pyspark.sql import functions as F

from parlatrace.sources import readers, writers
from parlatrace.streaming import live

DOCUMENT = "job_id bigint, cue_no bigint, action string, start_ms bigint, end_ms bigint, speaker string, text string"


def document(spark):
    from parlatrace.functions.text import anchor_name, html_escape

    rows = [(1, 1, "para", 0, 900, "S00", "S00: a & b"), (1, 2, "same", 900, 1900, "S00", " <c>\n\n\nd"), (1, 3, "para", 2000, 3000, "S01", "S01: e")]
    df = spark.createDataFrame(rows, DOCUMENT)
    return df.withColumn("anchor", anchor_name(F.col("start_ms"), F.col("end_ms"), F.col("speaker"))).withColumn("html", html_escape(F.col("text")))


def heads(spark):
    return spark.createDataFrame([(1, "talk", "info", "/a.wav")], "job_id bigint, title string, info string, media string")


def body(df):
    return "".join(r.body for r in df.orderBy("job_id", "part").collect())


def test_rendering_and_back(spark, rows):
    html = body(writers.rendered(document(spark), heads(spark), "html"))
    assert html.count("<p>") == 4 and '<a name="ts_900_1900_S00"> &lt;c&gt;' in html and html.endswith("</html>\n")
    back = readers.transcript_anchors(spark.createDataFrame([(1, html + '<a name="top">x</a>')], "id bigint, html string"), "id", "html")
    assert rows(back, "position", "start_ms", "end_ms", "speaker", "text") == [(1, 0, 900, "S00", "S00: a & b"), (2, 900, 1900, "S00", " <c>\n\n\nd"), (3, 2000, 3000, "S01", "S01: e")]
    vtt = body(writers.rendered(document(spark), heads(spark), "vtt"))
    assert vtt.startswith("WEBVTT talk\n\nNOTE\ninfo\n\nNOTE media: /a.wav\n\n1\n00:00:00.000 --> 00:00:00.900\n<v S00>S00: a &amp; b\n\n2\n") and "<v S00>&lt;c&gt;\nd\n\n" in vtt
    txt = body(writers.rendered(document(spark), heads(spark), "txt"))
    assert txt == "talk\n\ninfo\n\n\nS00: a & b <c>\n\n\nd\n\nS01: e\n"
    with pytest.raises(TypeError):
        writers.file_format("x.docx")


def test_write_transcripts(spark, tmp_path):
    writers.write_transcripts(document(spark), heads(spark), "html", f"file://{tmp_path}/out")
    files = sorted((tmp_path / "out" / "job_id=1").glob("part*"))
    assert "".join(f.read_text() for f in files).startswith("<!DOCTYPE html>")


def test_readers(spark, tmp_path, rows):
    for name, text in (("b.html", "<p>b</p>"), ("a.html", "<p>a\n</p>"), ("c.md", "# c"), ("bare", "x"), ("d.txt", "no"), ("s.WAV", "123"), ("t.wav", "")):
        (tmp_path / name).write_text(text)
    where = f"file://{tmp_path}"
    assert [r.html for r in readers.html_files(spark, where).collect()] == ["<p>a\n</p>", "<p>b</p>"]
    assert [r.text for r in readers.note_files(spark, where).collect()] == ["x", "# c"]
    assert [(r.path[-5:], r.length) for r in readers.audio_files(spark, where).orderBy("path").collect()] == [("s.WAV", 3)]  # empty files are passed over
    seen = live.run_to_end(live.files_arriving(spark, where), "files")
    assert [r.path[-5:] for r in seen.collect()] == ["s.WAV"]


def test_payloads(spark, tmp_path):
    data = spark.createDataFrame([(1, "/p", "<p>é</p>", None, 5, None)], "payload_id bigint, transcript_path string, transcript_html string, started_at string, audio_duration_seconds int, source_tool string")
    sent = json.loads(writers.payloads_json(data).first().body)
    assert sent == {"transcript_path": "/p", "transcript_html": "<p>é</p>", "audio_duration_seconds": 5}
    writers.webhook_batches(f"file://{tmp_path}/hook")(data, 3)
    writers.webhook_batches(f"file://{tmp_path}/hook")(data, 3)
    assert spark.read.text(f"file://{tmp_path}/hook").count() == 1


def test_settings(tmp_path):
    path = str(tmp_path / "s.yml")
    assert readers.settings(path) == {}
    writers.write_settings(path, {"a": 1, "b": "x: y"})
    assert readers.settings(path) == {"a": "1", "b": "x: y"}
    assert writers.rescue_name("/o/t.html", {"/o/t_1.html"}) == "/o/t_2.html"
    with pytest.raises(RuntimeError):
        writers.rescue_name("/o/t", {f"/o/t_{i}" for i in range(1000)})


def test_clip_and_messages(spark, rows):
    df = spark.createDataFrame([(0, 10), (10, 20), (15, 40)], "start_ms bigint, end_ms bigint")
    assert rows(readers.clipped(df, F.lit(10), F.lit(0))) == [(10, 20), (15, 40)]
    assert rows(readers.clipped(df, F.lit(10), F.lit(20))) == [(10, 20)]
    log = spark.createDataFrame([("log", "x"), ("segment", "y"), (None, "z")], "type string, msg string")
    assert rows(readers.messages(log, "segment")) == [("segment", "y")]


def test_no_cue_is_lost_after_a_day(spark):
    from parlatrace.sources import writers

    hour = 3_600_000
    rows = [(1, i, i, s, s + 1500, "S01", f"t{i}", "para" if i == 1 else "same", 1, "a", f"t{i}") for i, s in ((1, -500), (2, 0), (3, 23 * hour), (4, 24 * hour + 1), (5, 30 * hour))]
    document = spark.createDataFrame(rows, "job_id bigint, out_no bigint, cue_no bigint, start_ms bigint, end_ms bigint, speaker string, text string, action string, para_no bigint, anchor string, html string")
    cues = [r.cue for r in writers.vtt_cues(document).orderBy("cue_no").collect()]
    assert [c.split("\n")[1].split(" ")[0] for c in cues] == ["00:00:00.000", "00:00:00.000", "23:00:00.000", "24:00:00.001", "30:00:00.000"]
    heads = spark.createDataFrame([(1, "title", "info", "m.wav")], "job_id bigint, title string, info string, media string")
    body = "".join(r.body for r in writers.rendered(document, heads, "vtt").orderBy("part").collect())
    assert body.count(" --> ") == 5


def test_scratch(spark):
    import os
    from types import SimpleNamespace as Made

    from parlatrace import session

    rows = session.cut(spark.range(3), "numbers")
    (path,) = {f.rsplit("/", 1)[0].removeprefix("file://") for f in rows.inputFiles()}
    assert rows.count() == 3 and os.path.isdir(path) and spark.sparkContext.applicationId in path
    session.clear_scratch(spark, path)
    assert not os.path.exists(path)
    unset = lambda master: Made(sparkContext=Made(master=master, getConf=lambda: {}), conf={})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(unset("yarn"))
    assert os.path.isdir(session.scratch_dir(unset("local[2]")))
