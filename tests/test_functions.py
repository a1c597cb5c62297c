import time

import pytest
from pyspark.sql import functions as F

from parlatrace.functions import html as H
from parlatrace.functions import text as X
from parlatrace.functions import time as M
from parlatrace.functions.labels import short_label, speaker_name, speaker_of
from parlatrace.functions.names import unique_names


def one(spark, expression, schema, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {schema}").select(expression(F.col("v")).alias("o")).collect()]


def test_str_to_ms(spark):
    assert one(spark, M.str_to_ms, "string", "01:00:00", "00:00:01", "99:99:99", "01:00:0X", "1:2", "", None, "+1:00:00") == [3600000, 1000, 362439000, None, None, None, None, 3600000]
    with pytest.raises(Exception, match="not hh:mm:ss"):
        one(spark, lambda c: M.str_to_ms(c, strict=True), "string", "01:00:0X")


def test_ms_to_str(spark):
    assert one(spark, M.ms_to_str, "bigint", 3600000, 0, 86400000, 86400001, -1000, None, 59999) == ["01:00:00", "00:00:00", "24:00:00", "24:00:00", None, None, "00:00:59"]
    assert one(spark, M.ms_to_str, "bigint", 30 * 3600000 + 61000, 400 * 3600000) == ["30:01:01", "400:00:00"]
    assert one(spark, lambda c: M.ms_to_str(c, True), "bigint", 1250, 60250) == ["00:00:01.250", "00:01:00.250"]
    assert one(spark, M.ms_to_webvtt, "bigint", 60250) == ["00:01:00.250"]
    with pytest.raises(Exception, match="outside a day"):
        one(spark, lambda c: M.ms_to_str(c, strict=True), "bigint", 86400001)


def test_rounding(spark):
    assert one(spark, M.seconds_to_ms, "double", 0.0005, 0.0015, 2.0, None, float("nan")) == [0, 2, 2000, None, None]
    assert one(spark, M.seconds_to_ms_truncated, "double", 1.9999, -1.9999) == [1999, -1999]


def test_pause_text(spark):
    texts = lambda first: one(spark, lambda c: M.pause_text(c, F.lit("."), F.lit(first)), "bigint", 1000, 2500, 9500, 10000, 60000, 90000, None)
    assert texts(False) == [" (.)", " (..)", " [10 seconds pause]", " [10 seconds pause]", " [1 minutes pause]", " [2 minutes pause]", None]
    assert texts(True)[0] == "(.) "
    assert one(spark, lambda c: M.pause_text(c, F.lit(None).cast("string"), F.lit(False)), "bigint", 2000) == [" (..)"]


def test_file_times(spark):
    name = lambda zone: one(spark, lambda c: M.file_time_utc(c, zone), "string", "/a/2025-07-01_10-43-22_x.wav", "2025-1-5_3-4-5.wav", "2025-13-01_00-00-00.wav", "notes.wav", None)
    assert name("UTC") == ["2025-07-01T10:43:22Z", "2025-01-05T03:04:05Z", None, None, None]
    assert name("Europe/Berlin")[:2] == ["2025-07-01T08:43:22Z", "2025-01-05T02:04:05Z"]
    assert one(spark, lambda c: M.file_time_utc(c, "UTC", F.lit("now")), "string", "notes.wav") == ["now"]


def test_dates(spark):
    text = one(spark, lambda c: M.date_in_text(c).cast("string"), "string", "x\nDate/Time: 2025-02-03 04:05\nDate/Time: 2026-01-01 00:00", "Date/Time: 2025-99-03 04:05", "none", None)
    assert text == ["2025-02-03 04:05:00", None, None, None]
    assert one(spark, lambda c: M.date_in_name(c, "Europe/Berlin").cast("string"), "string", "25.01.02 talk.md", "25.01.02talk.md", None) == ["2025-01-02 11:00:00", None, None]


def test_clock_and_entry(spark):
    assert one(spark, M.clock_minutes, "bigint", 61000, 3600000, -1, None) == ["1:01", "60:00", None, None]
    assert one(spark, M.is_time_entry, "string", "", "1", "12:", "12:3:45", "123", "1:2:3:4", "a") == [True, True, True, True, False, False, False]


LABELS = {
    "SPEAKER_03": "S03", "speaker-003": "S03", "Speaker 3": "S03", "SPEAKER_０３": "S03", "SPEAKER_O3": "S03", "SPEAKER_03:": "S03", " SPEAKER_03 ": "S03", "//SPEAKER_03": "S03", "//S3": "S03", "s3": "S03", "SPK-12": "S12", "spk0": "S00",
    "Speaker three": "S03", "Speaker Zero": "S00", "Speaker twenty-one": "S21", "Hablante 3": "S03", "Sprecher 39": "S39", "[S01]": "S01", "Spk 5": "S05", "SPEAKER_123": "S123", "SPEAKER_": None, "": None, None: None, "UNKNOWN": None, "?": None, "noise": None,
}


def test_labels(spark):
    assert dict(zip(LABELS, one(spark, speaker_of, "string", *LABELS), strict=True)) == LABELS
    assert {k: speaker_name(k) for k in LABELS} == LABELS
    assert one(spark, short_label, "string", "SPEAKER_01") == ["S01"]


def test_text(spark):
    assert one(spark, X.html_escape, "string", "a<b> & \"c\" 'd'", "", None) == ["a&lt;b&gt; &amp; &quot;c&quot; &#x27;d&#x27;", "", None]
    assert one(spark, X.vtt_escape, "string", "a\n\n\nb<") == ["a\nb&lt;"]
    assert one(spark, X.collapse_space, "string", " a \n b ") == ["a b"]
    assert one(spark, X.duration_from_text, "string", "at 12:30 and 01:15", "0:00", "word " * 450, "", None) == [750, 60, 180, 60, None]
    assert one(spark, X.duration_from_html_size, "bigint", 10240, 1) == [300, 60]
    assert one(spark, X.duration_from_wav_size, "bigint", 44 + 32000 * 3, 0) == [3, 0]
    assert one(spark, lambda c: X.overall_progress(c, F.lit(0.5), F.lit(True)), "int", 1, 2, 3, 7) == [0.025, 0.275, 0.75, -1.0]
    assert one(spark, lambda c: X.overall_progress(c, F.lit(1.0), F.lit(False)), "int", 3) == [0.99]
    assert one(spark, lambda c: X.step_percent(c, F.lit(4)), "int", 1, 8) == [25.0, 100.0]
    assert one(spark, X.channel_weights, "int", 1, 2, 4) == [None, None, [0.25] * 4]
    assert one(spark, X.is_gpu_error, "string", "CUDA failed", "cuda (device_cpu)", "disk full", None) == [True, False, False, None]


def test_versions(spark):
    data = spark.createDataFrame([("0.7", "0.6.2"), ("1.2", "1.2.0"), ("1.9", "1.10"), ("1.2.3", "1.2.4"), ("x", "1"), (None, "1")], "a string, b string")
    assert [r[0] for r in data.select(X.version_compare(F.col("a"), F.col("b"))).collect()] == [1, 0, 2, 2, None, None]
    assert [r[0] for r in data.select(X.version_compare(F.col("a"), F.col("b"), 2)).collect()] == [1, 0, 2, 0, None, None]


def test_anchors(spark):
    parts = one(spark, X.anchor_parts, "string", "ts_10_20_S01", "ts_10_20_S01_x", "top", "ts_a_2_S", None, "ts_1_2_")
    assert [tuple(p) if p else None for p in parts] == [(10, 20, "S01"), (10, 20, "S01"), None, (None, 2, "S"), None, (1, 2, "")]


@pytest.mark.parametrize(
    ("wanted", "existing", "given"),
    [
        ("test test test", "", "test test_1 test_2"),
        ("test test test_1", "", "test test_1 test_1_1"),
        ("test test test", "test", "test_1 test_2 test_3"),
        ("test test_1", "test", "test_1 test_1_1"),
        ("a b a", "b", "a b_1 a_1"),
        ("", "", ""),
    ],
)
def test_unique_names(spark, wanted, existing, given):
    full = lambda s: [f"/out/{x}.txt" for x in s.split()]
    row = spark.createDataFrame([(full(wanted), full(existing))], "w array<string>, e array<string>").select(unique_names(F.col("w"), F.col("e"))).first()[0]
    assert row == full(given)


def test_unique_names_run_out(spark):
    with pytest.raises(Exception, match="no free name"):
        spark.createDataFrame([(["a.txt"] * 5,)], "w array<string>").select(unique_names(F.col("w"), F.expr("cast(array() as array<string>)"), tries=3)).collect()


def in_order(wanted, existing):
    """The plain reading of unique_names."""
    given, taken = [], set(existing)
    for path in wanted:
        stem, dot, suffix = path.rpartition(".")
        names = (path if i == 0 else f"{stem}_{i}{dot}{suffix}" for i in range(1000))
        given.append(next(n for n in names if n not in taken))
        taken.add(given[-1])
    return given


def test_unique_names_of_a_full_day(spark):
    wanted = [f"/out/{i}.txt" for i in range(500)] + ["/out/a.txt", "/out/a_1.txt", "/out/7.txt", "/out/7_1.txt"] * 125
    df = spark.createDataFrame([(wanted, ["/out/a_3.txt"])], "w array<string>, e array<string>").select(unique_names(F.col("w"), F.col("e")))
    began = time.monotonic()
    given = df.first()[0]
    took = time.monotonic() - began
    assert given == in_order(wanted, ["/out/a_3.txt"])
    assert took < 20


def test_unique_names_of_nulls(spark):
    rows = [(["a.txt"], ["a.txt", None]), (None, ["a.txt"]), (["a.txt"], None)]
    df = spark.createDataFrame(rows, "w array<string>, e array<string>").select(unique_names(F.col("w"), F.col("e")))
    assert [r[0] for r in df.collect()] == [["a_1.txt"], None, None]
    with pytest.raises(Exception, match="no free name"):
        spark.createDataFrame([([None], [])], "w array<string>, e array<string>").select(unique_names(F.col("w"), F.col("e"))).collect()


def test_html(spark):
    assert one(spark, H.html_unescape, "string", "&lt;b&gt; &amp;amp; &#x27;&eacute;&nbsp;", "", None) == ["<b> &amp; 'é ", "", None]
    assert one(spark, H.html_to_plain, "string", "<p>a&nbsp;<b>b</b>\n c&lt;d</p>", "", None) == ["a b c<d", "", None]
    assert one(spark, H.html_to_blocks, "string", "<html><head><title>t</title></head><body><p> one <b>two</b></p><p>three<br>four</p></body></html>", "a &amp; b", "", None) == ["\none two\n\nthree\nfour\n", "a & b", "", None]
    assert one(spark, H.html_to_blocks, "string", "<div><ul><li>a<li>b</ul></div></p>")[0].split() == ["a", "b"]


def test_markdown(spark):
    from parlatrace.functions.markdown import markdown_to_html, to_html

    source = "# Title #\n\nOne *two* **three** `a<b` [x](http://y)\nnext & line\n- a\n  more\n- b\n\n1. c\n\n> quoted\n\n---\n```py\nx < 1\n\n```\n| h | i |\n|---|:-:|\n| 1 | **2** |\n| 3 |\n"
    want = [
        "<h1>Title</h1>", '<p>One <em>two</em> <strong>three</strong> <code>a&lt;b</code> <a href="http://y">x</a>\nnext &amp; line</p>', "<ul>\n<li>a\nmore</li>\n<li>b</li>\n</ul>", "<ol>\n<li>c</li>\n</ol>",
        "<blockquote>\n<p>quoted</p>\n</blockquote>", "<hr />", '<pre><code class="language-py">x &lt; 1\n\n</code></pre>',
        "<table>\n<thead>\n<tr><th>h</th><th>i</th></tr>\n</thead>\n<tbody>\n<tr><td>1</td><td><strong>2</strong></td></tr>\n<tr><td>3</td><td></td></tr>\n</tbody>\n</table>",
    ]
    assert to_html(source) == "\n".join(want)
    assert one(spark, markdown_to_html, "string", "", None, "a\r\nb", "```\nopen") == ["", None, "<p>a\nb</p>", "<pre><code>open\n</code></pre>"]
    assert to_html("word " * 200_000).startswith("<p>word")
