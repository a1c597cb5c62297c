"""Turns against a plain reading of the same documents, block by block."""

import html
import re

import pytest

from parlatrace.functions.labels import speaker_name
from parlatrace.llm.speaker_turns import speaker_turns

HEAD = '<html><head><style>p { }</style></head>\n<body>\n<div><p>Interview with A</p>\n<p><span>Audio: x.wav<br>(Language English (en) | Pause 1)</span></p>\n'


def doc(body):
    return HEAD + body + "</div>\n</body></html>"


CASES = {
    "anchors": ('<p><a name="ts_500_900_S01">S01: <span>[00:00:00]</span> Hello there.</a><a name="ts_900_1500_"> And uh, more.</a><a name="ts_1500_1600_S02"> (laughs)</a></p><p><a name="ts_1600_2000_//S2"> //S02: Yes.//</a><a name="ts_100_400_spk-2"> Early.</a></p>', [(100, "S02", "Early."), (500, "S01", "Hello there. And more."), (1600, "S02", "Yes.")]),
    "paragraphs": ("<p><strong>[S00] [00:00:01]:</strong> One.</p>\n<p><strong>Speaker&nbsp;1 (00:05):</strong> Two.</p>\n<p><strong> 00:07:</strong> Three.</p>", [(1000, "S00", "One."), (5000, "S01", "Two. Three.")]),
    "br": ("<p><strong>S00</strong> (00:00:01)<br/>One.</p>\n<p><strong>S01</strong> 00:02<br/>[noise]</p>", [(1000, "S00", "One.")]),
    "list": ("<ul>\n<li>SPK-00 (00:00:02) -- cough --</li>\n<li>S05 (00:00:07) One.</li>\n<li>[00:09] S06 - Two.</li>\n<li>Speaker Four 01:00:00 Three.</li></ul>", [(7000, "S05", "One."), (9000, "S06", "Two."), (3600000, "S04", "Three.")]),
    "table": ("<table>\n<tr><td>[00:00:07]</td><td>S00</td><td>One.</td></tr>\n<tr><td>00:09</td><td></td><td>Two.</td></tr><tr><td>(100:00:01)</td><td>speaker 03</td><td>Three.</td></tr></table>", [(7000, "S00", "One. Two."), (360001000, "S03", "Three.")]),
    "headings": ("<h4>[00:00:05] S00</h4>\n<p>One.</p>\n<h4>00:07 [S04]</h4>\n<p>Hmm.</p>\n<h4>(00:08) </h4>\n<p>Two.</p>", [(5000, "S00", "One."), (8000, "S04", "Two.")]),
    "cues": ("<pre>\n1\n00:00:01.220 --&gt; 00:00:04.940\nS01: One.\n\n2\n00:00:05.000 --&gt; 00:00:06.000\n&lt;v Speaker 2&gt;Two.\n\n3\n00:00:07.000 --&gt; 00:00:08.000\n- S02\nThree.\n\n</pre>", [(1220, "S01", "One."), (5000, "S02", "Two. Three.")]),
    "no speakers": ('<p><a name="ts_1_2_"> One.</a></p>', []),
    "no time": ("<p>One.</p>", []),
    "repeated part": ('<p><a name="ts_1_2_S0"> One.</a><a name="ts_5_6_S1"> Two.</a><a name="ts_1_2_S0"> One.</a></p>', [(1, "S00", "One."), (5, "S01", "Two.")]),
    "only sounds": ('<p><a name="ts_1_2_S0"> Mm-hmm, uh.</a><a name="ts_3_4_S0"> [unintelligible 00:03]</a><a name="ts_5_6_S0"> (3.5)</a><a name="ts_7_8_S0"> …</a></p>', []),
    "german er": ('<p><a name="ts_1_2_S0"> Er geht um acht, ähm, heim.</a></p>', [(1, "S00", "Er geht um acht, heim.")]),
}


@pytest.fixture(scope="module")
def found(spark):
    data = [(i, doc(body).replace("(en)", "(de)") if name == "german er" else doc(body)) for i, (name, (body, _)) in enumerate(CASES.items())]
    data += [(100, None), (None, doc(CASES["list"][0])), (101, ""), (102, "<body>" + "x" * 200_000 + "</body>")]
    df = spark.createDataFrame(data + data[:2], "payload_id bigint, transcript_html string").selectExpr("*", "'s' as speaker", "1 as position", "'x' as text", "0 as start_ms")
    out = {}
    for r in speaker_turns(df).orderBy("payload_id", "turn_no").collect():
        out.setdefault(r.payload_id, []).append((r.start_ms, r.speaker, r.text))
    return out


@pytest.mark.parametrize("name", list(CASES))
def test_cases(found, name):
    assert found.get(list(CASES).index(name), []) == CASES[name][1]


def test_others_have_none(found):
    assert set(found) <= set(range(len(CASES)))


def test_empty(spark):
    assert speaker_turns(spark.createDataFrame([], "payload_id bigint, transcript_html string")).count() == 0


def brute(source):
    """Anchored documents only, read with a few plain rules."""
    units, speaker = [], None
    for m in re.finditer(r'<a name="ts_(\d+)_\d+_([^"]*)">(.*?)</a>', source, re.S):
        speaker = speaker_name(html.unescape(m[2])) or speaker
        text = html.unescape(re.sub(r"<[^>]*>", "", m[3]))
        text = re.sub(r"^\s*(?://)?\[?(?:speaker|sprecher|spk|s)[\s_-]?\w+\]?\s*[:>-]", "", text, flags=re.I)
        text = re.sub(r"\[[^\]]*\]|\(\(.*?\)\)|\([^()]*\)|\{[^}]*\}|<[^>]*>|\*[^*]*\*|♪[^♪]*♪|-- [^-]* --", " ", text)
        words = [w for w in re.findall(r"[^\W_]+(?:-[^\W_]+)*", text) if not re.fullmatch(r"u+h+m*|u+m+|e+r+m*|a+h+|h+m+|mhm|m+|mm-hmm|uh-huh|huh|ä+h+m*|ö+h*m+|e+h+m*|eu+h+|heu|hum", w, re.I)]
        if words and speaker:
            units.append((int(m[1]), len(units), speaker))
    turns = []
    for start, _, who in sorted(units):
        if not turns or turns[-1][1] != who:
            turns.append((start, who))
    return set(turns)


def test_against_plain_reading(spark):
    from pathlib import Path

    path = Path("/root/testdata/sf0.01/payloads.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    df = spark.read.parquet(str(path)).where("transcript_html like '%name=\"ts\\_%'")
    got = {}
    for r in speaker_turns(df).collect():
        got.setdefault(r.payload_id, set()).add((r.start_ms, r.speaker))
    want = {r.payload_id: b for r in df.select("payload_id", "transcript_html").collect() if (b := brute(r.transcript_html))}
    assert got == want


def test_segments_and_turns(spark):
    from parlatrace.llm.speaker_turns import segment_turns

    said = [(0.0, 1.0, " Uh, one. "), (1.0, 2.0, "(laughs)"), (2.0, 3.0, "Two."), (3.0, None, "Three."), (None, 5.0, "Never."), (5.0, 6.0, "Four, um, [noise] five."), (6.0, 7.0, None), (6.5, 6.5, "Six."), (7.0, 8.0, "Seven."), (20.0, 21.0, "Eight.")]
    heard = [(0, 1000, "SPEAKER_01"), (1000, 2000, "spk 2"), (2000, 3000, "Speaker one"), (5000, 6000, "//S2"), (6000, 7000, "noise"), (7000, 8000, "S03"), (7000, 8000, None)]
    segments = [(job, n, *x) for job in (7, 8) for n, x in enumerate(said)]
    turns = [(7, n, *x) for n, x in enumerate(heard)]
    languages = spark.createDataFrame([(7, "en")], "job_id bigint, language_code string")
    s = spark.createDataFrame(segments + segments[:3], "job_id bigint, seg_no int, start_s double, end_s double, text string")
    u = spark.createDataFrame(turns + turns[:3], "job_id bigint, turn_no int, start_ms bigint, end_ms bigint, label string")
    want = [(7, 1, 0, "S01", 3, "one. Two. Three."), (7, 2, 5000, "S02", 2, "Four, five. Six."), (7, 3, 7000, "S03", 2, "Seven. Eight.")]
    for widths in ({}, {"width": 2, "width_ms": 1500}):  # shards of a few rows change nothing
        got = segment_turns(s, u, languages, **widths)
        assert sorted(tuple(r) for r in got.collect()) == want
