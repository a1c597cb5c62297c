import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlatrace.functions.html import plain_text
from parlatrace.llm.split import ACCENTS, Limit, bisect, limits_of, marked_text, parted_run, split_texts


def longest_run(text):
    return max((len(x) for x in re.split(r"[\s.!?。！？…]+", text)), default=0)


def check(text, limit, overlap):
    pieces = [x[:3] for x in bisect(text, limit, overlap)]
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in pieces)
    joined = text[: pieces[0][1]]
    for (_, before, _), (a, b, _) in zip(pieces, pieces[1:], strict=False):
        exact = max(0, before - overlap)
        assert a == exact or unicodedata.combining(text[exact]) and exact - ACCENTS <= a < exact
        assert b > before and (limit < 4 * ACCENTS + overlap or not unicodedata.combining(text[a]) or exact - a == ACCENTS or not a)
        joined += text[before:b]
    assert joined == text
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?,。、\n(é́", max_size=600), st.integers(20, 90), st.integers(0, 4))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_boundaries():
    sentence = "This is a sentence of some words. "
    assert {k for _, _, k in check(sentence * 60, 300, 30)} == {"start", "sentence"}
    assert {k for _, _, k in check((sentence * 3 + "(...) ") * 30, 500, 50)} == {"start", "pause"}
    assert {k for _, _, k in check("word " * 500, 300, 30)} == {"start", "space"}
    assert {k for _, _, k in check("ab" * 3000, 2000, 200)} == {"start", "forced"}
    assert {k for _, _, k in check("これは文です。" * 400, 300, 30)} == {"start", "sentence"}
    assert bisect("x" * 2000, 2000, 200) == [(0, 2000, "start", 0)] and len(bisect("x" * 2001, 2000, 200)) > 1
    cut = [b for _, b, _ in check("é" * 3000, 2000, 0)[:-1]]
    assert all(b % 2 == 0 for b in cut)


def test_very_long_text():
    text = " ".join("".join(random.Random(i).choices("abcdefgh", k=1 + i % 9)) + "." * (i % 7 == 0) for i in range(150_000))
    check(text, 2000, 200)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aaaaaaaaaaaaaaab .。,", max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_runs_longer_than_the_limit_are_parted(text, limit, overlap):
    cuts = bisect(text, limit, overlap)
    longest = longest_run(text)
    assert max(x[3] for x in cuts) <= longest and (longest <= limit) == (max(x[3] for x in cuts) <= limit)


def test_blocks_and_silence_are_boundaries():
    words = "some words without an end "
    cue = lambda i, gap=0: f'<a name="ts_{i * 5000 + gap}_{i * 5000 + 5000}_S01">{words}</a>'
    source = "".join(cue(i, 3000 if i % 10 == 0 else 0) for i in range(60))
    text, places = marked_text(source)
    assert text == plain_text(source) and places["pause"] and all(text[p:].startswith("some") for p in places["pause"])
    assert {x[2] for x in bisect(text, 400, 40, places)} == {"start", "pause"}
    source = "<ul>" + "".join(f"<li>{words * 3}</li>\n" for _ in range(40)) + "</ul>"
    text, places = marked_text(source)
    assert text == plain_text(source) and {x[2] for x in bisect(text, 400, 40, places)} == {"start", "block"}
    for odd in ("", "<p></p>", "a&am<p>p;b", "&lt;p&gt; \n\n x", "\ue000<p>a b</p>", " <p> a </p> <p>b</p>c\n \nd "):
        assert marked_text(odd)[0] == plain_text(odd)


LIMITS = [Limit(5, 2000, 200), Limit(6, 600, 60)]


def test_operator(spark, rows):
    texts = [(1, "<p>" + "Some words here. " * 200 + "</p>"), (2, "<p>short &amp; sweet</p>"), (3, ""), (4, None), (5, "<b></b>"), (6, "<p>" + "x" * 5000 + "</p>"), (2, "<p>short &amp; sweet</p>")]
    df = spark.createDataFrame(texts, "id bigint, html string").selectExpr("*", "'a' as text", "1 as piece_no", "2 as cut", "3 as limit_id")
    out = split_texts(df, ["id"], F.col("html"), LIMITS)
    assert rows(out.where("id = 2"), "limit_id", "piece_no", "text", "parted") == [(5, 0, "short & sweet", 0)] * 2 + [(6, 0, "short & sweet", 0)] * 2
    assert {r[0] for r in rows(out, "id")} == {1, 2, 6}
    assert {r.parted for r in out.where("id = 6 and piece_no > 0").collect()} == {5000} and {r.parted for r in out.where("id = 1").collect()} == {0}
    for r in out.where("id = 1").collect():
        assert plain_text(texts[0][1])[r.start_pos : r.end_pos] == r.text
    assert split_texts(df.limit(0), ["id"], F.col("html"), LIMITS).count() == 0


def test_limits(spark):
    table = spark.createDataFrame([(1, "container", 512, 0, "tokens"), (5, "piece", 2000, 200, "chars"), (6, "piece", 600, None, "chars"), (7, None, 1, 1, "chars")], "limit_id int, purpose string, capacity int, overlap int, unit string")
    assert limits_of(table) == [Limit(5, 2000, 200), Limit(6, 600, 0)]


@pytest.mark.parametrize(("text", "cut", "run"), [("a.b", 1, 0), ("ab.cd", 1, 2), ("3.5 and 10.2.14", 5, 3), ("…ab", 2, 2), ("abc", 1, 3), ("a b", 1, 0)])
def test_marks_are_boundaries_of_runs(text, cut, run):
    assert parted_run(text, cut) == run
