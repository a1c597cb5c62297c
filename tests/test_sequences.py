"""The ordered operators against plain folds over random recordings, with shards of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from parlatrace.operators import paragraphs, sequence, silence, throttle
from parlatrace.operators.attribution import attribute, named_turns, timed_segments

SEGMENTS = "job_id bigint, seg_no int, start_ms bigint, end_ms bigint, text string"
TURNS = "job_id bigint, turn_no int, start_ms bigint, end_ms bigint, label string"


def make(seed, jobs=12, n=40):
    rng = random.Random(seed)
    segments, turns = [], []
    for j in range(jobs):
        t = 0
        for k in range(n):
            t += rng.choice([0, 0, 200, 1500, 3000, 70000])
            length = rng.choice([0, -50, 400, 900, 2500, 8000])
            segments.append((j, k, t, t + length, f"t{k}"))
            t += max(0, length - rng.choice([0, 0, 300]))
        s = 0
        for k in range(n):
            s += rng.choice([0, 100, 900, 4000])
            length = rng.choice([0, 500, 1200, 5000, 20000, 130000])
            turns.append((j, k, s, s + length, f"SPEAKER_0{rng.randrange(3)}"))
    return segments, turns


def speaker_by_fold(turns, ts, te):
    """(speaker, overlapping) by going through the turns in order of start."""
    found, length, speaker, over = 0, 0, "", False
    for s, _no, e, label in turns:
        if te < s or te - ts <= 0:
            if te < s:
                break
            continue
        r = 0.0 if ts > e else (min(e, te) - max(s, ts) + 1) / (te - ts)
        if found >= 0.8:
            if r >= 0.8 and e - s < length:
                over, found, length, speaker = True, r, e - s, label
        elif r > found:
            found, length, speaker = r, e - s, label
    return speaker, over


@pytest.fixture(scope="module")
def attributed(spark):
    segments, turns = make(3)
    s, t = spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(turns + turns[:30], TURNS)
    return segments, turns, attribute(s, named_turns(t), bucket_ms=7000).cache()


def by_job(turns):
    jobs = {}
    for j, no, s, e, label in turns:
        jobs.setdefault(j, []).append((s, no, e, "S" + label[8:]))
    return {j: sorted(x) for j, x in jobs.items()}


def test_attribution(attributed):
    segments, turns, df = attributed
    jobs = by_job(turns)
    got = {(r.job_id, r.seg_no): (r.new_speaker, r.overlapping) for r in df.collect()}
    assert got == {(j, k): speaker_by_fold(jobs[j], s, e) for j, k, s, e, _ in segments}


def test_attribution_edges(spark, rows):
    segments = [(1, 0, 0, 1000, "a"), (1, 1, 5000, 5000, "none"), (1, 2, 1000, 2000, "touch"), (2, 0, 0, 10, "no turns"), (None, 0, 0, 1, "x")]
    turns = [(1, 0, 0, 799, "SPEAKER_00"), (1, 1, 2000, 2000, "SPEAKER_01"), (1, 2, None, 5, "SPEAKER_02"), (1, 3, 0, 1000, None), (1, 4, 9, 3, "SPEAKER_04")]
    s = spark.createDataFrame(segments, SEGMENTS).where("job_id is not null")
    out = attribute(s, named_turns(spark.createDataFrame(turns, TURNS)))
    assert rows(out, "job_id", "seg_no", "new_speaker", "overlapping") == [(1, 0, "S00", False), (1, 1, "", False), (1, 2, "S01", False), (2, 0, "", False)]
    empty = attribute(s.limit(0), named_turns(spark.createDataFrame([], TURNS)))
    assert empty.count() == 0


def actions_by_fold(segments, heard):
    out, speaker, prev, para, last_end = [], "", "", 0, 0
    for j, k, s, e, _ in segments:
        new = heard[j, k]
        before, gap, last_end = speaker, s - last_end, e
        if new and new != speaker:
            if new.startswith("//"):
                prev, speaker, action = speaker, new, "ov_start"
            elif speaker.startswith("//") and new == prev:
                speaker, action = new, "ov_return"
            else:
                action = "para_close" if speaker.startswith("//") else "para"
                speaker, para = new, para + 1
        else:
            action = "same"
        out.append((j, k, gap, speaker, before, action, para))
    return out


@pytest.mark.parametrize("width", [3, 7, 1000])
def test_actions(spark, attributed, rows, monkeypatch, width):
    monkeypatch.setattr(sequence, "SHARD_ROWS", width)
    segments, _turns, df = attributed
    heard = {(r.job_id, r.seg_no): ("//" if r.overlapping else "") + r.new_speaker for r in df.collect()}
    jobs = spark.createDataFrame([(j, True) for j in range(12)], "job_id bigint, overlapping boolean")
    got = rows(paragraphs.speaker_actions(df, jobs), "job_id", "seg_no", "gap_ms", "speaker", "before", "action", "para_no")
    want = [x for j in range(12) for x in actions_by_fold([s for s in segments if s[0] == j], heard)]
    assert got == sorted(want)
    assert {x[5] for x in want} == {"same", "ov_start", "ov_return", "para_close", "para"}


def shown_by_fold(jobs, interval):
    out = []
    for j, items in jobs.items():
        last = 0
        for k, start, forced, able in items:
            if forced or (able and start - last > interval):
                out.append((j, k, start))
                last = start
    return sorted(out)


@pytest.mark.parametrize(("width", "block"), [(2, 1024), (2, 3), (5, 2), (1000, 1024)])
@pytest.mark.parametrize("ordered", [True, False])
def test_spaced(spark, rows, width, block, ordered):
    rng = random.Random(width)
    jobs = {}
    for j in range(20):
        t, items = 0, []
        for k in range(60):
            t = t + rng.randrange(0, 900) if ordered else rng.randrange(0, 20000)
            items.append((k, t, rng.random() < 0.05 * (j % 3), rng.random() < 0.9))
        jobs[j] = items
    data = spark.createDataFrame([(j, *x, 2000) for j, items in jobs.items() for x in items], "job_id bigint, seg_no int, start_ms bigint, forced boolean, eligible boolean, interval_ms bigint")
    assert rows(throttle.spaced(data, width, block)) == shown_by_fold(jobs, 2000)


def test_spaced_is_strict_and_empty(spark, rows):
    schema = "job_id bigint, seg_no int, start_ms bigint, forced boolean, eligible boolean, interval_ms bigint"
    assert rows(throttle.spaced(spark.createDataFrame([(1, 0, 60000, False, True, 60000), (1, 1, 60001, False, True, 60000)], schema))) == [(1, 1, 60001)]
    assert throttle.spaced(spark.createDataFrame([], schema)).count() == 0


def test_functions_of_shards_are_bounded():
    """A shard of rising starts lists those within one interval only, and so does any composition."""
    import pandas as pd

    n, step, gap = 4096, 5000, 60_000
    functions = []
    for shard in range(4):
        begin = [(shard * n + i) * step for i in range(n)]
        frame = pd.DataFrame({"job_id": 1, "shard": shard, "start_ms": begin, "forced": False, "eligible": True, "interval_ms": gap, "low": 0, "high": max(0, begin[0] - step)})
        out = next(throttle._exits(iter([frame])))
        functions.append(out[throttle._SPACED].iloc[0].tolist())
        assert len(out["firsts"].iloc[0]) <= gap // step + 1
    whole = functions[0]
    for f in functions[1:]:
        whole = throttle._composed(whole, f)
        assert len(whole[4]) <= gap // step + 1
    last = 0
    for t in range(0, 4 * n * step, step):
        last = t if t - last > gap else last
    assert throttle._exit(whole, 0) == last
    for start in range(0, 4 * gap, step):  # applying one after the other is applying the composition
        state = start
        for f in functions[1:]:
            state = throttle._exit(f, state)
        assert len(functions[1][4]) > 0 and isinstance(state, int)


@pytest.mark.parametrize(("width", "block"), [(3, 1024), (3, 2), (1000, 1024)])
def test_stepped(spark, rows, width, block):
    rng = random.Random(5)
    data, want = [], []
    for j in range(10):
        last, v = 0, 0
        for k in range(50):
            v = max(0, min(1000, v + rng.randrange(-6, 12)))
            data.append((j, k, v))
            if abs(v - last) >= 10:
                want.append((j, k, v))
                last = v
    assert rows(throttle.stepped(spark.createDataFrame(data, "job_id bigint, seg_no int, value int"), width=width, block=block)) == sorted(want)


def snap_by_fold(pauses, s, e):
    for ps, pe in pauses:
        if ps > e:
            break
        if ps < s < pe:
            s = pe - 0.2
        if ps < e < pe:
            e = ps + 0.2
    return s, e


@pytest.mark.parametrize("width", [3, 1000])
def test_snap(spark, monkeypatch, width):
    monkeypatch.setattr(sequence, "SHARD_ROWS", width)
    rng = random.Random(8)
    chunks, segments, want = [], [], {}
    for j in range(15):
        t, mine = 0, []
        for k in range(30):
            t += rng.choice([1600, 8000, 40000, 900000])
            end = t + rng.choice([1600, 2400, 16000, 80000])
            mine.append((t, end))
            chunks.append((j, k, t, end))
            t = end
        duration = t / 16000 + 5
        pauses = [(e / 16000 - 0.2, (mine[i + 1][0] / 16000 + 0.2) if i + 1 < len(mine) else duration + 0.2) for i, (_, e) in enumerate(mine)]
        for k in range(40):
            a = rng.uniform(0, duration)
            b = a + rng.choice([-0.5, 0, 0.3, 2, 30])
            segments.append((j, k, a, b))
            want[j, k] = snap_by_fold(pauses, a, b)
        jobs = [(j, (max(c[3] for c in chunks if c[0] == j)) / 16000 + 5) for j in range(j + 1)]
    c = spark.createDataFrame(chunks + chunks[:9] + [(0, 99, None, 5)], "job_id bigint, chunk_no int, start_sample bigint, end_sample bigint")
    out = silence.snap(spark.createDataFrame(segments, "job_id bigint, seg_no int, start_s double, end_s double"), silence.silences(c, spark.createDataFrame(jobs, "job_id bigint, duration_s double")), bucket_s=3)
    got = {(r.job_id, r.seg_no): (r.snapped_start, r.snapped_end) for r in out.collect()}
    assert got == want
    assert any(e < s for s, e in got.values())


def test_gaps_over_shards(spark, rows, monkeypatch):
    monkeypatch.setattr(sequence, "SHARD_ROWS", 2)
    data = spark.createDataFrame([(1, 0, 500, 900, ""), (1, 5, 2000, 2500, ""), (1, 9, 2400, 3000, ""), (2, 4, 10, 20, "")], SEGMENTS)
    assert rows(paragraphs.with_gaps(data), "job_id", "seg_no", "gap_ms", "first_segment") == [(1, 0, 500, True), (1, 5, 1100, False), (1, 9, -100, False), (2, 4, 10, True)]


def test_document_closes_overlap_on_the_pause(spark, rows, monkeypatch):
    monkeypatch.setattr(sequence, "SHARD_ROWS", 1)
    jobs = spark.createDataFrame([(1, 0, 1, ".", "auto", "/x.html", True, True, 60000)], "job_id bigint, start_ms bigint, pause int, pause_marker string, speaker_detection string, transcript_file string, overlapping boolean, timestamps boolean, timestamp_interval bigint")
    heard = [(1, 0, 0, 900, " a", "S00", False), (1, 1, 900, 1900, " b", "S01", True), (1, 2, 4000, 5000, " c", "S02", False)]
    attributed = spark.createDataFrame(heard, "job_id bigint, seg_no int, start_ms bigint, end_ms bigint, text string, new_speaker string, overlapping boolean")
    actions = paragraphs.speaker_actions(attributed, jobs)
    shown = spark.createDataFrame([(1, 0)], "job_id bigint, seg_no int")
    document = paragraphs.document_rows(actions, jobs, shown, attributed)
    assert rows(document, "cue_no", "kind", "text", "para_no") == [(1, "segment", "S00: [00:00:00] a", 1), (2, "segment", " //S01: b", 1), (3, "pause", " (..)//", 1), (4, "segment", "S02: c", 2)]
    assert rows(paragraphs.paragraph_texts(document), "para_no", "text") == [(1, "S00: [00:00:00] a //S01: b (..)//"), (2, "S02: c")]


def test_timed_segments_leave_out_nulls(spark):
    data = spark.createDataFrame([(1, 0, None, 1.0, "a"), (1, 1, 0.0, None, "b"), (1, 2, 0.0, float("nan"), "c"), (None, 3, 0.0, 1.0, "d"), (1, 4, 0.0, 1.0, None)], "job_id bigint, seg_no int, start_s double, end_s double, text string")
    assert [r.seg_no for r in timed_segments(data).collect()] == [4]
    assert timed_segments(data).where(F.col("text").isNull()).count() == 1
