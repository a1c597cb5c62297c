"""SQL for DuckDB with the meaning of the queries in core. The shapes are plain ones: whole windows, recursive folds, direct joins."""

from __future__ import annotations

from parlatrace.functions.labels import speaker_of_sql
from parlatrace.functions.text import GPU_ERROR_WORDS

SEG = """seg as (select job_id, seg_no, any_value(text) as text, any_value(start_s) as start_s, any_value(end_s) as end_s from segments group by job_id, seg_no),
timed as (select job_id, seg_no, text, cast(round_even(start_s * 1000.0, 0) as bigint) as s, cast(round_even(end_s * 1000.0, 0) as bigint) as e from seg
 where start_s is not null and end_s is not null)"""
GAPS = "gaps as (select *, lag(e) over (partition by job_id order by seg_no) as p from timed)"
PAUSE_TEXT = """case when len >= 60 then '[' || cast(cast(round_even(len / 60.0, 0) as bigint) as varchar) || ' minutes pause]' when len >= 10 then '[' || cast(len as varchar) || ' seconds pause]'
 else '(' || repeat(coalesce(pause_marker, '.'), cast(len as integer)) || ')' end"""
TURNS = f"""tr as (select job_id, turn_no, start_ms as ts, end_ms as te, {speaker_of_sql("label")} as speaker from (select distinct job_id, turn_no, start_ms, end_ms, label from turns)
 where start_ms is not null and end_ms is not null),
pairs as (select g.job_id, g.seg_no, t.*exclude(job_id), (least(e, te) - greatest(s, ts) + 1) / cast(e - s as double) as r from timed g join tr t on g.job_id = t.job_id and ts <= e and te >= s and e > s and te >= ts where speaker is not null),
fits as (select job_id, seg_no, first(speaker order by te - ts, ts, turn_no) as speaker, first(turn_no order by te - ts, ts, turn_no) as win, first(turn_no order by ts, turn_no) as early from pairs where r >= 0.8 group by 1, 2),
most as (select job_id, seg_no, first(speaker order by r desc, ts, turn_no) as speaker from pairs where r > 0 group by 1, 2),
heard as (select t.*, coalesce(f.speaker, m.speaker, '') as new_speaker, coalesce(f.win <> f.early, false) as overlapping from timed t left join fits f using (job_id, seg_no) left join most m using (job_id, seg_no))"""
ACTIONS = """h1 as (select h.*, case when new_speaker <> '' then case when h.overlapping and coalesce(j.overlapping, true) then '//' else '' end || new_speaker end as heard from heard h left join jobs j using (job_id)),
h2 as (select *, coalesce(last_value(heard ignore nulls) over (partition by job_id order by seg_no), '') as speaker, coalesce(lag(e) over (partition by job_id order by seg_no), 0) as p, row_number() over (partition by job_id order by seg_no) = 1 as is_first from h1),
h3 as (select *, coalesce(lag(speaker) over (partition by job_id order by seg_no), '') as before from h2),
h4 as (select *, heard is not null and heard <> before as changed, last_value(case when heard is not null and heard <> before and heard like '//%' then before end ignore nulls) over (partition by job_id order by seg_no) as prev from h3),
h5 as (select *, case when not changed then 'same' when heard like '//%' then 'ov_start' when before like '//%' and heard = coalesce(prev, '') then 'ov_return' when before like '//%' then 'para_close' else 'para' end as action from h4),
acts as (select *, s - p as gap_ms, cast(sum(case when action in ('para', 'para_close') then 1 else 0 end) over (partition by job_id order by seg_no) as bigint) as para_no from h5)"""
OPTIONS = """opts as (select job_id, coalesce(start_ms, 0) as start_ms, coalesce(stop_ms, 0) as stop_ms, coalesce(speaker_detection, 'auto') as speaker_detection,
 not coalesce(lower(transcript_file) like '%.vtt', false) and coalesce(overlapping, true) as overlapping, not coalesce(lower(transcript_file) like '%.vtt', false) and coalesce(timestamps, false) as timestamps,
 case when coalesce(lower(transcript_file) like '%.vtt', false) then 0 else coalesce(pause, 1) end as pause, coalesce(timestamp_interval, 60000) as timestamp_interval, coalesce(pause_marker, '.') as pause_marker from jobs)"""


def clock(ms: str, cue: bool = False) -> str:
    """Hours go on beyond 24; a cue's time is zero at least."""
    if cue:
        return f"printf('%02d:%02d:%02d.%03d', greatest(0, {ms}) // 3600000, greatest(0, {ms}) // 60000 % 60, greatest(0, {ms}) // 1000 % 60, greatest(0, {ms}) % 1000)"
    return f"case when ({ms}) >= 0 then printf('%02d:%02d:%02d', ({ms}) // 3600000, ({ms}) // 60000 % 60, ({ms}) // 1000 % 60) end"


def fold(rows: str, test: str, last: str) -> str:
    """A recursive fold over rows (job_id, seg_no, rn, v, ..): test says whether a row passes given the value last let through."""
    first, later = test.format(r="", last="0"), test.format(r="r.", last="f.state")
    return f"""fold as (select {rows}.*, {first} as passes, case when {first} then {last} else 0 end as state from {rows} where rn = 1
 union all select r.*, {later} as passes, case when {later} then r.{last} else f.state end from fold f join {rows} r on r.job_id = f.job_id and r.rn = f.rn + 1)"""


# the throttle of the written document: forced rows pass, only unchanged speakers may
SHOWN = f"""shown_in as (select a.job_id, a.seg_no, a.s as v, o.timestamp_interval as gap, a.action in ('para', 'para_close') or (o.speaker_detection = 'none' and a.is_first) as forced, a.action = 'same' as able,
 row_number() over (partition by a.job_id order by a.seg_no) as rn from acts a join opts o using (job_id) where o.timestamps),
{fold("shown_in", "({r}forced or ({r}able and {r}v - {last} > {r}gap))", "v")}"""
DOC = f"""d1 as (select a.*, o.start_ms as off, coalesce(j.pause, 0) as pause, j.pause_marker, coalesce(j.speaker_detection, 'auto') <> 'none' as detect, lower(j.transcript_file) like '%.vtt' as vtt, coalesce(f.passes, false) as shows,
 cast(round_even(gap_ms / 1000.0, 0) as bigint) as len, '[' || coalesce({clock("o.start_ms + a.s")}, '') || ']' as stamp, a.action in ('para', 'para_close') as is_para
 from acts a join opts o using (job_id) join jobs j using (job_id) left join fold f on f.job_id = a.job_id and f.seg_no = a.seg_no),
d2 as (select *, case when action = 'ov_start' then ' ' || speaker || ':' || coalesce(text, '') when action = 'ov_return' then '//' || coalesce(text, '') when is_para and shows then speaker || ': ' || stamp || coalesce(text, '')
 when is_para and vtt then ltrim(coalesce(text, '')) when is_para then speaker || ':' || coalesce(text, '') when shows then ' ' || stamp || coalesce(text, '') else coalesce(text, '') end as txt from d1),
d3 as (select job_id, cast(seg_no * 2 + 1 as bigint) as out_no, 'segment' as kind, off + s as start_ms, off + e as end_ms, speaker, case when not detect and is_first then ltrim(txt) else txt end as text, action, para_no from d2
 union all select job_id, cast(seg_no * 2 as bigint), 'pause', off + p, off + s, before, case when is_first then {PAUSE_TEXT} || ' ' else ' ' || {PAUSE_TEXT} end, 'same', case when is_para then para_no - 1 else para_no end
 from d2 where pause > 0 and gap_ms >= pause * 1000),
doc as (select job_id, out_no, row_number() over (partition by job_id order by out_no) as cue_no, kind, start_ms, end_ms, speaker,
 text || case when lead(action) over (partition by job_id order by out_no) = 'para_close' then '//' else '' end as text, para_no,
 'ts_' || start_ms || '_' || end_ms || '_' || speaker as anchor from d3)"""
DOCUMENT = f"with recursive {SEG}, {TURNS}, {ACTIONS}, {OPTIONS}, {SHOWN}, {DOC}"
PROGRESS = """pr as (select job_id, seg_no, least(0.99, case when coalesce(speaker_detection, 'auto') <> 'none' then 0.5 + 0.5 * share else 0.05 + 0.95 * share end) as progress
 from (select *, round_even(end_s / duration_s * 100, 0) / 100 as share from seg join jobs using (job_id) where end_s is not null and duration_s > 0 and not isnan(duration_s)))"""


def escape(x: str, quotes: bool = True) -> str:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{ref}')"
    return x


def unescape(x: str) -> str:
    for ref, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&nbsp;", " "), ("&#8203;", "​"), ("&#64;", "@"), ("&#x40;", "@"), ("&commat;", "@"), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{raw}')"
    return x


SPACE = r"[\s\x{00a0}\x{0085}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b\x1c-\x1f]"
STEM = r"regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')"

ORACLE = {
    "pause_gaps": f"with {SEG}, {GAPS} select job_id, seg_no, s - coalesce(p, 0) as gap_ms, p is null as first_segment from gaps",
    "pause_rows": f"""with {SEG}, {GAPS}, x as (select g.*, coalesce(j.start_ms, 0) as off, j.pause, j.pause_marker, s - coalesce(p, 0) as gap_ms, cast(round_even((s - coalesce(p, 0)) / 1000.0, 0) as bigint) as len
 from gaps g join jobs j using (job_id) where j.pause > 0 and s - coalesce(p, 0) >= j.pause * 1000)
 select job_id, seg_no, off + coalesce(p, 0) as start_ms, off + s as end_ms, gap_ms, case when p is null then {PAUSE_TEXT} || ' ' else ' ' || {PAUSE_TEXT} end as text from x""",
    "pause_summary": f"""with {SEG}, {GAPS}, x as (select g.*, s - coalesce(p, 0) as gap_ms from gaps g join jobs j using (job_id) where j.pause > 0 and s - coalesce(p, 0) >= j.pause * 1000)
 select job_id, count(*) as pauses, cast(sum(gap_ms) as bigint) as silent_ms, max(gap_ms) as longest_ms from x group by 1""",
    "pause_snap": f"""with {SEG}, ch as (select distinct job_id, chunk_no, start_sample, end_sample from speech_chunks where start_sample is not null and end_sample is not null),
 pa as (select job_id, end_sample / 16000.0 - 0.2 as ps, coalesce(lead(start_sample) over (partition by job_id order by chunk_no) / 16000.0, case when not isnan(duration_s) then duration_s end) + 0.2 as pe from ch left join jobs using (job_id)),
 near as (select g.job_id, g.seg_no, g.start_s, g.end_s, list({{'s': ps, 'e': pe}} order by ps, pe) filter (ps is not null) as l from seg g left join pa on pa.job_id = g.job_id and pe > ps and pe > least(g.start_s, g.end_s) and ps <= g.end_s
 where g.start_s is not null and g.end_s is not null group by all),
 mv as (select *, case when l is null then {{'s': start_s, 'e': end_s}} else list_reduce(l, lambda b, x: {{'s': case when x.s <= b.e and b.s > x.s and b.s < x.e then x.e - 0.2 else b.s end, 'e': case when x.s <= b.e and b.e > x.s and b.e < x.e then x.s + 0.2 else b.e end}}, {{'s': start_s, 'e': end_s}}) end as m from near)
 select job_id, seg_no, start_s, end_s, m.s as snapped_start, m.e as snapped_end from mv""",
    "speaker_attribution": f"with {SEG}, {TURNS} select job_id, seg_no, s as start_ms, e as end_ms, new_speaker, overlapping from heard",
    "speaker_actions": f"with {SEG}, {TURNS}, {ACTIONS} select job_id, seg_no, gap_ms, speaker, action, para_no from acts",
    "speaker_stats": f"with {SEG}, {TURNS} select job_id, new_speaker as speaker, count(*) as segments, cast(sum(e - s) as bigint) as speech_ms, count(*) filter (overlapping) as overlapping from heard where new_speaker <> '' group by 1, 2",
    "document_rows": f"{DOCUMENT} select * from doc",
    "paragraph_texts": f"{DOCUMENT} select job_id, para_no, out_no // 4096 as part, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_rows, md5(string_agg(text, '' order by out_no)) as digest from doc group by 1, 2, 3",
    "vtt_cues": f"""{DOCUMENT} select job_id, cue_no, cast(cue_no as varchar) || chr(10) || {clock("start_ms", True)} || ' --> ' || {clock("end_ms", True)} || chr(10) || '<v ' || speaker || '>'
 || regexp_replace(regexp_replace({escape("text")}, '\\n{{2,}}', chr(10), 'g'), '^\\s+', '') || chr(10) || chr(10) as cue from doc""",
    "timestamp_throttle": f"""with recursive {SEG}, x as (select t.job_id, seg_no, s as v, coalesce(timestamp_interval, 60000) as gap, row_number() over (partition by t.job_id order by seg_no) as rn from timed t join jobs using (job_id)),
 {fold("x", "({r}v - {last} > {r}gap)", "v")} select job_id, seg_no, v as start_ms from fold where passes""",
    "progress_map": f"with {SEG}, {PROGRESS} select job_id, seg_no, round_even(progress, 6) as progress from pr",
    "progress_throttle": f"""with recursive {SEG}, {PROGRESS}, x as (select job_id, seg_no, least(1000, greatest(0, cast(round_even(progress * 1000, 0) as integer))) as v, row_number() over (partition by job_id order by seg_no) as rn from pr),
 {fold("x", "(abs({r}v - {last}) >= 10)", "v")} select job_id, seg_no, v as value from fold where passes""",
    "queue_summary": """select *, total - waiting - running as done, waiting > 0 as has_pending, running > 0 as is_running, total = 0 as is_empty from (select count(*) as total, count(*) filter (s = 'waiting') as waiting,
 count(*) filter (s in ('audio_conversion', 'speaker_identification', 'transcription', 'canceling')) as running, count(*) filter (s = 'finished') as finished, count(*) filter (s = 'error') as failed,
 count(*) filter (s = 'canceled') as canceled from (select lower(trim(status)) as s from jobs))""",
    "next_job": "select job_id, ordinal from jobs where lower(trim(status)) = 'waiting' order by ordinal limit 1",
    "last_finished": "select job_id, ordinal from jobs where lower(trim(status)) = 'finished' order by ordinal desc limit 1",
    "running_jobs": "select job_id, lower(trim(status)) as state from jobs where lower(trim(status)) in ('audio_conversion', 'speaker_identification', 'transcription', 'canceling')",
    "output_conflicts": """select job_id, transcript_file from jobs a where exists (select 1 from jobs b where b.transcript_file = a.transcript_file and b.job_id <> a.job_id
 and coalesce(lower(trim(b.status)) not in ('error', 'canceled', 'canceling'), true))""",
    "effective_options": f"with {OPTIONS} select * from opts",
    "option_line": f"""select job_id, concat_ws(' | ', case when start_ms > 0 then 'Start ' || replace({clock("start_ms")}, ':', '꞉') end, case when stop_ms > 0 then 'Stop ' || replace({clock("stop_ms")}, ':', '꞉') end,
 'Language ' || language_name, 'Speakers ' || speaker_detection, 'Overlapping ' || overlapping, 'Timestamps ' || timestamps, 'Pause ' || pause) as options from jobs""",
    "job_summaries": f"""select job_id, concat_ws(chr(10), 'Transcript: ' || regexp_extract(transcript_file, '([^/]*)$', 1), 'Start: ' || case when start_ms > 0 then {clock("start_ms")} else '00:00:00' end,
 'Stop: ' || case when stop_ms > 0 then {clock("stop_ms")} else 'end' end, 'Language: ' || language_name, 'Pause: ' || coalesce(case pause when 0 then 'none' when 1 then '1sec+' when 2 then '2sec+' when 3 then '3sec+' end, cast(pause as varchar)),
 'Speakers: ' || speaker_detection, 'Overlapping: ' || case when overlapping then '✓' else '✗' end, 'Timestamps: ' || case when timestamps then '✓' else '✗' end) as summary from jobs""",
    "state_changes": """with x as (select transcript_file, ordinal, lower(trim(status)) as s, lag(lower(trim(status))) over (partition by transcript_file order by ordinal) as p,
 list_position(['waiting', 'audio_conversion', 'speaker_identification', 'transcription', 'finished'], lower(trim(status))) as n from jobs where transcript_file is not null),
 y as (select *, list_position(['waiting', 'audio_conversion', 'speaker_identification', 'transcription', 'finished'], p) as m from x)
 select transcript_file, max_by(s, ordinal) as state, count(*) filter (not coalesce(p is null or coalesce(n > m, false) or (s in ('error', 'canceling') and p in ('audio_conversion', 'speaker_identification', 'transcription', 'canceling'))
 or (p = 'canceling' and s = 'canceled') or (s = 'waiting' and p in ('finished', 'error', 'canceled')) or s = p, false)) as bad_changes, count(*) as events from y group by 1""",
    "job_span": "select min(created_at) as first_start, max(created_at) as last_end, date_diff('millisecond', min(created_at), max(created_at)) as elapsed_ms from jobs",
    "language_codes": """with v as (select lower(code) as v, code, 0 as r from languages union all select lower(name), code, 1 from languages), u as (select v, first(code order by r, code) as code from v group by v)
 select job_id, code as language_code, case when lower(code) not in ('multilingual', 'auto') then lower(code) end as language, lower(code) = 'multilingual' as multilingual, lower(code) = 'auto' as detect from jobs left join u on lower(trim(language_name)) = v""",
    "speaker_labels": f"select job_id, turn_no, {speaker_of_sql('label')} as speaker from (select distinct job_id, turn_no, label from turns)",
    "clock_times": f"""with {SEG} select job_id, seg_no, {clock("s")} as clock, case when s >= 0 then {clock("s", True)} end as cue_time, case when s >= 0 then s // 1000 * 1000 end as back_ms,
 case when s >= 0 then (s // 60000) || ':' || lpad(cast(s // 1000 % 60 as varchar), 2, '0') end as minutes from timed""",
    "file_times": f"""select job_id, strftime(try_strptime(regexp_extract(audio_file, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}_[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}})[^/]*$', 1), '%Y-%m-%d_%H-%M-%S'), '%Y-%m-%dT%H:%M:%SZ') as recorded_at,
 {STEM.format("audio_file")} as stem, regexp_extract(audio_file, '[^/](\\.[^./]*)$', 1) as suffix from jobs""",
    "anchor_codec": f"with {SEG} select job_id, seg_no, 'ts_' || s || '_' || e || '_S01' as anchor, s as start_ms, e as end_ms, 'S01' as speaker from timed",
    "escaped_texts": f"with {SEG} select job_id, seg_no, {escape('text')} as html, regexp_replace({escape('text')}, '\\n{{2,}}', chr(10), 'g') as vtt from timed",
    "html_plain": f"with x as (select payload_id, trim(regexp_replace({unescape(chr(32).join(['regexp_replace(transcript_html,', chr(39) + '<[^>]+>' + chr(39) + ',', chr(39) * 2 + ',', chr(39) + 'g' + chr(39) + ')']))}, '{SPACE}+', ' ', 'g')) as t from payloads) select payload_id, length(t) as n_chars, md5(t) as digest from x",
    "html_anchors": """with x as (select payload_id, unnest(regexp_extract_all(transcript_html, '<a name="([^"]*)"', 1)) as name, generate_subscripts(regexp_extract_all(transcript_html, '<a name="([^"]*)"', 1), 1) as position from payloads)
 select payload_id, position, cast(split_part(name, '_', 2) as bigint) as start_ms, cast(split_part(name, '_', 3) as bigint) as end_ms, split_part(name, '_', 4) as speaker from x where name like 'ts\\_%' escape '\\'""",
    "text_durations": f"""with x as (select doc_id, list_max(list_transform(regexp_extract_all(text, '\\b([0-9]{{1,2}}:[0-9]{{2}})\\b', 1), lambda t: cast(split_part(t, ':', 1) as integer) * 60 + cast(split_part(t, ':', 2) as integer))) as m,
 len(list_filter(string_split(trim(regexp_replace(text, '{SPACE}+', ' ', 'g')), ' '), lambda w: w <> '')) as w from documents) select doc_id, cast(case when m > 0 then m else greatest(60, w // 150 * 60) end as integer) as seconds from x""",
    "size_durations": """select payload_id, greatest(60, cast(trunc(strlen(transcript_html) / 1024.0 * 30) as integer)) as html_seconds, cast(round_even(greatest(0.0, (strlen(transcript_html) - 44) / 32000.0), 0) as integer) as wav_seconds from payloads""",
    "document_dates": r"""select doc_id, coalesce(try_strptime(nullif(regexp_extract(text, 'Date/Time: (\d{4}-\d{2}-\d{2} \d{2}:\d{2})', 1), ''), '%Y-%m-%d %H:%M'), added_at) as dated from documents""",
    "text_chunks": """select doc_id, cast(i as integer) as chunk_no, md5(substring(text, cast(i * 1800 + 1 as bigint), 2000)) as digest from (select doc_id, text, unnest(generate_series(0, cast(greatest(0, ceil((length(text) - 2000) / 1800.0)) as bigint))) as i from documents where length(text) > 0)""",
    "untranscribed": f"""select job_id, audio_file as path from jobs where {STEM.format("audio_file")} not in (select {STEM.format("transcript_path")} from payloads where lower(transcript_path) like '%.html')""",
    "recordings": "select job_id, audio_file as path from jobs where lower(audio_file) like '%.wav'",
    "first_of_name": """with x as (select regexp_extract(transcript_file, '([^/]*)$', 1) as name, transcript_file as path, case when lower(trim(status)) = 'finished' then 0 else 1 end as priority from jobs where transcript_file is not null and status is not null)
 select name, first(path order by priority, path) as path, min(priority) as priority, count(*) - 1 as hidden from x group by 1""",
    "payload_outcomes": "select count(*) filter (audio_duration_seconds > 0) as succeeded, count(*) - count(*) filter (audio_duration_seconds > 0) as failed from payloads",
    "clipped": f"with {SEG} select job_id, seg_no, s as start_ms, e as end_ms from timed join jobs using (job_id) where s >= coalesce(start_ms, 0) and (coalesce(stop_ms, 0) <= 0 or e <= stop_ms)",
    "calendar_match": """with x as (select payload_id, job_id, abs(epoch_us(p.received_at) - epoch_us(j.created_at)) as away from payloads p join (select job_id, created_at from jobs) j on j.created_at between p.received_at - interval 5 minutes and p.received_at + interval 5 minutes)
 select payload_id as meeting_id, first(job_id order by away, job_id) as event_id, min(away) // 1000 as away_ms from x group by 1""".replace("payload_id, job_id, abs", "p.payload_id, j.job_id, abs"),
    "vector_topk": """with q as (select vec_id as query_id, cast(embedding as double[]) as a from embeddings where vec_id % 50 = 0),
 s as (select query_id, vec_id, list_cosine_similarity(a, cast(embedding as double[])) as c from q cross join embeddings where vec_id <> query_id),
 r as (select *, row_number() over (partition by query_id order by round(c, 9) desc, vec_id) as rank from s) select query_id, vec_id, round(c, 6) as similarity, cast(rank as integer) as rank from r where rank <= 10""",
    "versions": "select * from (values ('0.7', '0.6.2', 1), ('1.2', '1.2.0', 0), ('1.2.3', '1.10', 2), ('2', '10', 2), ('3.0.1', '3.0', 1), ('x', '1', null)) t(a, b, higher)",
    "gpu_errors": f"select message, regexp_matches(lower(message), '{'|'.join(GPU_ERROR_WORDS)}') and not contains(message, '(device_cpu)') as gpu from (values ('CUDA error: out of memory'), ('cublas failed'), ('cuda failed (device_cpu)'), ('file not found'), ('NCCL timeout')) t(message)",
    "stream_gaps": f"""with recursive {SEG}, {GAPS}, x as (select job_id, seg_no, s as v, s - coalesce(p, 0) as gap_ms, row_number() over (partition by job_id order by seg_no) as rn from gaps),
 {fold("x", "({r}rn = 1 or {r}v - {last} > 60000)", "v")} select job_id, seg_no, gap_ms, passes as shown from fold""",
    "conversation_chunks": """select payload_id as conversation_id, cast(i as integer) as chunk_index, started_at, source_tool, md5(substring(h, cast(i * 1800 + 1 as bigint), 2000)) as digest
 from (select payload_id, started_at, source_tool, transcript_html as h, unnest(generate_series(0, cast(greatest(0, ceil((length(transcript_html) - 2000) / 1800.0)) as bigint))) as i from payloads where length(transcript_html) > 0)""",
    "conversations_latest": "select payload_id as conversation_id, started_at, audio_duration_seconds as duration_s from payloads order by started_at desc nulls last, payload_id",
    "queue_appended": """with a as (select job_id, ordinal, transcript_file || case when lower(trim(status)) = 'finished' then '' else '.new' end as f from jobs where transcript_file is not null),
 n as (select job_id, f, row_number() over (order by ordinal) as k from a where f not in (select transcript_file from jobs where transcript_file is not null and coalesce(lower(trim(status)) not in ('error', 'canceled', 'canceling'), true)))
 select job_id, ordinal, lower(trim(status)) as state, transcript_file from jobs union all select job_id, cast((select max(ordinal) from jobs) + k as integer), 'waiting', f from n""",
    "dated_names": """select *, coalesce(said, named, timestamp '2025-01-01') as dated from (select text, name, try_strptime(nullif(regexp_extract(text, 'Date/Time: (\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2})', 1), ''), '%Y-%m-%d %H:%M') as said,
 case when regexp_matches(name, '^\\d{2}\\.\\d{2}\\.\\d{2}\\s') then try_strptime('20' || name[1:8] || ' 12:00', '%Y.%m.%d %H:%M') end as named
 from (values ('Date/Time: 2024-03-05 14:30' || chr(10) || 'x', '24.01.02 a.md'), ('no date', '24.01.02 a.md'), ('no date', 'a.md'), ('Date/Time: 2024-13-45 14:30', '23.12.31 b'), (null, '99.02.30 c'), ('', null)) v(text, name))""",
    "batch_bursts": """with x as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events where user_id is not null and ts is not null), y as (select *, sum(case when p is null or ts >= p + interval 2 hours then 1 else 0 end) over (partition by user_id order by ts) as b from x)
 select user_id, epoch_us(max(ts)) as last_us, count(*) as events from y group by user_id, b""",
}

_P3 = f"""with x as (select distinct job_id, {speaker_of_sql("label")} as speaker, start_ms as s, end_ms as e from turns where job_id is not null and start_ms is not null and end_ms is not null and end_ms > start_ms),
 y as (select *, max(e) over (partition by job_id, speaker order by s, e rows between unbounded preceding and 1 preceding) as m from x where speaker is not null),
 z as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by job_id, speaker order by s, e rows unbounded preceding) as g from y),
 p as (select job_id, speaker, g, min(s) as s, max(e) as e from z group by 1, 2, 3),
 pg as (select job_id, speaker, 'period' as kind, s as start_ms, e as end_ms from p union all
 select job_id, speaker, 'gap', e, n from (select *, lead(s) over (partition by job_id, speaker order by s) as n from p) where n is not null)"""
ORACLE["p3_found"] = f"{_P3} select * from pg"
ORACLE["p3_coverage"] = f"""{_P3} select job_id, speaker, count(*) filter (kind = 'period') as periods, cast(sum(case when kind = 'period' then end_ms - start_ms else 0 end) as bigint) as covered_ms,
 cast(sum(case when kind = 'gap' then end_ms - start_ms else 0 end) as bigint) as open_ms from pg group by 1, 2"""
