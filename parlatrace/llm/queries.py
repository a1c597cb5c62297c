"""Queries of these operators over whole tables, and SQL of the same meaning where there is such SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlatrace import tables as t
from parlatrace.functions.time import seconds_to_ms
from parlatrace.llm import lang_id, mixing, packing, pii
from parlatrace.llm.nearest import nearest_in_time
from parlatrace.llm.speaker_turns import segment_turns, speaker_turns
from parlatrace.llm.split import Limit, limits_of, split_texts
from parlatrace.llm.tokens import text_class, token_count
from parlatrace.operators.lookups import language_codes
from parlatrace.plans.oracle import SPACE, unescape
from parlatrace.session import cut, spread

TOLERANCE_MS = 500
FOUND_CHARS = 2000


def _bounds(rows, no: str, start: Column, end: Column):
    return rows.select("job_id", F.col(no).alias("no"), F.explode(F.array(F.struct(F.lit(0).alias("edge"), start.alias("t")), F.struct(F.lit(1).alias("edge"), end.alias("t")))).alias("b")).select("job_id", "b.edge", "no", "b.t")


def _p5(s, d):
    segments = _bounds(t.table(s, d, "segments"), "seg_no", seconds_to_ms(F.col("start_s")), seconds_to_ms(F.col("end_s")))
    turns = _bounds(t.table(s, d, "turns"), "turn_no", F.col("start_ms"), F.col("end_ms"))
    rows = nearest_in_time(segments, turns, ["job_id", "edge"], TOLERANCE_MS)
    return rows.withColumn("edge", F.when(F.col("edge") == 0, "start").otherwise("end"))


def p5_found(s, d):
    return _p5(s, d).select("job_id", "edge", F.col("query_no").cast("int").alias("seg_no"), F.col("match_no").cast("int").alias("turn_no"))


def p1_turns(s, d):
    """The turns with their text."""
    return speaker_turns(t.table(s, d, "payloads"))


def p1_found(s, d):
    return speaker_turns(t.table(s, d, "payloads")).select("payload_id", "start_ms", "speaker").distinct()


def p1_segment_turns(s, d):
    """The turns of the segments, as attributed to the turns, with their text."""
    languages = language_codes(t.table(s, d, "jobs"), t.table(s, d, "languages"))
    return segment_turns(t.table(s, d, "segments"), t.table(s, d, "turns"), languages)


def _p2(s, d):
    return spread(t.table(s, d, "payloads").select("payload_id", "transcript_html"))


def p2_mentions(s, d):
    """Every mention with its surrogate."""
    return pii.with_surrogates(pii.personal_data(_p2(s, d), "payload_id", "transcript_html"), "payload_id", pii.key_of(s))


def p2_found(s, d):
    rows = p2_mentions(s, d).where("surrogate is not null and surrogate <> ''")
    return rows.select("payload_id", "kind", "start_pos")


def p2_redacted(s, d):
    """The transcripts with placeholders."""
    return pii.redacted(_p2(s, d), "payload_id", "transcript_html", pii.placeholders_of(t.table(s, d, "pii_kinds")))


def p2_pseudonymised(s, d):
    """The transcripts with surrogates."""
    return pii.pseudonymised(_p2(s, d), "payload_id", "transcript_html", pii.key_of(s))


def p4_pieces(s, d):
    """All pieces of all transcripts, for each limit in characters."""
    return split_texts(spread(t.table(s, d, "payloads").select("payload_id", "transcript_html")), ["payload_id"], F.col("transcript_html"), limits_of(t.table(s, d, "size_limits")))


def p4_found(s, d):
    # the problem's pieces are those of FOUND_CHARS; an overlap only makes them shorter, and every run that is longer is parted by some cut
    limits = [x for x in limits_of(t.table(s, d, "size_limits")) if x.capacity == FOUND_CHARS] or [Limit(0, FOUND_CHARS, 0)]
    pieces = split_texts(spread(t.table(s, d, "payloads").select("payload_id", "transcript_html")), ["payload_id"], F.col("transcript_html"), limits[:1])
    cuts = pieces.where("piece_no > 0").groupBy("payload_id").agg((F.max("parted") > FOUND_CHARS).alias("unbroken"))
    return cuts.select("payload_id", F.explode(F.when(F.col("unbroken"), F.array(F.lit("oversized"), F.lit("unbroken"))).otherwise(F.array(F.lit("oversized")))).alias("kind"))


def _sized(s, d, *more: Column):
    """Documents with their size, once per query: counting the tokens is the dear part and the sizes are read more than once."""
    rows = spread(t.table(s, d, "documents")).select("doc_id", mixing.source_name(F.col("source")).alias("source"), token_count(F.col("text")).alias("n_tokens"), *more)
    return cut(rows, "sized")


def p6_containers(s, d):
    return packing.fill(_sized(s, d, text_class(F.col("text")).alias("cluster")), packing.containers_of(t.table(s, d, "size_limits")))


def p6_fill(s, d):
    """How full the containers of each capacity are."""
    return packing.fill_report(p6_containers(s, d))


def p7_selection(s, d):
    return mixing.mixed(_sized(s, d), t.table(s, d, "source_targets"))


def p7_shares(s, d):
    """Target and actual share of each source of each mix."""
    sized, targets = _sized(s, d), t.table(s, d, "source_targets")
    return mixing.shares(sized, targets, mixing.mixed(sized, targets))


def _p8(s, d):
    documents = spread(t.table(s, d, "documents").select("doc_id", "text", "lang"))
    names = lang_id.language_names(t.table(s, d, "languages"))
    model = lang_id.fit_model(documents, t.table(s, d, "lang_samples"), names)
    return lang_id.language_stretches(documents, model, carry={"label": lang_id.label_code(F.col("lang"), names)})


def p8_stretches(s, d):
    """Every stretch of every document with its confidence."""
    return _p8(s, d)


def p8_found(s, d):
    rows = _p8(s, d).where((F.col("n_stretches") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang")))
    return rows.where("lang is not null").select("doc_id", "start_pos", "lang").distinct()


QUERIES = {f.__name__: f for f in (p1_turns, p1_found, p1_segment_turns, p2_mentions, p2_found, p2_redacted, p2_pseudonymised, p4_pieces, p4_found, p5_found, p6_containers, p6_fill, p7_selection, p7_shares, p8_stretches, p8_found)}

PLAIN = f"trim(regexp_replace({unescape("regexp_replace(transcript_html, '<[^>]+>', '', 'g')")}, '{SPACE}+', ' ', 'g'))"

ORACLE = {
    "p4_found": f"""with x as (select payload_id, {PLAIN} as t from payloads) select payload_id, 'oversized' as kind from x where length(t) > 2000
 union all select payload_id, 'unbroken' from x where regexp_matches(t, '[^{SPACE[1:-1]}.!?。！？…]{{1000}}[^{SPACE[1:-1]}.!?。！？…]{{1000}}[^{SPACE[1:-1]}.!?。！？…]')""",
    "p5_found": """with s as (select distinct job_id, seg_no, unnest(['start', 'end']) as edge, unnest([cast(round_even(start_s * 1000.0, 0) as bigint), cast(round_even(end_s * 1000.0, 0) as bigint)]) as t from segments),
 u as (select distinct job_id, turn_no, unnest(['start', 'end']) as edge, unnest([start_ms, end_ms]) as v from turns)
 select s.job_id, s.edge, seg_no, first(turn_no order by abs(v - t), turn_no) as turn_no from s join u on s.job_id = u.job_id and s.edge = u.edge and v between t - 500 and t + 500 group by s.job_id, s.edge, seg_no""",
}
