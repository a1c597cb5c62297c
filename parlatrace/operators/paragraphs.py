"""From attributed segments to paragraphs: pauses, the speaker in force, what a change of speaker does, when a time is shown, the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlatrace.functions.text import anchor_name, html_escape
from parlatrace.functions.time import ms_to_str, pause_text
from parlatrace.operators.sequence import carried, sharded, within

ALL = (Window.unboundedPreceding, 0)


def with_gaps(segments: DataFrame) -> DataFrame:
    """Segments (job_id, seg_no, start_ms, end_ms, ..) with prev_end_ms (0 before the first) and gap_ms, which is negative where they overlap."""
    rows = sharded(segments, "job_id", "seg_no")
    rows = carried(rows, "job_id", [F.max_by("end_ms", "seg_no").alias("last_end")], lambda w: [F.last("last_end").over(w).alias("carry_end")])
    return _gap_columns(rows)


def _gap_columns(rows: DataFrame) -> DataFrame:
    prev = F.coalesce(F.lag("end_ms").over(within("job_id", "seg_no")), F.col("carry_end"))
    rows = rows.withColumn("first_segment", prev.isNull()).withColumn("prev_end_ms", F.coalesce(prev, F.lit(0)).cast("bigint"))
    return rows.withColumn("gap_ms", F.col("start_ms") - F.col("prev_end_ms")).drop("carry_end")


def pauses(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """The pause before each segment that is at least as long as the job asks for: (job_id, seg_no, start_ms, end_ms, gap_ms, text).

    jobs gives pause (seconds, 0 or null for none) and pause_marker. Times are those of the recording.
    """
    option = jobs.select("job_id", F.coalesce("pause", F.lit(0)).alias("pause"), "pause_marker", F.coalesce("start_ms", F.lit(0)).alias("offset_ms"))
    rows = with_gaps(segments).join(option, "job_id").where("pause > 0 and gap_ms >= pause * 1000")
    return rows.select(
        "job_id", "seg_no", (F.col("offset_ms") + F.col("prev_end_ms")).alias("start_ms"), (F.col("offset_ms") + F.col("start_ms")).alias("end_ms"), "gap_ms",
        pause_text(F.col("gap_ms"), F.col("pause_marker"), F.col("first_segment")).alias("text"),
    )


def speaker_actions(attributed: DataFrame, jobs: DataFrame) -> DataFrame:
    """What each segment does to the document: speaker in force, action and paragraph number, with the gap before it.

    Actions: same (no change, or nobody found), ov_start (overlapping speech begins), ov_return (back to the speaker before
    it), para_close (another speaker after overlapping speech), para (another speaker). The last two start a paragraph. An
    overlapping segment counts as such where the job allows overlapping speech; its speaker is then written '//S01'.
    attributed: (job_id, seg_no, start_ms, end_ms, new_speaker, overlapping). All that a shard needs from those before it is in one row per shard.
    """
    option = jobs.select("job_id", F.coalesce("overlapping", F.lit(True)).alias("allow"))
    heard = attributed.join(option, "job_id", "left").withColumn(
        "heard", F.when(F.col("new_speaker") != "", F.concat(F.when(F.col("overlapping") & F.coalesce("allow", F.lit(True)), "//").otherwise(""), F.col("new_speaker")))
    )
    window = within("job_id", "seg_no")
    upto = window.rowsBetween(*ALL)
    rows = sharded(heard.select("job_id", "seg_no", "start_ms", "end_ms", "heard"), "job_id", "seg_no")

    # What the shard itself tells. Of its rows, only the first that hears somebody and the first that leaves overlapping speech not begun
    # behind that one depend on what was before the shard.
    rows = rows.withColumn("_prev_end", F.lag("end_ms").over(window)).withColumn("_speaker", F.last("heard", True).over(upto))
    rows = rows.withColumn("_before", F.lag("_speaker").over(window))
    overlap = F.startswith("heard", F.lit("//"))
    changed = F.col("heard").isNotNull() & (F.col("heard") != F.col("_before"))  # null where the shard doesn't tell
    rows = rows.withColumn("_changed", changed).withColumn("_entered", F.last(F.when(changed & overlap, F.col("_before")), True).over(upto))
    leaves = F.col("_changed") & ~overlap & F.startswith("_before", F.lit("//"))
    rows = rows.withColumn("_unsure", F.coalesce(leaves & F.col("_entered").isNull(), F.lit(False)))
    opens = F.coalesce(F.col("_changed") & ~overlap & (~F.startswith("_before", F.lit("//")) | (F.col("heard") != F.col("_entered"))), F.lit(False))
    rows = rows.withColumn("_opened", F.sum(opens.cast("int")).over(upto)).withColumn("_unsure_seen", F.max("_unsure").over(upto))

    shards = rows.groupBy("job_id", "shard").agg(
        # start_ms only so that both readers of the rows above want the same columns and share their shuffle
        F.max_by(F.struct("end_ms", "start_ms"), "seg_no")["end_ms"].alias("_end"),
        F.max_by("heard", F.when(F.col("heard").isNotNull(), F.col("seg_no"))).alias("_last"), F.min_by("heard", F.when(F.col("heard").isNotNull(), F.col("seg_no"))).alias("_first"),
        F.max_by("_entered", "seg_no").alias("_entered_in"), F.max(F.when(F.col("_unsure"), F.col("heard"))).alias("_leaving"), F.max("_opened").alias("_opens_in"),
    )
    ahead = Window.partitionBy("job_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("carry_end", F.last("_end").over(ahead)).withColumn("carry_speaker", F.coalesce(F.last("_last", True).over(ahead), F.lit("")))
    first_overlap, first_changed = F.startswith("_first", F.lit("//")), F.coalesce(F.col("_first") != F.col("carry_speaker"), F.lit(False))
    shards = shards.withColumn("_entered_out", F.coalesce("_entered_in", F.when(first_overlap & first_changed, F.col("carry_speaker"))))
    shards = shards.withColumn("carry_entered", F.coalesce(F.last("_entered_out", True).over(ahead), F.lit("")))
    shards = shards.withColumn("_first_opens", first_changed & ~first_overlap & (~F.startswith("carry_speaker", F.lit("//")) | (F.col("_first") != F.col("carry_entered"))))
    shards = shards.withColumn("first_entered", F.when(first_overlap & first_changed, F.col("carry_speaker")).otherwise(F.col("carry_entered")))
    shards = shards.withColumn("_first_opens", F.coalesce("_first_opens", F.lit(False))).withColumn("_leaving_opens", F.coalesce(F.col("_leaving") != F.col("first_entered"), F.lit(False)))
    total = F.col("_opens_in") + F.col("_first_opens").cast("int") + F.col("_leaving_opens").cast("int")
    shards = shards.withColumn("carry_para", F.coalesce(F.sum(total).over(ahead), F.lit(0)))
    rows = rows.join(shards.select("job_id", "shard", "carry_end", "carry_speaker", "carry_entered", "first_entered", "carry_para", "_first_opens", "_leaving_opens"), ["job_id", "shard"], "left")

    prev = F.coalesce("_prev_end", "carry_end")
    rows = rows.withColumn("first_segment", prev.isNull()).withColumn("prev_end_ms", F.coalesce(prev, F.lit(0)).cast("bigint"))
    rows = rows.withColumn("gap_ms", F.col("start_ms") - F.col("prev_end_ms")).withColumn("speaker", F.coalesce("_speaker", "carry_speaker")).withColumn("before", F.coalesce("_before", "carry_speaker"))
    first = F.col("heard").isNotNull() & F.col("_before").isNull()
    entered = F.coalesce("_entered", F.when(first, F.col("carry_entered")).otherwise(F.col("first_entered")))
    was = F.startswith("before", F.lit("//"))
    action = (
        F.when(F.col("heard").isNull() | (F.col("heard") == F.col("before")), "same").when(overlap, "ov_start").when(was & (F.col("heard") == entered), "ov_return").when(was, "para_close").otherwise("para")
    )
    para_no = F.col("carry_para") + F.col("_opened") + F.when(F.col("_speaker").isNotNull() & F.col("_first_opens"), 1).otherwise(0) + F.when(F.col("_unsure_seen") & F.col("_leaving_opens"), 1).otherwise(0)
    return rows.select("job_id", "seg_no", "shard", "start_ms", "end_ms", "gap_ms", "prev_end_ms", "first_segment", "speaker", "before", action.alias("action"), para_no.cast("bigint").alias("para_no"))


def document_rows(actions: DataFrame, jobs: DataFrame, shown: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of the written document, pauses and segments in order, with plain and HTML text and anchor name.

    shown: (job_id, seg_no) of the segments that show their time; texts: (job_id, seg_no, text). The mark that closes overlapping speech goes to the row
    before, which is the pause if there is one. out_no orders the rows; cue_no numbers all anchors from 1.
    """
    option = jobs.select(
        "job_id", F.coalesce("start_ms", F.lit(0)).alias("offset_ms"), F.coalesce("pause", F.lit(0)).alias("pause"), "pause_marker",
        (F.coalesce("speaker_detection", F.lit("auto")) != "none").alias("detect"), F.lower(F.col("transcript_file")).endswith(".vtt").alias("vtt"),
    )
    rows = actions.join(option, "job_id").join(texts.select("job_id", "seg_no", "text"), ["job_id", "seg_no"]).join(shown.select("job_id", "seg_no", F.lit(True).alias("shows")), ["job_id", "seg_no"], "left")
    stamp = F.when(F.col("shows"), F.concat(F.lit("["), F.coalesce(ms_to_str(F.col("offset_ms") + F.col("start_ms")), F.lit("")), F.lit("]")))
    text = F.coalesce("text", F.lit(""))
    para = F.col("action").isin("para", "para_close")
    decorated = (
        F.when(F.col("action") == "ov_start", F.concat(F.lit(" "), F.col("speaker"), F.lit(":"), text))
        .when(F.col("action") == "ov_return", F.concat(F.lit("//"), text))
        .when(para & F.col("shows"), F.concat(F.col("speaker"), F.lit(": "), stamp, text))
        .when(para & F.col("vtt"), F.ltrim(text))
        .when(para, F.concat(F.col("speaker"), F.lit(":"), text))
        .when(F.col("shows"), F.concat(F.lit(" "), stamp, text))
        .otherwise(text)
    )
    decorated = F.when(~F.col("detect") & F.col("first_segment"), F.ltrim(decorated)).otherwise(decorated)
    pause = F.struct(
        (F.col("seg_no") * 2).cast("bigint").alias("out_no"), F.lit("pause").alias("kind"), (F.col("offset_ms") + F.col("prev_end_ms")).alias("start_ms"), (F.col("offset_ms") + F.col("start_ms")).alias("end_ms"),
        F.col("before").alias("speaker"), pause_text(F.col("gap_ms"), F.col("pause_marker"), F.col("first_segment")).alias("text"), F.lit("same").alias("action"),
        F.when(para, F.col("para_no") - 1).otherwise(F.col("para_no")).alias("para_no"),
    )
    segment = F.struct(
        (F.col("seg_no") * 2 + 1).cast("bigint").alias("out_no"), F.lit("segment").alias("kind"), (F.col("offset_ms") + F.col("start_ms")).alias("start_ms"), (F.col("offset_ms") + F.col("end_ms")).alias("end_ms"),
        F.col("speaker").alias("speaker"), decorated.alias("text"), F.col("action").alias("action"), F.col("para_no").alias("para_no"),
    )
    shows_pause = (F.col("pause") > 0) & (F.col("gap_ms") >= F.col("pause") * 1000)
    out = rows.select("job_id", "shard", F.explode(F.when(shows_pause, F.array(pause, segment)).otherwise(F.array(segment))).alias("r")).select("job_id", "shard", "r.*")
    window = within("job_id", "out_no")
    # the first row of a shard is what the last row of the shard before looks at
    following = Window.partitionBy("job_id").orderBy("shard")
    heads = out.groupBy("job_id", "shard").agg(F.min_by("action", "out_no").alias("head"), F.count("*").alias("rows"))
    heads = heads.select("job_id", "shard", F.lead("head").over(following).alias("next_head"), F.coalesce(F.sum("rows").over(following.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"))
    out = out.join(heads, ["job_id", "shard"])
    closes = F.coalesce(F.lead("action").over(window), F.col("next_head")) == "para_close"
    text = F.when(closes, F.concat("text", F.lit("//"))).otherwise(F.col("text"))
    return out.withColumn("text", text).select(
        "job_id", "out_no", (F.col("rows_before") + F.row_number().over(window)).cast("bigint").alias("cue_no"), "kind", "start_ms", "end_ms", "speaker", "text", "action", "para_no",
        anchor_name(F.col("start_ms"), F.col("end_ms"), F.col("speaker")).alias("anchor"), html_escape(F.col("text")).alias("html"),
    )


def paragraph_texts(document: DataFrame) -> DataFrame:
    """One row per paragraph part: its rows joined in order. A paragraph without end (one speaker for days) is given in parts of 2048 rows."""
    part = F.floor(F.col("out_no") / F.lit(4096))
    return (
        document.groupBy("job_id", "para_no", part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("out_no", "text"))).alias("rows"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
        .select("job_id", "para_no", "part", "start_ms", "end_ms", F.size("rows").cast("bigint").alias("n_rows"), F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("text"))
    )
