"""Transcripts into clean speaker turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlatrace.functions.html import html_unescape
from parlatrace.functions.labels import NUMBER_WORDS, speaker_of
from parlatrace.functions.time import seconds_to_ms
from parlatrace.operators.attribution import attribute, named_turns
from parlatrace.operators.sequence import carried, sharded, within
from parlatrace.session import cut

# The words labels begin with, in the languages of the transcripts.
LABEL_WORDS = "speaker|spkr|spk|sprecherin|sprecher|hablante|locutor|orador|locuteur|parlante|spreker|talare|taler|mówca|спикер|s"
_NUMBER = r"(?:[0-9Oo０-９]*[0-9０-９][0-9Oo０-９]*|(?:" + "|".join(reversed(NUMBER_WORDS)) + "))"
LABEL = rf"(?://\s*)?\[?(?:{LABEL_WORDS})[\s_.-]?{_NUMBER}\]?"
TIME = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"

#: What stands between blocks, and between the cells of one block.
_BLOCK = r"(?i)</?(?:p|li|tr|ul|ol|table|tbody|thead|div|pre|body|html|section|blockquote)\b[^>]*>|(?=<h[1-6]\b)|\n\s*\n"
_CELL = r"(?i)</?(?:td|th|strong|h[1-6]|dt|dd)\b[^>]*>|<br\b[^>]*>|\n"
_SEP = "\x1f"

#: Head of a block: an optional cue number, then the first time shown, a label before or behind it.
_HEAD = (
    rf"(?iU)^[\s{_SEP}]*(?:\d+[\s{_SEP}]+(?={TIME}))?(?:-\s*)?(?:({LABEL})[\s{_SEP}:>]*)?[\[(]?({TIME})[\])]?(?:\s*-->\s*{TIME})?[\s{_SEP}:]*"
    rf"(?:(?:-\s+)?(?:<v\s+)?({LABEL})(?=\s*[:>{_SEP}]|\s+-\s|\s*$)[\s{_SEP}]*(?:[:>]|-(?=\s))?)?[\s{_SEP}]*(?:-\s+)?"
)
_SPOKEN_LABEL = rf"(?iU)^\s*{LABEL}\s*[:>-]\s*"
_SHOWN_TIME = rf"\[{TIME}\]"

#: Sounds, quality remarks and pauses, in the brackets that mark them.
ANNOTATION = (
    r"(?U)\(\([^()]{0,80}\)\)|\[[^\[\]]{0,80}\]|\{[^{}]{0,80}\}|<[^<>]{0,80}>|\*[^*\n]{1,80}\*|♪[^♪]{0,80}♪|--\s[^-]{1,60}\s--"
    r"|\((?!(?:at|dot|punkt|punto)\))(?:\.+|…|\d+[.,]\d+|pause[^()]{0,40}|[\p{L}][\p{L}\s'’-]{1,60})\)|(?<![\d)+] ?)\(\d{1,4}\)(?!\s?\d)"
)
# Sounds of hesitation and of listening. The second list holds words of some languages.
SOUNDS = r"u+h+m*|u+h+m+|e+r+m+|h+m+|m+h+m+|m{2,}|m+-?h+m+|u+h+-?h+u+h+|h+u+h+|ä+h+m*|ö+h+m*|e+h+m+|e{2,}h*|e+u+h+|h+e+u+|ø+h+m*|å+h+m*|y{3,}|э+м+|э{2,}|えーと|えっと|あのー|うーん"
SOUNDS_ELSEWHERE_WORDS = r"u+m+|e+r+|a+h+|h+u+m+|e+h+"
_EDGE = r"(?<![\p{L}\p{N}'’-])", r"(?![\p{L}\p{N}'’-])"
_ALL_SOUNDS = rf"(?iU){_EDGE[0]}(?:{SOUNDS}|{SOUNDS_ELSEWHERE_WORDS}){_EDGE[1]}"
_SAFE_SOUNDS = rf"(?iU){_EDGE[0]}(?:{SOUNDS}){_EDGE[1]}(?:\.\.\.|[,…])?\s*"
_ENGLISH_SOUNDS = rf"(?iU){_EDGE[0]}(?:{SOUNDS}|{SOUNDS_ELSEWHERE_WORDS}){_EDGE[1]}(?:\.\.\.|[,…])?\s*"


def clock_ms(text: Column) -> Column:
    """ms of 'mm:ss' or 'h:mm:ss', with or without a fraction; '' gives null."""
    parts = F.transform(F.split(F.replace(text, F.lit(","), F.lit(".")), ":"), lambda p: p.try_cast("double"))
    seconds = F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p)
    return F.bround(seconds * 1000).cast("bigint")


def clean(text: Column, english: Column) -> Column:
    """Text without annotations, pause marks, hesitation and listening sounds and overlap marks; white space collapsed.

    Sounds that are words in some languages (um, er, ah, hum, eh) go only where the text is English.
    """
    bare = F.regexp_replace(F.regexp_replace(text, ANNOTATION, " "), "//", " ")
    bare = F.when(english, F.regexp_replace(bare, _ENGLISH_SOUNDS, "")).otherwise(F.regexp_replace(bare, _SAFE_SOUNDS, ""))
    return F.trim(F.regexp_replace(bare, r"(?U)[\s\x1f​]+", " "))


def _once(rows: DataFrame, key: str) -> DataFrame:
    """rows without those of transcripts that came again, told by their position; in the layout that the windows over documents need anyway."""
    order = Window.partitionBy(key).orderBy("position")
    return rows.withColumn("_same", F.lag("position").over(order)).where("_same is null or _same <> position").drop("_same")


def units(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, position, start_ms, label, text, english): the stretches of speech with their own time, in document order.

    In a document with anchors 'ts_start_end_speaker' these are the units. In others a block or cue that shows a time begins
    one, and blocks without a time go on with it; what stands before the first, title and information, is no speech.
    """
    body = F.regexp_replace(F.col(source), r"(?is)^.*?<body\b[^>]*>", "")
    english = F.coalesce(F.nullif(F.regexp_extract(F.col(source), r"\(Language [^()|]*\((\w+)\)", 1), F.lit("")) == "en", F.lit(True))
    whole = df.where(F.col(key).isNotNull() & F.col(source).isNotNull())
    # told by the source as it is stored, so that the rest is worked out once, on the side it belongs to
    anchored = F.contains(source, F.lit('name="ts_'))

    found = F.regexp_extract_all("_body", F.lit(r'(?s)<a\b[^>]*\bname="ts_[^"]*"[^>]*>.*?</a>'), 0)
    by_anchor = whole.where(anchored).select(key, body.alias("_body"), english.alias("english")).select(key, "english", F.posexplode(found).alias("position", "_a"))
    name = F.split(F.regexp_extract("_a", r'name="ts_([^"]*)"', 1), "_", 3)
    by_anchor = by_anchor.select(
        key, "position", "english", F.get(name, F.lit(0)).try_cast("bigint").alias("start_ms"), html_unescape(F.coalesce(F.get(name, F.lit(2)), F.lit(""))).alias("label"),
        html_unescape(F.regexp_replace(F.regexp_replace("_a", r"(?i)<br\b[^>]*>", " "), r"<[^>]*>", "")).alias("_t"),
    )
    spoken = F.regexp_replace(F.regexp_replace("_t", _SHOWN_TIME, " "), _SPOKEN_LABEL, "")
    by_anchor = _once(by_anchor.select(key, "position", "start_ms", "label", spoken.alias("text"), "english"), key)

    blocks = whole.where(~anchored).select(key, body.alias("_body"), english.alias("english")).select(key, "english", F.posexplode(F.split("_body", _BLOCK)).alias("position", "_b"))
    flat = html_unescape(F.regexp_replace(F.regexp_replace("_b", _CELL, _SEP), r"<[^>]*>", ""))
    blocks = blocks.select(key, "position", "english", flat.alias("_t")).where(F.col("_t").rlike(rf"[^\s{_SEP}]"))
    timed = F.regexp_extract("_t", _HEAD, 2)
    label = F.coalesce(F.nullif(F.regexp_extract("_t", _HEAD, 1), F.lit("")), F.regexp_extract("_t", _HEAD, 3))
    blocks = blocks.select(key, "position", "english", clock_ms(F.nullif(timed, F.lit(""))).alias("start_ms"), label.alias("label"), F.regexp_replace("_t", _HEAD, "").alias("text"))
    order = Window.partitionBy(key).orderBy("position")
    blocks = _once(blocks, key).withColumn("_u", F.count("start_ms").over(order)).where("_u > 0")
    by_block = blocks.groupBy(key, "_u").agg(
        F.min("position").alias("position"), F.first("start_ms", True).alias("start_ms"), F.min_by("label", "position").alias("label"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("text"), F.first("english").alias("english"),
    )
    return by_anchor.unionByName(by_block.drop("_u"))


def speaker_turns(df: DataFrame, key: str = "payload_id", source: str = "transcript_html") -> DataFrame:
    """(key, turn_no, start_ms, speaker, units, text): the clean turns of each transcript, in order of time.

    Fields are taken out of the units by SQL expressions; a unit without a label takes on the speaker of the one before it in the
    document (last value over a window); units without a word are left out; the others are ordered by time, ties in document
    order, and runs of one speaker (gaps and islands) are joined. A unit that comes twice at one time is written once. A transcript that names no speaker gives no rows, nor do units before the
    first label, nor units without a time. Null keys and texts give no rows. A key that comes twice must be the same
    transcript: its rows are taken once. Other columns are ignored.
    """
    rows = units(df, key, source)
    document = Window.partitionBy(key).orderBy("position")
    rows = rows.withColumn("speaker", F.last(speaker_of(F.col("label")), True).over(document))
    rows = _with_words(rows)
    time = Window.partitionBy(key).orderBy("start_ms", "position")
    rows = rows.withColumn("_new", F.coalesce((F.lag("speaker").over(time) != F.col("speaker")).cast("int"), F.lit(1)))
    rows = rows.withColumn("turn_no", F.sum("_new").over(time).cast("int"))
    return _joined(rows, key)


def _with_words(rows: DataFrame) -> DataFrame:
    """The units with a speaker, a time and at least one word that is no sound or remark."""
    said = F.regexp_replace(F.regexp_replace("text", ANNOTATION, " "), _ALL_SOUNDS, " ")
    return rows.where(F.col("speaker").isNotNull() & F.col("start_ms").isNotNull() & said.rlike(r"(?U)[\p{L}\p{N}]"))


def _joined(rows: DataFrame, key: str) -> DataFrame:
    """One row per turn of numbered units, with their clean text in order of time."""
    return rows.groupBy(key, "turn_no").agg(
        F.min("start_ms").alias("start_ms"), F.first("speaker").alias("speaker"), F.count("*").alias("units"),
        F.array_sort(F.collect_list(F.struct("start_ms", "position", clean(F.col("text"), F.col("english")).alias("t")))).alias("_said"),
    ).select(
        key, "turn_no", "start_ms", "speaker", "units",
        F.array_join(F.transform(F.array_distinct(F.transform("_said", lambda x: F.struct(x["start_ms"], x["t"].alias("t")))), lambda x: x["t"]), " ").alias("text"),
    )


SHARD_MS = 3_600_000


def segment_turns(segments: DataFrame, turns: DataFrame, languages: DataFrame, key: str = "job_id", width: int | None = None, width_ms: int = SHARD_MS) -> DataFrame:
    """(key, turn_no, start_ms, speaker, units, text): the clean turns of each recording, of its segments and of the turns they are attributed to.

    As speaker_turns, a segment being a unit and the best overlapping turn whose label names a speaker its label: a segment without one
    has the speaker of the segment before it by number. Segments without a start have no time; those without an end, or of no length, overlap nothing, so
    they take on a speaker. languages: (key, language_code), which tells whose text is English; unknown counts as English. Rows that come again are taken
    once. A long recording is cut by number, then by time: windows run within shards of `width` segments and of `width_ms`, and one row per shard
    carries the last speaker and the number of turns on.
    """
    timed = segments.dropDuplicates([key, "seg_no"]).select(key, "seg_no", seconds_to_ms(F.col("start_s")).alias("start_ms"), seconds_to_ms(F.coalesce("end_s", "start_s")).alias("end_ms"), "text")
    timed = timed.where(F.col(key).isNotNull() & F.col("seg_no").isNotNull() & F.col("start_ms").isNotNull())
    heard = attribute(timed, named_turns(turns.dropDuplicates([key, "turn_no"]))).select(key, "seg_no", "start_ms", "text", F.nullif("new_speaker", F.lit("")).alias("heard"))
    rows = sharded(cut(heard, "heard"), key, "seg_no", width)  # rows and their summaries read it, as they do the units below
    rows = carried(rows, key, [F.max_by("heard", F.when(F.col("heard").isNotNull(), F.col("seg_no"))).alias("_last")], lambda w: [F.last("_last", True).over(w).alias("_carry")])
    rows = rows.withColumn("speaker", F.coalesce(F.last("heard", True).over(within(key, "seg_no")), "_carry")).drop("shard", "_carry", "heard")

    rows = sharded(cut(_with_words(rows.withColumnRenamed("seg_no", "position")), "units"), key, "start_ms", width_ms)
    time = Window.partitionBy(key, "shard").orderBy("start_ms", "position")
    rows = rows.withColumn("_new", F.coalesce((F.lag("speaker").over(time) != F.col("speaker")).cast("int"), F.lit(0))).withColumn("_in", F.sum("_new").over(time))
    place, along = F.struct("start_ms", "position"), Window.partitionBy(key).orderBy("shard")
    shards = rows.groupBy(key, "shard").agg(F.min_by("speaker", place).alias("_first"), F.max_by("speaker", place).alias("_last"), F.max("_in").alias("_changes"))
    begins = F.coalesce((F.lag("_last").over(along) != F.col("_first")).cast("int"), F.lit(1))  # else its first turn goes on from the shard before
    shards = shards.withColumn("_more", begins + F.coalesce(F.lag("_changes").over(along), F.lit(0))).select(key, "shard", F.sum("_more").over(along).alias("_before"))
    rows = rows.join(shards, [key, "shard"]).withColumn("turn_no", (F.col("_before") + F.col("_in")).cast("int"))
    english = languages.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col("language_code") == "en").alias("english"))
    return _joined(rows.join(english, key, "left").withColumn("english", F.coalesce("english", F.lit(True))), key)
