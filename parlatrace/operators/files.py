"""Lists of files: what is new, what is waiting, which of two of a name counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last suffix with its dot, '' without one."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def recordings(files: DataFrame) -> DataFrame:
    """Rows (path, ..) whose suffix is .wav in any case; with a column length, only those that aren't empty."""
    rows = files.where(F.lower(suffix(F.col("path"))) == ".wav")
    return rows.where("length > 0") if "length" in files.columns else rows


def untranscribed(audio: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Audio files (path) without a transcript (path) of the same stem ending in .html."""
    done = transcripts.where(F.lower(suffix(F.col("path"))) == ".html").select(stem(F.col("path")).alias("_stem"))
    return audio.withColumn("_stem", stem(F.col("path"))).join(done, "_stem", "left_anti").drop("_stem")


def notes(files: DataFrame) -> DataFrame:
    """Markdown files and files without a suffix, each once, by path."""
    md = files.where(suffix(F.col("path")) == ".md")
    bare = files.where(suffix(F.col("path")) == "")
    return md.union(bare).dropDuplicates(["path"]).orderBy("path")


def first_of_name(listings: list[DataFrame]) -> DataFrame:
    """(name, path) of several folders in order of priority: the first of a name counts, with the number of those it hides."""
    rows = None
    for i, df in enumerate(listings):
        part = df.select("name", "path", F.lit(i).alias("priority"))
        rows = part if rows is None else rows.unionByName(part)
    w = Window.partitionBy("name")
    return rows.withColumn("rank", F.row_number().over(w.orderBy("priority", "path"))).withColumn("hidden", F.count("*").over(w) - 1).where("rank = 1").select("name", "path", "priority", "hidden")


def first_lines(df: DataFrame, order: str, n: int, column: str) -> DataFrame:
    """The first n values of a column and, if there are more, one line that tells how many: a short display."""
    shown = df.orderBy(order).limit(n).select(F.col(order).cast("string").alias("position"), F.col(column).cast("string").alias("line"))
    more = df.agg(F.count("*").alias("n")).where(F.col("n") > n).select(F.lit("~").alias("position"), F.format_string("and %d more", F.col("n") - n).alias("line"))
    return shown.unionByName(more)


def outcome_counts(df: DataFrame, ok: Column) -> DataFrame:
    """Successes and failures; null counts as a failure."""
    return df.agg(F.count_if(ok).alias("succeeded"), (F.count("*") - F.count_if(ok)).alias("failed"))
