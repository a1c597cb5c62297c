"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_AN_OCTAVE = 4
SPREAD = 32
ROWS_A_SPREAD = 200_000
MOST_TARGETS = 100_000


def source_name(source: Column) -> Column:
    """One spelling: trimmed, lower case, hyphens for underscores and spaces; empty counts as null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s_]+", "-"), F.lit(""))


def plan_mix(items: DataFrame, targets: DataFrame, size: str = "n_tokens", most: int | None = None) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, documents, tokens, rate): how many copies of each document a mix expects of each source.

    items: (source, size); targets: (mix_name, source, target_share, max_repeats). The mix is as large as it can be while every
    source that has documents meets its share with at most max_repeats copies of a document, or of `most` tokens if that is less; the shares of sources without
    documents go to the others in proportion. A source of share 0 has rate 0. Sources that no mix asks for take no part.
    """
    have = items.where(F.col(size) > 0).groupBy("source").agg(F.count("*").alias("documents"), F.sum(size).alias("tokens"))
    want = targets.where("mix_name is not null and source is not null").groupBy("mix_name", source_name(F.col("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    rows = want.join(have, "source", "left")
    mix = Window.partitionBy("mix_name")  # a row per source: settings, not data
    usable = F.col("tokens").isNotNull() & (F.col("target_share") > 0)
    rows = rows.withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(mix)))
    rows = rows.withColumn("total", F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(mix))
    if most is not None:
        rows = rows.withColumn("total", F.least("total", F.lit(most)))
    rate = F.when(usable, F.least(F.col("share") * F.col("total") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return rows.select("mix_name", "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), rate.alias("rate"))


def offset(mix: Column, source: Column, seed: int) -> Column:
    """The random offset of a source in a mix, from 0 to below 1."""
    return F.pmod(F.xxhash64(F.lit(seed), mix, source), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)


def mixed(items: DataFrame, targets: DataFrame, seed: int = 1, size: str = "n_tokens", most: int | None = None) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, copies): the documents of each mix and how often they occur, at most max_repeats times.

    items: (doc_id, source, n_tokens), one row per document; documents without tokens, or without a source of the mix, aren't chosen. Within
    a source the documents are put in order of size, so that every size is represented evenly; the expected copies are summed up in
    that order, one random offset is added, and a document occurs once for every whole number its stretch of the sum crosses.

    The sum is taken in two steps, over bins of size and hash and then within a bin, so that no task has to hold a source, nor one of a source whose
    texts are all of one length: there are as many hashes as keep that at about ROWS_A_SPREAD rows. most: as plan_mix takes it.
    """
    plan = plan_mix(items, targets, size, most).where("rate > 0").select("mix_name", "source", "rate")
    rows = items.where((F.col(size) > 0) & F.col("source").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "source", F.col(size).alias("n_tokens"))
    spread = max(SPREAD, -(-rows.count() // ROWS_A_SPREAD))
    rows = rows.withColumn("_bin", F.floor(F.log2("n_tokens") * BINS_AN_OCTAVE).cast("int")).withColumn("_spread", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int"))
    counts = rows.groupBy("source", "_bin", "_spread").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_bin", "_spread").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("source", "_bin", "_spread").orderBy("n_tokens", "doc_id")
    ranked = rows.withColumn("_in", F.row_number().over(inside)).join(counts, ["source", "_bin", "_spread"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    # a rate is the same for all documents of a source, so the sum up to a document is its rank times the rate
    few = targets.limit(MOST_TARGETS + 1).count() <= MOST_TARGETS  # a row of the plan is a row of the targets
    chosen = ranked.join(F.broadcast(plan) if few else plan, "source").withColumn("_u", offset(F.col("mix_name"), F.col("source"), seed))
    copies = F.floor(F.col("_rank") * F.col("rate") + F.col("_u")) - F.floor((F.col("_rank") - 1) * F.col("rate") + F.col("_u"))
    return chosen.withColumn("copies", copies.cast("int")).where("copies > 0").select("mix_name", "source", "doc_id", "n_tokens", "copies")


def shares(items: DataFrame, targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, documents, tokens, rate, chosen_documents, chosen_tokens, actual_share, most_copies), one row per source of each mix."""
    got = chosen.groupBy("mix_name", "source").agg(F.count("*").alias("chosen_documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("chosen_tokens"), F.max("copies").alias("most_copies"))
    rows = plan_mix(items, targets).join(got, ["mix_name", "source"], "left").fillna(0, ["chosen_documents", "chosen_tokens", "most_copies"])
    whole = F.sum("chosen_tokens").over(Window.partitionBy("mix_name"))
    return rows.withColumn("actual_share", F.when(whole > 0, F.col("chosen_tokens") / whole).otherwise(0.0))
