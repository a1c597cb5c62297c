"""Ordered computations over one recording, without putting the recording into one task.

A recording may hold a third of all rows, so its rows are cut into shards by their order number. A window runs within a shard;
what it needs from before comes from a summary of one row per shard, over which a second, small window runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SHARD_ROWS = 4096


def in_shards(df: DataFrame, order: str, width: int | None = None) -> DataFrame:
    """df with a column shard."""
    return df.withColumn("shard", F.floor(F.col(order) / F.lit(width or SHARD_ROWS)))


def sharded(df: DataFrame, key: str, order: str, width: int | None = None) -> DataFrame:
    """df with a column shard, laid out by (key, shard). Every later step reads this one shuffle."""
    return in_shards(df, order, width).repartition(key, "shard")


def within(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key, "shard").orderBy(order)


def carried(df: DataFrame, key: str, summary: list[Column], before: Callable[[WindowSpec], list[Column]]) -> DataFrame:
    """df with columns taken from the shards before its own. summary makes one row of a shard; before turns the window over the earlier ones into columns."""
    ahead = Window.partitionBy(key).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = df.groupBy(key, "shard").agg(*summary)
    # a left join: an inner one would filter one of its sides by the shard, and the two readers of df would no longer share its shuffle
    return df.join(shards.select(key, "shard", *before(ahead)), [key, "shard"], "left")
