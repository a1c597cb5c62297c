"""Matching records by nearest time, with a learned index per entity and stretch of time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlatrace.operators.groups import whole_groups

SHARD = 600_000
ERROR = 4


def pieces(keys: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """(first positions, slopes) of straight lines that tell each strictly rising key's position to within `error`.

    One pass: a line starts at a key and takes in keys as long as some slope keeps all of them within the error.
    """
    firsts, slopes = [], []
    n, i = len(keys), 0
    values = keys.tolist()
    while i < n:
        x0, low, high, j = values[i], 0.0, float("inf"), i + 1
        while j < n:
            dx, dy = values[j] - x0, j - i
            a, b = (dy - error) / dx, (dy + error) / dx
            if a > high or b < low:
                break
            low, high = max(low, a), min(high, b)
            j += 1
        firsts.append(i)
        slopes.append((low + high) / 2 if high < float("inf") else 0.0)
        i = j
    return np.array(firsts, dtype=np.int64), np.array(slopes)


def lower_bounds(keys: np.ndarray, firsts: np.ndarray, slopes: np.ndarray, queries: np.ndarray, error: int = ERROR) -> np.ndarray:
    """For each query the number of keys below it: the line's prediction, then a search of the few keys around it."""
    if not len(keys):
        return np.zeros(len(queries), dtype=np.int64)
    piece = np.maximum(np.searchsorted(keys[firsts], queries, side="right") - 1, 0)
    at, stop = firsts[piece], np.append(firsts[1:], len(keys))[piece]
    guess = at + np.rint(slopes[piece] * (queries - keys[at])).astype(np.int64)
    low = np.clip(np.clip(guess, at, stop) - error - 1, 0, len(keys))
    found = low.copy()
    for step in range(2 * error + 3):
        p = low + step
        found += (p < len(keys)) & (keys[np.minimum(p, len(keys) - 1)] < queries)
    # the bound above is exact but for rounding of the slope; a position that isn't right is searched for in the whole array
    wrong = ((found > 0) & (keys[np.maximum(found - 1, 0)] >= queries)) | ((found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] < queries))
    if wrong.any():
        found[wrong] = np.searchsorted(keys, queries[wrong], side="left")
    return found


def _matcher(entity: list[str], tolerance: int, shard: int):
    groups = [*entity, "_shard"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(frames, groups):
            sizes = np.diff(np.append(starts, len(frame)))
            group = np.repeat(np.arange(len(starts)), sizes)
            time, no, side = frame["_t"].to_numpy(), frame["_no"].to_numpy(), frame["_side"].to_numpy()
            # one rising key for all groups of the frame: times are relative to the shard, groups lie further apart than a shard and its overlaps
            wide = shard + 4 * tolerance + 4
            key = group * wide + (time - frame["_shard"].to_numpy() * shard) + 2 * tolerance + 1
            same = np.zeros(len(frame), dtype=bool)
            same[1:] = (key[1:] == key[:-1]) & (side[1:] == side[:-1])
            table = np.flatnonzero((side == 0) & ~same)  # of equal times the lowest number comes first
            again = same.copy()
            again[1:] &= no[1:] == no[:-1]
            asked = np.flatnonzero((side == 1) & ~again)
            if not len(table) or not len(asked):
                continue
            keys, ids = key[table], no[table]
            edges = np.flatnonzero(np.append(True, group[table][1:] != group[table][:-1]))
            firsts, slopes = [], []
            for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
                f, s = pieces(keys[a:b])
                firsts.append(f + a)
                slopes.append(s)
            x = key[asked]
            right = lower_bounds(keys, np.concatenate(firsts), np.concatenate(slopes), x)
            far = np.int64(tolerance + 1)
            left = right - 1
            away_left = np.where(left >= 0, x - keys[np.maximum(left, 0)], far)
            away_right = np.where(right < len(keys), keys[np.minimum(right, len(keys) - 1)] - x, far)
            id_left, id_right = ids[np.maximum(left, 0)], ids[np.minimum(right, len(keys) - 1)]
            take_left = (away_left < away_right) | ((away_left == away_right) & (id_left <= id_right))
            away, match = np.where(take_left, away_left, away_right), np.where(take_left, id_left, id_right)
            good = away <= tolerance
            rows = asked[good]
            out = {c: frame[c].to_numpy()[rows] for c in entity}
            yield pd.DataFrame(out | {"query_no": no[rows], "match_no": match[good], "away": away[good]})

    return run


def nearest_in_time(queries: DataFrame, table: DataFrame, entity: list[str], tolerance: int, shard: int = SHARD) -> DataFrame:
    """Each query with the record of the same entity that is nearest in time, at most `tolerance` away: (entity.., query_no, match_no, away).

    Both sides have the entity columns (whole numbers), `t` (whole units of time) and `no` (whole number). Ties go to the lower
    number. Queries that come twice give one row; queries without a match give none; rows with a null in any of these columns
    take no part; other columns are ignored.

    Time is cut into shards, which is what is shuffled by, so a large entity spreads. A record within the tolerance of a shard's
    edge goes to both shards. Within a shard, straight lines learned from the sorted times predict where a query's time
    would stand, to within a few positions, and a search of those gives the exact neighbours.
    """
    assert shard > 2 * tolerance >= 0
    need = " and ".join(f"{c} is not null" for c in [*entity, "t", "no"])
    cut = lambda c: F.floor(c / F.lit(shard)).cast("bigint")
    t = F.col("t").cast("bigint")
    asked = queries.where(need).select(*entity, cut(t).alias("_shard"), F.lit(1).cast("byte").alias("_side"), t.alias("_t"), F.col("no").cast("bigint").alias("_no"))
    low, high = cut(t - tolerance), cut(t + tolerance)
    known = table.where(need).select(
        *entity, F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high))).alias("_shard"), F.lit(0).cast("byte").alias("_side"), t.alias("_t"), F.col("no").cast("bigint").alias("_no")
    )
    rows = asked.unionByName(known).repartition(*entity, "_shard").sortWithinPartitions(*entity, "_shard", "_side", "_t", "_no")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in entity)
    return rows.mapInPandas(_matcher(entity, tolerance, shard), f"{schema}, query_no bigint, match_no bigint, away bigint")
