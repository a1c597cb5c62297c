"""Greedy throttles: a row is let through or not depending on the last row that was.

Such a fold can't be written as a window. To keep a long recording out of one task, each shard is first turned into a function
from the state it may be entered with to the state it is left with; those functions are composed in order, by blocks of shards
and then by blocks, each time streaming through sorted rows, so that no recording is ever one row or one frame; then
every shard is run with the state it is really entered with. Recordings of one shard, which are most, are run at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlatrace.operators.groups import whole_groups
from parlatrace.operators.sequence import in_shards

_KEYS = ["job_id", "shard"]
BLOCK = 1024


def _entries(functions: DataFrame, columns: list[str], types: str, compose: Callable, apply: Callable, start: int, block: int = BLOCK) -> DataFrame:
    """(job_id, shard, entry): the state each shard is entered with. functions: (job_id, shard, columns..), one function a shard, as compose and apply take it."""
    laid = functions.withColumn("block", F.floor(F.col("shard") / F.lit(block))).repartition("job_id", "block").sortWithinPartitions("job_id", "block", "shard")

    def up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for frame in frames:
            out = []
            for job, number, *f in frame[["job_id", "block", *columns]].itertuples(index=False, name=None):
                if (job, number) == key:
                    held = compose(held, f)
                else:
                    if key is not None:
                        out.append((*key, *held))
                    key, held = (job, number), f
            yield pd.DataFrame(out, columns=["job_id", "block", *columns])
        if key is not None:
            yield pd.DataFrame([(*key, *held)], columns=["job_id", "block", *columns])

    def along(keys: list[str], at: str, first: str | None):
        """Runs through the functions of a key in order: (job_id, at, entry) of each."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, state = None, start
            for frame in frames:
                out = []
                begin = frame[first] if first else [start] * len(frame)
                for k, place, entered, *f in zip(frame[keys].itertuples(index=False, name=None), frame[at], begin, *(frame[c] for c in columns), strict=True):
                    if k != key:
                        key, state = k, entered
                    out.append((k[0], place, int(state)))
                    state = apply(f, state)
                yield pd.DataFrame(out, columns=["job_id", at, "entry"])

        return run

    blocks = laid.mapInPandas(up, f"job_id bigint, block bigint, {types}").repartition("job_id").sortWithinPartitions("job_id", "block")
    begun = blocks.mapInPandas(along(["job_id"], "block", None), "job_id bigint, block bigint, entry bigint")
    ordered = laid.join(begun, ["job_id", "block"]).repartition("job_id", "block").sortWithinPartitions("job_id", "block", "shard")
    return ordered.mapInPandas(along(["job_id", "block"], "shard", "entry"), "job_id bigint, shard bigint, entry bigint")


# ---- spaced: the state is the start of the last row shown


def _pruned(firsts: list[int], lasts: list[int], gap: int, low: int, high: int) -> tuple[list[int], list[int]]:
    """The rows that may be the first to pass when the state before is between low and high, those that lead to the same state as the next one left out."""
    f, n = [], []
    for i, (a, b) in enumerate(zip(firsts, lasts, strict=True)):
        if a > low + gap and (i + 1 == len(firsts) or lasts[i + 1] != b or a > high + gap):
            f.append(a)
            n.append(b)
        if a > high + gap:
            break
    return f, n


def _exit(f: list, state: int) -> int:
    gap, _, _, resets, firsts, lasts = f
    if not pd.isna(resets):
        return int(resets)
    i = int(np.searchsorted(np.asarray(firsts), state + gap, side="right"))
    return int(lasts[i]) if i < len(firsts) else state


def _composed(f: list, g: list) -> list:
    gap, low, high, resets, firsts, lasts = f
    if not pd.isna(g[3]):
        return [gap, low, high, g[3], [], []]
    if not pd.isna(resets):
        return [gap, low, high, _exit(g, int(resets)), [], []]
    top = firsts[-1] if len(firsts) else -(2**63)
    more = [(a, b) for a, b in zip(g[4], g[5], strict=True) if a > top]
    return [gap, low, high, None, *_pruned([*map(int, firsts), *(int(a) for a, _ in more)], [*(_exit(g, int(x)) for x in lasts), *(int(b) for _, b in more)], gap, low, high)]


_SPACED = ["interval_ms", "low", "high", "resets", "firsts", "lasts"]
_SPACED_TYPES = "interval_ms bigint, low bigint, high bigint, resets bigint, firsts array<bigint>, lasts array<bigint>"


def _exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each shard: the state after it if a forced row is in it, else the rows that may be the first to pass, with the state after the shard."""
    for frame, starts in whole_groups(frames, _KEYS):
        begin, forced, able, gap = frame["start_ms"].to_numpy(), frame["forced"].to_numpy(), frame["eligible"].to_numpy(), frame["interval_ms"].to_numpy()
        low, high = frame["low"].to_numpy(), frame["high"].to_numpy()
        out: dict[str, list] = {c: [] for c in ["job_id", "shard", *_SPACED]}
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            reset = next((i for i in range(a, b) if forced[i]), None)
            firsts, lasts, top = [], [], None
            for i in range(a, b if reset is None else a):
                if able[i] and (top is None or begin[i] > top):
                    top = begin[i]
                    firsts.append(i)
                    if top > high[a] + gap[a]:
                        break  # no state before the shard lets a later row be the first
            if firsts:
                # leave[i]: the last to pass if i passes. Later rows are found by a stack of rows with falling starts.
                leave: dict[int, int] = {}
                stack: list[int] = []
                for i in range(b - 1, a - 1, -1):
                    if not able[i]:
                        continue
                    lo, hi = 0, len(stack)
                    while lo < hi:
                        mid = (lo + hi) // 2
                        if begin[stack[mid]] > begin[i] + gap[i]:
                            lo = mid + 1
                        else:
                            hi = mid
                    leave[i] = leave[stack[lo - 1]] if lo else int(begin[i])
                    while stack and begin[stack[-1]] <= begin[i]:
                        stack.pop()
                    stack.append(i)
                lasts = [leave[i] for i in firsts]
            after = None
            if reset is not None:
                after = begin[reset]
                for i in range(reset + 1, b):
                    if forced[i] or (able[i] and begin[i] - after > gap[i]):
                        after = begin[i]
            function = (gap[a], low[a], high[a], after, *_pruned([int(begin[i]) for i in firsts], lasts, gap[a], low[a], high[a]))
            for name, value in zip(out, (frame["job_id"].iloc[a], frame["shard"].iloc[a], *function), strict=True):
                out[name].append(value)
        yield pd.DataFrame(out).astype({"resets": "Int64"})


def _passing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame, starts in whole_groups(frames, _KEYS):
        begin, forced, able, gap = (frame[c].to_numpy().tolist() for c in ("start_ms", "forced", "eligible", "interval_ms"))
        entry, keep = frame["entry"].to_numpy(), np.zeros(len(frame), dtype=bool)
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            last = int(entry[a])
            for i in range(a, b):
                if forced[i] or (able[i] and begin[i] - last > gap[i]):
                    keep[i], last = True, begin[i]
        yield frame.loc[keep, ["job_id", "seg_no", "start_ms"]]


def _several(laid: DataFrame, *summary) -> DataFrame:
    """(job_id, shard, summary..) of the recordings with more than one shard, over which summary's windows run in order."""
    along = Window.partitionBy("job_id").orderBy("shard")
    shards = laid.groupBy("job_id", "shard").agg(F.min("v").alias("_least"), F.max("v").alias("_most"))
    one = F.lag("shard").over(along).isNull() & F.lead("shard").over(along).isNull()
    return shards.select("job_id", "shard", one.alias("_one"), *(s(along.rowsBetween(Window.unboundedPreceding, -1)) for s in summary)).where("not _one").drop("_one")


def _run(laid: DataFrame, entries: DataFrame, start: int, step: Callable, schema: str) -> DataFrame:
    rows = laid.join(entries, _KEYS, "left").withColumn("entry", F.coalesce("entry", F.lit(start)))
    return rows.repartition("job_id", "shard").sortWithinPartitions("job_id", "shard", "seg_no").mapInPandas(step, schema)


def spaced(rows: DataFrame, width: int | None = None, block: int = BLOCK) -> DataFrame:
    """The rows (job_id, seg_no, start_ms) whose time is shown.

    rows: (job_id, seg_no, start_ms, forced, eligible, interval_ms). In order of seg_no, a forced row always passes; an eligible
    one passes if its start is more than interval_ms after that of the last that passed (0 before the first). All columns must
    be set.

    A shard's function lists the rows that may be the first to pass: those that start within one interval behind the latest start before the shard.
    """
    laid = in_shards(rows, "seg_no", width).select("job_id", "shard", "seg_no", F.col("start_ms").cast("bigint").alias("start_ms"), "forced", "eligible", F.col("interval_ms").cast("bigint").alias("interval_ms"))
    zero = F.lit(0).cast("bigint")
    bounds = _several(laid.withColumn("v", F.col("start_ms")), lambda w: F.least(F.coalesce(F.min("_least").over(w), zero), zero).alias("low"), lambda w: F.greatest(F.coalesce(F.max("_most").over(w), zero), zero).alias("high"))
    exits = laid.join(bounds, _KEYS).repartition("job_id", "shard").sortWithinPartitions("job_id", "shard", "seg_no").mapInPandas(_exits, f"job_id bigint, shard bigint, {_SPACED_TYPES}")
    return _run(laid, _entries(exits, _SPACED, _SPACED_TYPES, _composed, _exit, 0, block), 0, _passing, "job_id bigint, seg_no int, start_ms bigint")


# ---- stepped: the state is the last value let through

STATES = 1001


def _wide(f: list) -> np.ndarray:
    at, leaves = np.asarray(f[0]), np.asarray(f[1])
    return np.repeat(leaves, np.diff(np.append(at, STATES)))


def _narrow(state: np.ndarray) -> list:
    at = np.flatnonzero(np.append(True, state[1:] != state[:-1]))
    return [at, state[at]]


def _maps(least: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(frames, _KEYS):
            value, out = frame["value"].to_numpy(), []
            for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
                state = np.arange(STATES)
                for v in value[a:b]:
                    state[np.abs(state - v) >= least] = v
                out.append(_narrow(state))
            yield pd.DataFrame({"job_id": frame["job_id"].to_numpy()[starts], "shard": frame["shard"].to_numpy()[starts], "at": [f[0] for f in out], "leaves": [f[1] for f in out]})

    return run


def _steps(least: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(frames, _KEYS):
            value, entry, keep = frame["value"].to_numpy().tolist(), frame["entry"].to_numpy(), np.zeros(len(frame), dtype=bool)
            for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
                last = int(entry[a])
                for i in range(a, b):
                    if abs(value[i] - last) >= least:
                        keep[i], last = True, value[i]
            yield frame.loc[keep, ["job_id", "seg_no", "value"]]

    return run


def stepped(rows: DataFrame, least: int = 10, width: int | None = None, block: int = BLOCK) -> DataFrame:
    """The progress updates (job_id, seg_no, value) that differ by at least `least` from the last one let through (0 before the first).

    value is in thousandths, 0 to 1000, so that a shard's function is a table of 1,001 states, kept as the places where it changes.
    """
    laid = in_shards(rows, "seg_no", width).select("job_id", "shard", "seg_no", F.greatest(F.lit(0), F.least(F.lit(STATES - 1), F.col("value"))).cast("int").alias("value"))
    several = _several(laid.withColumn("v", F.col("value")))
    maps = laid.join(several, _KEYS).repartition("job_id", "shard").sortWithinPartitions("job_id", "shard", "seg_no").mapInPandas(_maps(least), "job_id bigint, shard bigint, at array<int>, leaves array<int>")
    entries = _entries(maps, ["at", "leaves"], "at array<int>, leaves array<int>", lambda f, g: _narrow(_wide(g)[_wide(f)]), lambda f, state: int(_wide(f)[state]), 0, block)
    return _run(laid, entries, 0, _steps(least), "job_id bigint, seg_no int, value int")
