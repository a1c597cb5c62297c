"""Python over sorted partitions: whole groups at a time, whatever the batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def starts_of(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Positions at which a group begins in a frame sorted by the keys."""
    change = np.zeros(len(frame), dtype=bool)
    change[:1] = True
    for k in keys:
        v = frame[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(frame, starts of its groups) of batches sorted by the keys; a group that goes over several batches comes in one frame."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        starts = starts_of(frame, keys)
        if kept and (kept[-1][keys].iloc[-1].to_numpy() != frame[keys].iloc[0].to_numpy()).any():
            whole = pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
            yield whole, starts_of(whole, keys)
            kept = []
        if starts[-1]:
            head = frame.iloc[: starts[-1]]
            whole = pd.concat([*kept, head], ignore_index=True) if kept else head.reset_index(drop=True)
            yield whole, starts_of(whole, keys)
            kept = [frame.iloc[starts[-1] :].reset_index(drop=True)]
        else:
            kept.append(frame)
    if kept:
        whole = pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0].reset_index(drop=True)
        yield whole, starts_of(whole, keys)
