"""File names that don't collide."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def unique_names(paths: Column, existing: Column, tries: int = 999) -> Column:
    """For each path of an array, in order, a name not taken by existing files or by earlier outputs.

    A taken name gets _1, _2, .. on its own stem. More than the given number of tries ends the query. Null arrays give null,
    empty ones stay empty. A fold over an array per row, as a name depends on all names before it; in Python, since a fold of
    the JVM has no set to look names up in. Names stay taken, so a path that comes again goes on behind the last number it
    tried: time is linear in the names.
    """

    def in_order(paths, existing):
        taken, tried, given = set(existing), {}, []
        for path in paths:
            if path is None:
                raise ValueError("no free name for null")
            name = path
            if name in taken:
                folder, slash, base = path.rpartition("/")
                stem, dot, suffix = base.rpartition(".")
                if not stem:  # no dot, or a leading one only
                    stem, dot, suffix = base, "", ""
                i = tried.get(path, 0)
                while name in taken:
                    i += 1
                    if i > tries:
                        raise ValueError(f"no free name for {path}")
                    name = f"{folder}{slash}{stem}_{i}{dot}{suffix}"
                tried[path] = i
            taken.add(name)
            given.append(name)
        return given

    @F.pandas_udf(ArrayType(StringType()))
    def given(paths: pd.Series, existing: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or e is None else in_order(p, e) for p, e in zip(paths, existing, strict=True)], dtype=object)

    return given(paths, existing)
