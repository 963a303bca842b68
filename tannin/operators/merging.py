"""Equi-joins of two tables on shared key columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_tables(
    left: DataFrame,
    right: DataFrame,
    on: Iterable[str],
    how: str = "inner",
    null_safe: bool = False,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join on equal keys and keep one copy of each key.

    Other columns present on both sides get a suffix.  With ``null_safe`` a
    missing key matches a missing key; by default it matches nothing.
    """
    on = list(on)
    shared = (set(left.columns) & set(right.columns)) - set(on)

    def renamed(df: DataFrame, suffix: str, alias: str) -> DataFrame:
        return df.select(
            *(F.col(f"`{c}`").alias(c + suffix if c in shared else c)
              for c in df.columns)
        ).alias(alias)

    l, r = renamed(left, suffixes[0], "l"), renamed(right, suffixes[1], "r")

    def equal(key: str):
        a, b = F.col(f"l.`{key}`"), F.col(f"r.`{key}`")
        return a.eqNullSafe(b) if null_safe else a == b

    joined = l.join(r, reduce(and_, map(equal, on)), how)
    # only a join that keeps unmatched right rows may lack the left key; in the
    # others the bare left key preserves the partitioning for what follows
    right_only = how in ("outer", "full", "full_outer", "fullouter", "right")
    keys = [
        F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")).alias(k) if right_only
        else F.col(f"l.`{k}`")
        for k in on
    ]
    rest = [F.col(f"l.`{c}`") for c in l.columns if c not in on]
    rest += [F.col(f"r.`{c}`") for c in r.columns if c not in on]
    return joined.select(*keys, *rest)
