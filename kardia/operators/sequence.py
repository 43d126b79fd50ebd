"""G1 — consecutive pairs (``lag``) over time-ordered rows, skew-safe (see :mod:`kardia.operators.prefix`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kardia.operators.prefix import PART, PLACE, in_ranges, with_previous_row


def with_previous(df: DataFrame, key_cols: list[str], time_col: str, tie_cols: list[str],
                  value_cols: list[str], prev_col: str = "prev") -> DataFrame:
    """Add ``prev_col``: struct(time, ties…, values…) of the preceding row in
    ``(time, ties…)`` order within ``key_cols`` (NULL for the first row)."""
    order = [time_col, *tie_cols]
    ranged = in_ranges(df, key_cols, order)
    cur = F.struct(*[F.col(c) for c in order + value_cols])
    return with_previous_row(ranged, key_cols, cur, prev_col).drop(PART, PLACE)
