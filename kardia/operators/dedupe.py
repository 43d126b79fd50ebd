"""C1 / E4 — idempotent insert: first arrival wins, re-ingest is a no-op.

A split scan has no global file order, so "first" is made deterministic:
the existing row wins over the batch, and inside a batch the row with the
lowest ``(order columns…, all other columns)`` wins (D10).

The in-batch winner is an aggregate — ``min(struct(order…, rest…))`` per key —
not a ``row_number`` window: the aggregate combines map-side, so a key that
holds a third of all rows is reduced inside each input task before the
shuffle instead of landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_ALONE = "_alone"  # number of a row that never clashes


def dedupe_first_wins(df: DataFrame, key_cols: list[str], order_cols: list[str] | None = None,
                      null_keys_bypass: bool = True, bypass_cols: list[str] | None = None) -> DataFrame:
    """One row per key: the lowest (order_cols, remaining columns).

    Rows with a NULL in a ``bypass_cols`` key (default: any key column) never
    clash (SQLite text-key semantics, D11) and are passed through unchanged
    when ``null_keys_bypass``; NULLs in other key columns group together.
    """
    order_cols = list(order_cols or [])
    columns = df.columns
    rest = [c for c in columns if c not in key_cols and c not in order_cols]
    payload = order_cols + rest
    any_null = F.lit(False)
    for k in (bypass_cols if bypass_cols is not None else key_cols):
        any_null = any_null | F.col(k).isNull()
    keys = list(key_cols)
    if null_keys_bypass:
        # each of them is a group of its own, so that one pass over the rows serves both kinds
        df, keys = df.withColumn(_ALONE, F.when(any_null, F.monotonically_increasing_id())), [*keys, _ALONE]
    return (df.groupBy(*keys)
            .agg(F.min(F.struct(*[F.col(c) for c in payload])).alias("_w"))
            .select(*key_cols, *[F.col(f"_w.{c}").alias(c) for c in payload])
            .select(*columns))


def new_rows_only(batch: DataFrame, target: DataFrame | None, key_cols: list[str],
                  null_safe_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``batch`` whose key is absent from ``target`` (left anti
    join); ``null_safe_cols`` compare NULL equal to NULL."""
    if target is None:
        return batch
    if not null_safe_cols:
        return batch.join(target.select(*key_cols), on=key_cols, how="left_anti")
    t = target.select(*[F.col(k).alias(f"_t_{k}") for k in key_cols])
    cond = None
    for k in key_cols:
        c = F.col(k).eqNullSafe(F.col(f"_t_{k}")) if k in null_safe_cols else (F.col(k) == F.col(f"_t_{k}"))
        cond = c if cond is None else cond & c
    return batch.join(t, cond, "left_anti")


def idempotent_rows(batch: DataFrame, target: DataFrame | None, key_cols: list[str],
                    order_cols: list[str] | None = None, null_safe_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """In-batch first-wins, then drop keys already stored — what to append.
    NULLs in ``null_safe_cols`` are ordinary values; other NULL keys bypass."""
    bypass = [k for k in key_cols if k not in null_safe_cols]
    return new_rows_only(dedupe_first_wins(batch, key_cols, order_cols, bypass_cols=bypass),
                         target, key_cols, null_safe_cols)
