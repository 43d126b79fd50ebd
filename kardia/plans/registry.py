"""Registry of named queries (Spark) and their DuckDB oracle SQL.

Every query takes ``(spark, sf_dir)``, reads the driver tables under
``sf_dir`` (directly or through :mod:`kardia.plans.bridge`) and returns a
DataFrame. Computed doubles are rounded to 4 places on both sides because
sums depend on evaluation order; timestamps are returned as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


# Means of 2-decimal values can sit exactly on a 4-place rounding tie, where
# summation-order noise (which differs between engines and partitionings)
# decides the last digit. Both sides therefore round ``x + 1e-9``: Spark in
# ``catalog_analytics.r4``, the oracle SQL through this rewrite of
# ``round(x, 4)``. The shift is far above float noise and far below 1e-4.
TIE_EPS = 1e-9


def tie_safe_rounding(sql: str) -> str:
    """Rewrite every ``round(<expr>, 4)`` as ``(round((<expr>) + 1e-9, 4) + 0.0)``."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        k, depth, quote, args, start = j + 6, 1, None, [], j + 6
        while depth:
            ch = sql[k]
            if quote:
                quote = None if ch == quote else quote
            elif ch in "'\"":
                quote = ch
            elif ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                args.append(sql[start:k])
                start = k + 1
            k += 1
        args.append(sql[start:k - 1])
        inner = tie_safe_rounding(args[0])
        if len(args) == 2 and args[1].strip() == "4":
            # "+ 0.0" turns a rounded -0.0 into 0.0 (Spark's decimal rounding has no -0)
            out.append(sql[i:j] + f"(round(({inner}) + {TIE_EPS}, 4) + 0.0)")
        else:
            out.append(sql[i:j] + "round(" + ",".join([inner] + args[1:]) + ")")
        i = k


def register(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = tie_safe_rounding(oracle.strip())
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from kardia.plans import (catalog_analytics, catalog_ecg, catalog_ingest, catalog_signals,  # noqa: F401
                              catalog_xml,
                              catalog_streaming)
