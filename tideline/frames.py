"""Helpers that every operator shares: column checks, nulls, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes, as the optimizer estimates them, up to which a side may be broadcast.
BROADCAST_BYTES = 8 << 20


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise at plan time if ``df`` lacks a column."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def frame_kind(df: DataFrame) -> str:
    """``ohlc``, ``quotes``, ``ticks`` or ``series``, told from the column names."""
    have = set(df.columns)
    if {"open", "high", "low", "close"} <= have:
        return "ohlc"
    if {"bid", "ask"} <= have:
        return "ticks" if "is_real" in have else "quotes"
    return "series"


def valid(x: Column) -> Column:
    """NaN and infinities become null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.when(~F.isnan(df[n]), df[n]) for n in names})


def small(df: DataFrame, like: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the optimizer's estimate of its size is at most ``limit`` bytes.

    No job runs. ``like``: a table that ``df`` has no more rows than, whose size
    is looked at instead. Beyond the limit, or where nothing is known of the
    size, the join is left to Spark, which shuffles or decides at run time.
    """
    size = (df if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(size) <= limit else df


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """``df`` with the columns of an aggregate over all rows, which has exactly one row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")


def us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def ntz(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def order_window(keys: Sequence[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(w, n: int):
    """The frame of the row and the ``n - 1`` rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def full(x: Column, w, n: int, value: Column) -> Column:
    """``value`` once ``n`` non-null ``x`` lie in the trailing frame, else null."""
    return F.when(F.count(x).over(trailing(w, n)) == n, value)


def by_symbol():
    """The window of a symbol's rows in order of time (needs a session, so it is made when used)."""
    return Window.partitionBy("symbol").orderBy("ts")
