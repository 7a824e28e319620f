"""Bars, gaps and calendar aggregates of time-stamped rows in long format.

Every aggregate combines on the map side first; orders inside a bar follow
``(ts, seq)``, so ties have one result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import nan_to_null, ntz, require_columns, us, with_totals
from .rolling import with_previous


def _bucket(ts: Column, freq: str, tz: str | None, origin: str) -> Column:
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), ts) if tz else ts
    start = F.window(local, freq, startTime=origin).start if origin != "0 seconds" else F.window(local, freq).start
    return start


def bars(df: DataFrame, symbol: str, ts: str, value: Column, freq: str, seq: str, volume: Column | None = None, tz: str | None = None, origin: str = "0 seconds") -> DataFrame:
    """Open, high, low, close of ``value`` per symbol and period; empty periods have no row.

    Null values are passed over. With ``tz`` the edges are those of that zone's
    clock and the starts are converted back to UTC (the earlier of two).
    """
    x = df.select(F.col(symbol).alias("symbol"), F.col(ts).alias("_ts"), F.col(seq).alias("_seq"), value.alias("_v"), (volume if volume is not None else F.lit(1.0)).cast("double").alias("_vol"))
    x = x.filter(F.col("_v").isNotNull() & F.col("_ts").isNotNull()).withColumn("_b", _bucket(F.col("_ts"), freq, tz, origin))
    at = F.struct("_ts", "_seq")
    out = x.groupBy("symbol", F.col("_b").alias("ts")).agg(
        F.min_by("_v", at).alias("open"), F.max("_v").alias("high"), F.min("_v").alias("low"), F.max_by("_v", at).alias("close"), F.sum("_vol").alias("volume")
    )
    return out.withColumn("ts", F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col("ts"))) if tz else out


def rebar(ohlc: DataFrame, freq: str, others: str = "last", tz: str | None = None, origin: str = "0 seconds") -> DataFrame:
    """Longer bars from bars: first open, highest, lowest, last close, summed volume.

    Columns beside these are taken by ``others``: last, first, sum, max, min or avg.
    """
    require_columns(ohlc, "symbol", "ts", "open", "high", "low", "close")
    how = {"last": lambda c: F.max_by(c, "ts"), "first": lambda c: F.min_by(c, "ts"), "sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}[others]
    known = {"open": F.min_by("open", "ts"), "high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", "ts"), "volume": F.sum("volume"), "bid_vol": F.sum("bid_vol"), "ask_vol": F.sum("ask_vol")}
    names = [c for c in ohlc.columns if c not in ("symbol", "ts")]
    x = ohlc.withColumn("_b", _bucket(F.col("ts"), freq, tz, origin))
    out = x.groupBy("symbol", "_b").agg(*[known.get(c, how(c)).alias(c) if c in known else how(c).alias(c) for c in names]).withColumnRenamed("_b", "ts")
    return out.withColumn("ts", F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col("ts"))) if tz else out


def midprice(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def weighted_mid(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    """Mid price weighted by the other side's size; the plain mid without sizes."""
    total = bid_size + ask_size
    return F.when(total > 0, (bid * ask_size + ask * bid_size) / total).otherwise((bid + ask) / 2)


def quote_bars(quotes: DataFrame, freq: str, weighted: bool = False, gaps: str = "drop") -> DataFrame:
    """Bars of quotes' mid prices; ``gaps``: ``drop`` empty periods or keep them as ``null``."""
    q = nan_to_null(quotes, "bid", "ask").dropDuplicates(["symbol", "time", "quote_id"])
    v = weighted_mid(F.col("bid"), F.col("ask"), F.coalesce("bidvol", F.lit(0)), F.coalesce("askvol", F.lit(0))) if weighted else midprice(F.col("bid"), F.col("ask"))
    b = bars(q, "symbol", "time", v, freq, "quote_id")
    return b if gaps == "drop" else fill_gaps(b, freq, method="null")


def fill_gaps(b: DataFrame, freq: str, method: str = "ffill", columns: Sequence[str] = ("open", "high", "low", "close"), stretch: int = 1024) -> DataFrame:
    """A row for every period between a symbol's first and last; new ones null or carried forward.

    The periods are numbered from the first one on and laid out in stretches of so
    many, as are the rows; what is carried into a stretch comes from a table of
    one row per symbol and stretch. Periods have a fixed length.
    """
    step = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00' + interval {freq}) - unix_micros(timestamp'1970-01-01 00:00:00')")
    span = b.groupBy("symbol").agg(F.min(us(F.col("ts"))).alias("_a"), F.floor((F.max(us(F.col("ts"))) - F.min(us(F.col("ts")))) / step).alias("_n"))
    parts = span.select("symbol", "_a", "_n", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / stretch).cast("int"))).alias("_part"))
    numbers = F.sequence(F.col("_part").cast("bigint") * stretch, F.least((F.col("_part").cast("bigint") + 1) * stretch - 1, F.col("_n")))
    grid = parts.select("symbol", "_part", "_a", F.explode(numbers).alias("_i"))
    grid = grid.select("symbol", "_part", ntz(F.col("_a") + F.col("_i") * step).alias("ts"))
    out = grid.join(b, ["symbol", "ts"], "left")
    if method == "null":
        return out.drop("_part")
    order = Window.partitionBy("symbol", "_part").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    ends = out.groupBy("symbol", "_part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"_e_{c}") for c in columns])
    before = Window.partitionBy("symbol").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "_part", *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_b_{c}") for c in columns])
    filled = out.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in columns}).join(ends, ["symbol", "_part"], "left")
    return filled.withColumns({c: F.coalesce(c, f"_b_{c}") for c in columns}).drop("_part", *[f"_b_{c}" for c in columns])


def _steps(df: DataFrame, ts: str) -> DataFrame:
    """``symbol``, ``step_us``: the differences of a symbol's successive times, equal times counting once."""
    d = with_previous(df.select("symbol", F.col(ts).alias("ts")).filter(F.col("ts").isNotNull()), ["symbol"], ["ts"], ["ts"])
    return d.select("symbol", (us(F.col("ts")) - us(F.col("_prev.ts"))).alias("step_us")).filter(F.col("step_us") > 0)


def _modal(steps: DataFrame) -> DataFrame:
    n = steps.groupBy("symbol", "step_us").count()
    return n.groupBy("symbol").agg(F.max_by("step_us", F.struct("count", -F.col("step_us"))).alias("step_us"))


def modal_step(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``symbol``, ``step_us``: the most frequent difference of times, of as many the smallest."""
    return _modal(_steps(df, ts))


def gap_report(df: DataFrame, least: int = 1, ts: str = "ts") -> DataFrame:
    """Symbols with at least ``least`` steps that differ from their modal step, and how many."""
    n = _steps(df, ts).groupBy("symbol", "step_us").agg(F.count(F.lit(1)).alias("_n"))
    top = n.groupBy("symbol").agg(F.max_by("step_us", F.struct("_n", -F.col("step_us"))).alias("_modal"))
    out = n.join(top, "symbol").filter(F.col("step_us") != F.col("_modal")).groupBy("symbol").agg(F.sum("_n").alias("gaps"), F.max("step_us").alias("longest_us"))
    return out.filter(F.col("gaps") >= least)


def compound(returns: DataFrame, period: str, r: str = "r", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Compounded returns per calendar period: product of (1 + r) less 1."""
    return returns.groupBy(*keys, F.date_trunc(period, F.col("ts")).cast("timestamp_ntz").alias("period")).agg((F.product(1 + F.coalesce(F.col(r), F.lit(0.0))) - 1).alias("ret"))


def running_range(b: DataFrame, tz: str = "UTC") -> DataFrame:
    """Lowest low and highest high since the start of the day on the zone's clock."""
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("ts")))
    w = Window.partitionBy("symbol", day).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumns({"day_low": F.min("low").over(w), "day_high": F.max("high").over(w)})


def walk_forward(df: DataFrame, train: int, test: int, ts: str = "ts") -> DataFrame:
    """``fold``, ``part`` (train or test) of each row, by calendar days from the first one on.

    A fold trains on ``train`` days and tests on the ``test`` days after it; folds
    advance by ``test`` days; the last test part may be shorter.
    """
    day = F.unix_date(F.col(ts).cast("date"))
    span = df.agg(F.min(day).alias("_a"), F.max(day).alias("_z"))
    # a row belongs to a bounded number of folds: its offset tells which
    x = with_totals(df, span).withColumn("_o", day - F.col("_a"))
    last = F.floor((F.col("_z") - F.col("_a") - train) / test)
    lo = F.greatest(F.ceil((F.col("_o") - train - test + 1) / test), F.lit(0))
    hi = F.least(F.floor(F.col("_o") / test), last)
    out = x.filter(lo <= hi).withColumn("fold", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    part = F.when(F.col("_o") < F.col("fold") * test + train, "train").otherwise("test")
    return out.withColumn("part", part).drop("_a", "_z", "_o")


def session_windows(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Sessions of a key: rows no further apart than ``gap``."""
    s = df.groupBy(key, F.session_window(F.col(ts), gap).alias("w")).agg(F.count(F.lit(1)).alias("rows"))
    return s.select(key, F.col("w.start").alias("start"), "rows")
