"""Segments of a price series: movements, band positions, barrier labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import range_join
from .smoothers import NAN, per_symbol


def turning_points(x: np.ndarray, threshold: float, percent: bool = False) -> np.ndarray:
    """Positions where a movement of at least ``threshold`` (or that part of the price) ends and turns."""
    x = np.asarray(x, dtype=float)
    if not len(x):
        return np.zeros(0, int)
    points, hi, lo, side = [], 0, 0, 0
    for i, v in enumerate(x):
        if v > x[hi]:
            hi = i
        if v < x[lo]:
            lo = i
        if side >= 0 and x[hi] - v >= threshold * (x[hi] if percent else 1.0) and hi < i:
            points.append(hi)
            side, lo = -1, i
            hi = i
        elif side <= 0 and v - x[lo] >= threshold * (x[lo] if percent else 1.0) and lo < i:
            points.append(lo)
            side, hi = 1, i
            lo = i
    last = hi if side > 0 else lo if side < 0 else len(x) - 1
    if points and last > points[-1]:
        points.append(last)
    if points and points[0] > 0:
        points.insert(0, 0)
    return np.array(points, int)


def movements(df: DataFrame, column: str, threshold: float, percent: bool = False) -> DataFrame:
    """``symbol``, ``ts`` (start), ``end``, prices and ``delta`` of each movement up or down."""
    schema = f"symbol {df.schema['symbol'].dataType.simpleString()}, ts timestamp_ntz, end timestamp_ntz, start_price double, end_price double, delta double"

    def f(pdf):
        p = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        k = turning_points(p[column], threshold, percent)
        a, b = p.iloc[k[:-1]].reset_index(drop=True), p.iloc[k[1:]].reset_index(drop=True)
        return a[["symbol", "ts"]].assign(end=b.ts, start_price=a[column].astype(float), end_price=b[column].astype(float), delta=(b[column] - a[column]).astype(float))

    return df.select("symbol", "ts", column).groupBy("symbol").applyInPandas(f, schema)


def band_positions(z: np.ndarray, entry: float, leave: float, back: bool = True, flat_outside: bool = False) -> np.ndarray:
    """Signals of a position against a band: missing where nothing changes.

    ``back``: enters when the value comes back inside the band, and without it
    when it goes out, where it may also reverse; ``flat_outside``: leaves when
    the value goes out on the entry's side again.
    """
    out, pos, before = np.full(len(z), NAN), 0, NAN
    for i, v in enumerate(z):
        if i and v == v:
            new = pos
            at = before if back else v
            if pos == 0:
                if not back or abs(v) < entry:
                    new = 1 if at <= -entry else -1 if at >= entry else 0
            elif not back and pos * v >= entry:
                new = -pos
            elif pos * v >= leave or (flat_outside and back and pos * v < -entry):
                new = 0
            if new != pos:
                out[i] = pos = new
        before = v
    return out


def band_signals(df: DataFrame, column: str, entry: float, leave: float, back: bool = True, flat_outside: bool = False) -> DataFrame:
    return per_symbol(df, lambda p: {"signal": band_positions(p[column].to_numpy(dtype=float), entry, leave, back, flat_outside)}, "signal double").filter(F.col("signal").isNotNull())


def triple_barrier(entries: DataFrame, prices: DataFrame, up: float, down: float, hold: str) -> DataFrame:
    """Label of each entry by the first barrier its price touches within ``hold``.

    ``entries``: symbol, ts, price, side; ``prices``: symbol, ts, price. The
    barriers lie ``up`` and ``down`` (parts of the price) from the entry. Labels:
    2 / -2 upper or lower barrier, 1 / -1 / 0 by the last price when none is met.
    Entries with no price after them have no row.
    """
    e = entries.select("symbol", F.col("ts").alias("entry"), F.col("price").alias("p0")).withColumn("until", F.col("entry") + F.expr(f"interval {hold}"))
    x = range_join(e, prices.select("symbol", "ts", "price"), "symbol", "entry", "until", "ts").filter(F.col("ts") > F.col("entry"))
    hit_up, hit_dn = F.col("price") >= F.col("p0") * (1 + up), F.col("price") <= F.col("p0") * (1 - down)
    g = x.groupBy("symbol", "entry", "p0").agg(F.min(F.when(hit_up, F.col("ts"))).alias("_u"), F.min(F.when(hit_dn, F.col("ts"))).alias("_d"), F.max_by("price", "ts").alias("_lp"), F.max("ts").alias("_lt"))
    upper = F.col("_u").isNotNull() & (F.col("_d").isNull() | (F.col("_u") <= F.col("_d")))
    label = F.when(upper, 2).when(F.col("_d").isNotNull(), -2).otherwise(F.signum(F.col("_lp") - F.col("p0")).cast("int"))
    return g.select("symbol", F.col("entry").alias("ts"), label.alias("label"), F.when(upper, F.col("_u")).otherwise(F.coalesce("_d", "_lt")).alias("hit"))


def turning_points_hilo(high: np.ndarray, low: np.ndarray, threshold: float, percent: bool = False) -> np.ndarray:
    """Positions of alternating tops (of the highs) and bottoms (of the lows) at least ``threshold`` apart.

    One pass with an extreme that moves while its leg lasts: a bar that is both a
    new extreme and a turn counts as the extreme first.
    """
    n, points, side = len(high), [], 0
    hi = lo = 0
    far = lambda a, b: a - b >= threshold * (b if percent else 1.0)
    for i in range(n):
        if side >= 0 and high[i] > high[hi]:
            hi = i
        elif side >= 0 and far(high[hi], low[i]) and i > hi:
            points.append(hi)
            side, lo = -1, i
            continue
        if side <= 0 and low[i] < low[lo]:
            lo = i
        elif side <= 0 and far(high[i], low[lo]) and i > lo:
            points.append(lo)
            side, hi = 1, i
    if points:
        points.append(hi if side > 0 else lo)
    return np.array(points, int)


def movements_hilo(bars: DataFrame, threshold: float, percent: bool = False) -> DataFrame:
    """Movements between tops and bottoms of bars."""

    def f(pdf):
        p = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        k = turning_points_hilo(p.high.to_numpy(), p.low.to_numpy(), threshold, percent)
        a, b = k[:-1], k[1:]
        # a leg starts at the other kind of extreme than it ends
        up = np.array([p.high[j] - p.low[i] >= p.high[i] - p.low[j] for i, j in zip(a, b, strict=True)], bool)
        p0 = np.where(up, p.low.to_numpy()[a], p.high.to_numpy()[a]) if len(a) else np.zeros(0)
        p1 = np.where(up, p.high.to_numpy()[b], p.low.to_numpy()[b]) if len(a) else np.zeros(0)
        out = p.iloc[a][["symbol", "ts"]].reset_index(drop=True)
        return out.assign(end=p.ts.iloc[b].reset_index(drop=True), start_price=p0, end_price=p1, delta=p1 - p0)

    return bars.select("symbol", "ts", "high", "low").groupBy("symbol").applyInPandas(f, "symbol string, ts timestamp_ntz, end timestamp_ntz, start_price double, end_price double, delta double")


def pullbacks(bars: DataFrame, n: int, factor: float = 0.1, absolute: bool = False) -> DataFrame:
    """``symbol``, ``day``, ``pullback``: a part of the smoothed range (or deviation of the moves) of the days before."""
    from .resample import rebar
    from .smoothers import smoothed

    if absolute:
        w = Window.partitionBy("symbol").orderBy("ts")
        d = bars.withColumn("_m", F.abs(F.col("close") - F.lag("close").over(w))).groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.stddev_samp("_m").alias("_v"))
    else:
        d = rebar(bars.select("symbol", "ts", "open", "high", "low", "close"), "1 day")
        d = d.select("symbol", "ts", ((F.col("high") - F.col("low")) / F.nullif("low", F.lit(0.0))).alias("_v"))
    s = per_symbol(d, lambda p: {"pullback": factor * np.r_[NAN, smoothed(p["_v"], "sma" if absolute else "ema", n)[:-1]]}, "pullback double")
    return s.withColumnRenamed("ts", "day")


def reversal_points(bars: DataFrame, n: int = 14, factor: float = 0.1, absolute: bool = False) -> DataFrame:
    """Movements within each week, by the pullback known on the week's first day."""
    p = pullbacks(bars, n, factor, absolute)
    x = bars.select("symbol", "ts", "close", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    first = x.groupBy("symbol", "week").agg(F.min("day").alias("day")).join(p, ["symbol", "day"]).filter("pullback is not null").select("symbol", "week", "pullback")

    def f(pdf):
        p = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        k = turning_points(p.close, p.pullback.iloc[0], percent=not absolute)
        a, b = p.iloc[k[:-1]].reset_index(drop=True), p.iloc[k[1:]].reset_index(drop=True)
        return a[["symbol", "ts"]].assign(end=b.ts, delta=(b.close - a.close).astype(float))

    return x.drop("day").join(first, ["symbol", "week"]).groupBy("symbol", "week").applyInPandas(f, "symbol string, ts timestamp_ntz, end timestamp_ntz, delta double")
