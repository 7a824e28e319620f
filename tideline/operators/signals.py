"""Signals as rows (symbol, ts, target): algebra, shifts, generators and scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import by_symbol, so_far, trailing
from .joins import forward_values
from .rolling import crossed_down, crossed_up, sma


def imply(first: DataFrame, second: DataFrame, clock: DataFrame, memory: int = 0) -> DataFrame:
    """Second signals of the same direction as the first one standing at most ``memory`` clock rows (0: ever)."""
    x = clock.select("symbol", "ts").join(first.select("symbol", "ts", F.col("target").alias("_f")), ["symbol", "ts"], "full").join(second.select("symbol", "ts", "target"), ["symbol", "ts"], "full")
    w = by_symbol().rowsBetween(-memory, 0) if memory else so_far(by_symbol())
    return x.withColumn("_f", F.last("_f", ignorenulls=True).over(w)).filter((F.col("_f") == F.col("target")) & (F.col("target") != 0)).select("symbol", "ts", "target")


def where_on(signal: DataFrame, switch: DataFrame) -> DataFrame:
    """Signals at times when the last state of ``switch`` (symbol, ts, on) is true."""
    x = signal.select("symbol", "ts", "target").join(switch.select("symbol", "ts", "on"), ["symbol", "ts"], "full")
    return x.withColumn("on", F.last("on", ignorenulls=True).over(so_far(by_symbol()))).filter(F.col("on") & F.col("target").isNotNull()).select("symbol", "ts", "target")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of signals; at equal times the second's counts."""
    x = a.select("symbol", "ts", "target").withColumn("_k", F.lit(0)).unionByName(b.select("symbol", "ts", "target").withColumn("_k", F.lit(1)))
    return x.groupBy("symbol", "ts").agg(F.max_by("target", "_k").alias("target"))


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of signals at equal times."""
    return a.select("symbol", "ts", "target").join(b.select("symbol", "ts", F.col("target").alias("_t")), ["symbol", "ts"]).select("symbol", "ts", (F.col("target") * F.col("_t")).alias("target"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Disjunction of switches; a missing side counts as false."""
    x = a.select("symbol", "ts", F.col("on").alias("_a")).join(b.select("symbol", "ts", F.col("on").alias("_b")), ["symbol", "ts"], "full")
    return x.select("symbol", "ts", (F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))).alias("on"))


def negated(a: DataFrame) -> DataFrame:
    return a.withColumn("target", -F.col("target"))


def shifted(a: DataFrame, period: str) -> DataFrame:
    """Signals moved in time by an interval."""
    return a.withColumn("ts", F.col("ts") + F.expr(f"interval {period}"))


def crossing_means(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """1 where the fast mean rises over the slow one, -1 where it falls under it."""
    w = by_symbol()
    x = bars.withColumns({"_f": sma(F.col("close"), w, fast), "_s": sma(F.col("close"), w, slow)})
    t = F.when(crossed_up(F.col("_f"), F.col("_s"), w), 1.0).when(crossed_down(F.col("_f"), F.col("_s"), w), -1.0)
    return x.select("symbol", "ts", t.alias("target")).filter("target is not null")


def level_crossing(df: DataFrame, column: str, upper: float, lower: float) -> DataFrame:
    """-1 where the column falls back under ``upper``, 1 where it rises back over ``lower``."""
    w = by_symbol()
    t = F.when(crossed_down(F.col(column), F.lit(upper), w), -1.0).when(crossed_up(F.col(column), F.lit(lower), w), 1.0)
    return df.select("symbol", "ts", t.alias("target")).filter("target is not null")


def range_breakout(bars: DataFrame, n: int, add: float = 0.0) -> DataFrame:
    """1 where the close leaves the highest high of the n bars before, -1 below their lowest low."""
    past = by_symbol().rowsBetween(-n, -1)
    whole = F.count("close").over(past) == n
    t = F.when(whole & (F.col("close") > F.max("high").over(past) + add), 1.0).when(whole & (F.col("close") < F.min("low").over(past) - add), -1.0)
    return bars.select("symbol", "ts", t.alias("target")).filter("target is not null")


def bar_strength(bars: DataFrame, upper: float = 0.9, lower: float = 0.1) -> DataFrame:
    """-1 where the close lies near the top of its bar, 1 near its bottom."""
    s = (F.col("close") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    t = F.when(s > upper, -1.0).when(s < lower, 1.0)
    return bars.select("symbol", "ts", t.alias("target")).filter("target is not null")


def direction_score(signal: DataFrame, prices: DataFrame, period: str, least: float = 0.0) -> DataFrame:
    """Part of the signals whose sign is that of the price's move over ``period``."""
    f = forward_values(prices, "symbol", "ts", "price", period)
    move = F.coalesce(F.col("later") - F.col("price"), F.lit(0.0))
    move = F.signum(F.when(F.abs(move) >= least, move).otherwise(0.0))
    x = signal.join(f.select("symbol", "ts", move.alias("_m")), ["symbol", "ts"])
    return x.groupBy("symbol").agg(F.avg((F.col("_m") == F.signum("target")).cast("double")).alias("score"), F.count(F.lit(1)).alias("n"))


def forward_sharpe(signal: DataFrame, prices: DataFrame, period: str, commission: float = 0.0, relative: bool = False) -> DataFrame:
    """Mean over population deviation of the signals' moves over ``period``, less costs."""
    f = forward_values(prices, "symbol", "ts", "price", period)
    d = F.col("later") / F.nullif(F.col("price"), F.lit(0.0)) - 1 if relative else F.col("later") - F.col("price")
    cost = commission * F.abs("target") if relative else F.lit(commission)
    x = signal.join(f.select("symbol", "ts", d.alias("_d")), ["symbol", "ts"]).withColumn("_r", F.col("_d") * F.col("target") - cost)
    s = F.stddev_pop("_r")
    return x.groupBy("symbol").agg(F.when(s > 0, F.avg("_r") / s).alias("score"), F.count("_r").alias("n"))


def reversal_sharpe(signal: DataFrame, prices: DataFrame) -> DataFrame:
    """The same over moves from one reversal of the signal to the next."""
    w = by_symbol()
    turn = signal.withColumn("_p", F.lag("target").over(w)).filter(F.col("_p").isNotNull() & (F.col("_p") != F.col("target")))
    x = turn.join(prices, ["symbol", "ts"]).withColumn("_r", (F.lead("price").over(w) - F.col("price")) * F.col("target"))
    s = F.stddev_pop("_r")
    return x.groupBy("symbol").agg(F.when(s > 0, F.avg("_r") / s).alias("score"), F.count("_r").alias("n"))


def executed(signal: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each change of target with the last price strictly before it: ``quantity``, ``price``."""
    from .joins import asof_join

    x = asof_join(signal.select("symbol", "ts", "target"), quotes.select("symbol", "ts", "price"), ["symbol"], "ts", ["price"], strict=True).filter("price is not null").drop("right_ts")
    w = Window.partitionBy("symbol").orderBy("ts")
    return x.withColumn("quantity", F.col("target") - F.coalesce(F.lag("target").over(w), F.lit(0.0))).filter("quantity <> 0")


def size_by_risk(cash: float, risk: float, most: float = math.inf):
    """Whole size of a position that loses ``risk`` percent of ``cash`` between entry and stop, at most ``most``."""
    d = F.abs(F.col("stop") / F.col("entry") - 1)
    return F.when(d > 0, F.round(F.least(F.lit(cash * risk / 100) / d, F.lit(most)) / F.when(F.col("is_futures"), 1.0).otherwise(F.col("entry"))))


def smoothed_cross(bars: DataFrame, n: int) -> DataFrame:
    """Where the close stands against its mean over n bars: 1 above, -1 below."""
    m = F.avg("close").over(trailing(by_symbol(), n))
    return bars.select("symbol", "ts", F.signum(F.col("close") - m).alias("target"))


def level_breakout(df: DataFrame, resistances: tuple[str, ...], supports: tuple[str, ...]) -> DataFrame:
    """1 where the close breaks above a resistance that the bar before lay under, -1 below a support."""
    w = by_symbol()
    o, c = F.lag("open").over(w), F.lag("close").over(w)
    up, dn = F.lit(False), F.lit(False)
    for n in resistances:
        up = up | F.coalesce((o < F.col(n)) & (c < F.col(n)) & (F.col("close") > F.col(n)), F.lit(False))
    for n in supports:
        dn = dn | F.coalesce((o > F.col(n)) & (c > F.col(n)) & (F.col("close") < F.col(n)), F.lit(False))
    return df.select("symbol", "ts", F.when(dn, -1.0).when(up, 1.0).alias("target")).filter("target is not null")


def twice_inside(x, level, up: bool):
    """Whether ``x`` passes a level after two rows on its other side."""
    w = by_symbol()
    a, b = F.lag(x, 1).over(w), F.lag(x, 2).over(w)
    return (a < level) & (b < level) & (x >= level) if up else (a > level) & (b > level) & (x <= level)


def outstretched(bars: DataFrame, n: int, smooth: int, threshold: float = 0.05) -> DataFrame:
    """Contrarian signals where the smoothed excess of rises over falls nears its bounds."""
    from .smoothers import per_symbol, smoothed

    w = by_symbol()
    past = F.lag("close", n).over(w)
    x = bars.withColumn("_e", F.coalesce((F.col("close") > past).cast("double"), F.lit(0.0)) - F.coalesce((F.col("close") < past).cast("double"), F.lit(0.0)))
    x = x.withColumn("_s", F.when(F.count("_e").over(trailing(w, n)) == n, F.sum("_e").over(trailing(w, n))))
    y = per_symbol(x, lambda p: {"_o": smoothed(p["_s"], "ema", smooth)}, "_o double")
    k = n * (1 - threshold)
    t = F.when(twice_inside(F.col("_o"), F.lit(-k), up=False), 1.0).when(twice_inside(F.col("_o"), F.lit(k), up=True), -1.0)
    return y.select("symbol", "ts", t.alias("target")).filter("target is not null")


def equilibrium(bars: DataFrame, n: int, threshold: float) -> DataFrame:
    """Mean-reverting signals where the smoothed distance to the mean passes a threshold."""
    from .smoothers import per_symbol, smoothed

    y = per_symbol(bars, lambda p: {"_o": smoothed(smoothed(p.close, "sma", n) - p.close.to_numpy(), "ema", n)}, "_o double")
    t = F.when(twice_inside(F.col("_o"), F.lit(threshold), up=True), -1.0).when(twice_inside(F.col("_o"), F.lit(-threshold), up=False), 1.0)
    return y.select("symbol", "ts", t.alias("target")).filter("target is not null")
