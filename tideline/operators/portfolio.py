"""Returns, drawdowns, risk figures, positions, trades and costs, in long format."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import by_symbol, small, so_far, trailing, with_totals
from .joins import asof_join, range_join
from .rolling import with_previous, with_runs

#: Periods of a year.
DAILY, WEEKLY, MONTHLY, YEARLY = 252, 52, 12, 1


def per_row(df: DataFrame, *columns: str) -> DataFrame:
    """Cumulative columns as changes; the first row keeps its value."""
    return df.withColumns({c: F.col(c) - F.coalesce(F.lag(c).over(by_symbol()), F.lit(0.0)) for c in columns})


def totals(log: DataFrame) -> DataFrame:
    """PnL and commissions of all symbols at each time."""
    return log.groupBy("ts").agg(F.sum("pnl").alias("pnl"), F.sum("commissions").alias("commissions"))


def net_pnl(log: DataFrame, period: str | None = None, costs: float = 1.0, cumulative: bool = False) -> DataFrame:
    """PnL less ``costs`` times the commissions per symbol and calendar period."""
    at = F.date_trunc(period, "ts").cast("timestamp_ntz").alias("ts") if period else F.col("ts")
    x = log.groupBy("symbol", at).agg(F.sum(F.coalesce("pnl", F.lit(0.0)) - costs * F.coalesce("commissions", F.lit(0.0))).alias("pnl"))
    return x.withColumn("pnl", F.sum("pnl").over(so_far(by_symbol()))) if cumulative else x


def portfolio_returns(equity: DataFrame, cash: float, method: str = "pct", gross: str = "gmv") -> DataFrame:
    """``r`` by changes of a symbol's cumulative ``pnl``: of the equity before (pct), of the
    gross value before (gmv) or of the cash (fixed). Without a base it is 0."""
    d = F.col("pnl") - F.lag("pnl").over(by_symbol())
    base = {"pct": cash + F.lag("pnl").over(by_symbol()), "gmv": F.lag(gross).over(by_symbol()) if method == "gmv" else None, "fixed": F.lit(cash)}[method]
    return equity.withColumn("r", F.coalesce(d / F.nullif(base.cast("double"), F.lit(0.0)), F.lit(0.0)))


# figures of returns, as aggregate expressions ---------------------------------------------------------------------


def cagr(r: Column, periods: int = DAILY) -> Column:
    """Compound growth per year; nulls count as periods without return."""
    return F.pow(F.product(1 + F.coalesce(r, F.lit(0.0))), F.lit(float(periods)) / F.count(F.lit(1))) - 1


def sharpe(r: Column, periods: int = DAILY, risk_free: float = 0.0) -> Column:
    s = F.stddev_samp(r - risk_free)
    return F.when(s > 0, F.avg(r - risk_free) / s * math.sqrt(periods))


def downside(r: Column, required: float = 0.0, periods: int = 252) -> Column:
    below = F.when(r.isNotNull(), F.least(r - required, F.lit(0.0)))
    return F.sqrt(F.avg(F.pow(below, 2))) * math.sqrt(periods)


def sortino(r: Column, periods: int = DAILY, required: float = 0.0) -> Column:
    """Mean over the downside, which is per year of 252 periods whatever ``periods`` is; infinite without losses."""
    d, m = downside(r, required), F.avg(r - required)
    return F.when(d > 0, periods * m / d).when(m > 0, float("inf"))


def omega(r: Column, threshold: float = 0.0) -> Column:
    gain, loss = (F.sum(F.when(r.isNotNull(), F.greatest(d, F.lit(0.0)))) for d in (r - threshold, threshold - r))
    return F.when(loss > 0, gain / loss)


def information_ratio(r: Column, factor: Column) -> Column:
    s = F.stddev_samp(r - factor)
    return F.when(s > 0, F.avg(r - factor) / s)


def volatility(r: Column, periods: int = DAILY) -> Column:
    return F.stddev_samp(r) * math.sqrt(periods)


def tail_ratio(r: Column) -> Column:
    low = F.abs(F.percentile(r, F.lit(0.05)))
    return F.when(low > 0, F.abs(F.percentile(r, F.lit(0.95))) / low)


def beta(r: Column, factor: Column) -> Column:
    v = F.var_pop(factor)
    return F.when(v > 0, F.covar_pop(r, factor) / v)


def alpha(r: Column, factor: Column, periods: int = DAILY) -> Column:
    return (F.avg(r) - beta(r, factor) * F.avg(factor)) * periods


def value_at_risk(r: Column, value: float, confidence: float = 0.95) -> Column:
    """Loss by the normal quantile of the mean and population deviation."""
    z = NormalDist().inv_cdf(1 - confidence)
    return value - value * (F.avg(r) + F.stddev_pop(r) * z + 1)


def with_rolling_sharpe(df: DataFrame, n: int, periods: int = DAILY) -> DataFrame:
    w = trailing(by_symbol(), n)
    s = F.stddev_samp("r").over(w)
    return df.withColumn("rolling_sharpe", F.when((F.count("r").over(w) == n) & (s > 0), F.avg("r").over(w) / s * math.sqrt(periods)))


def stability(df: DataFrame) -> DataFrame:
    """How straight the cumulative log return runs (r2 on the row number)."""
    x = df.filter(F.col("r") > -1).withColumns({"_c": F.sum(F.log1p("r")).over(so_far(by_symbol())), "_i": F.row_number().over(by_symbol()).cast("double")})
    return x.groupBy("symbol").agg(F.regr_r2("_c", "_i").alias("stability"))


def quality(df: DataFrame, equity: str) -> DataFrame:
    """r2 times slope by the residuals' deviation, of the equity on a line from -1 to 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    x = df.withColumn("_i", F.when(n > 1, 2.0 * (F.row_number().over(by_symbol()) - 1) / (n - 1) - 1))
    r2 = F.regr_r2(equity, "_i")
    rest = F.sqrt(F.regr_syy(equity, "_i") / F.count(F.lit(1)) * (1 - r2))
    return x.groupBy("symbol").agg(F.when(rest > 0, r2 * F.regr_slope(equity, "_i") / rest).alias("qr"))


# drawdowns --------------------------------------------------------------------------------------------------------


def with_drawdown(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("dd", F.max(column).over(so_far(by_symbol())) - F.col(column))


def max_drawdown(df: DataFrame, column: str) -> DataFrame:
    """Largest drawdown with its start, peak and recovery (the last time if there is none)."""
    x = with_drawdown(df, column)
    top = x.groupBy("symbol").agg(F.max("dd").alias("mdd"), F.max_by("ts", F.struct("dd", -F.unix_micros(F.col("ts").cast("timestamp")))).alias("peak"), F.min("ts").alias("_a"), F.max("ts").alias("_z"))
    y = x.join(top, "symbol").filter("dd = 0")
    out = y.groupBy("symbol").agg(F.first("mdd").alias("mdd"), F.max(F.when(F.col("ts") < F.col("peak"), F.col("ts"))).alias("_s"), F.first("peak").alias("peak"), F.coalesce(F.min(F.when(F.col("ts") > F.col("peak"), F.col("ts"))), F.first("_z")).alias("_r"), F.first("_a").alias("_a"))
    none = F.col("mdd") == 0
    return out.select("symbol", "mdd", F.when(none, F.col("_a")).otherwise(F.coalesce("_s", "_a")).alias("start"), F.when(none, F.col("_a")).otherwise(F.col("peak")).alias("peak"), F.when(none, F.col("_a")).otherwise(F.col("_r")).alias("recovered"))


def drawdown_episodes(df: DataFrame, column: str) -> DataFrame:
    """Drawdowns by their duration in rows: how many, mean, largest and smallest depth."""
    x = with_runs(with_drawdown(df, column), ["symbol"], ["ts"], F.col("dd") > 0, "_run").filter("dd > 0")
    e = x.groupBy("symbol", "_run").agg(F.count(F.lit(1)).alias("duration"), F.max("dd").alias("_m"))
    return e.groupBy("symbol", "duration").agg(F.count(F.lit(1)).alias("occurrences"), F.avg("_m").alias("mean"), F.max("_m").alias("largest"), F.min("_m").alias("smallest"))


def compounded(r: str, w) -> Column:
    """The product of (1 + r) over the frame ``w``: 0 from a return of -1 or less on, missing ones count as 0."""
    x = F.coalesce(r, F.lit(0.0))
    return F.when(F.max((x <= -1).cast("int")).over(w) == 1, 0.0).otherwise(F.exp(F.sum(F.when(x > -1, F.log1p(x))).over(w)))


def max_drawdown_pct(df: DataFrame) -> DataFrame:
    """Lowest part of compounded returns under their own maximum so far (start of 1 included).

    A missing return counts as 0; one of -1 or less loses everything, for good.
    """
    w = so_far(by_symbol())
    x = df.withColumn("_c", compounded("r", w))
    x = x.withColumn("_d", F.col("_c") / F.greatest(F.max("_c").over(w), F.lit(1.0)) - 1)
    return x.groupBy("symbol").agg(F.min("_d").alias("mdd_pct"))


# positions, trades, costs -----------------------------------------------------------------------------------------


def linear_pnl(executions: DataFrame, marks: DataFrame) -> DataFrame:
    """Position and total PnL at each mark, without a fold.

    With one currency the PnL is the position's market value less what its
    executions cost: ``q * mark - sum(dq * price)``; longs are marked at bid,
    shorts at ask. ``executions``: symbol, ts, quantity, price; ``marks``:
    symbol, ts, bid, ask. An execution at a mark's time counts.
    """
    w = so_far(by_symbol())
    e = executions.groupBy("symbol", "ts").agg(F.sum("quantity").alias("_q"), F.sum(F.col("quantity") * F.col("price")).alias("_c"))
    e = e.select("symbol", "ts", F.sum("_q").over(w).alias("pos"), F.sum("_c").over(w).alias("cost"))
    x = asof_join(marks, e, ["symbol"], "ts", ["pos", "cost"]).drop("right_ts")
    pos = F.coalesce("pos", F.lit(0.0))
    mark = F.when(pos > 0, F.col("bid")).otherwise(F.col("ask"))
    return x.select("symbol", "ts", pos.alias("pos"), (pos * mark).alias("value"), F.coalesce(pos * mark - F.col("cost"), F.lit(0.0)).alias("pnl"))


def trades(executions: DataFrame) -> DataFrame:
    """Trades from executions: a trade lasts while the position keeps its sign.

    An execution that turns the position closes one trade and opens the next.
    Executions go one by one in order of ``ts`` and, if there is one, ``seq``,
    so those of one time that net to nothing keep their PnL. ``pnl`` is the
    cash that flowed between opening and closing; a trade that is still open has
    a null ``exit``. Executions of no quantity, without one or without a price
    are passed over.
    """
    seq = F.col("seq") if "seq" in executions.columns else F.lit(0)
    x = executions.select("symbol", "ts", seq.alias("_seq"), F.col("quantity").alias("q"), "price").filter("q <> 0 and price is not null")
    own = Window.partitionBy("symbol").orderBy("ts", "_seq")
    x = x.withColumn("pos", F.round(F.sum("q").over(so_far(own)), 9)).withColumn("_b", F.coalesce(F.lag("pos").over(own), F.lit(0.0)))
    close = F.when(F.col("_b") * F.col("q") < 0, F.least(F.abs("_b"), F.abs("q")) * F.signum("q")).otherwise(0.0)
    parts = F.array(F.struct(F.lit(0).alias("k"), close.alias("dq"), F.signum("_b").alias("side")), F.struct(F.lit(1).alias("k"), (F.col("q") - close).alias("dq"), F.signum("q").alias("side")))
    y = x.select("symbol", "ts", "_seq", "price", F.inline(parts)).filter(F.abs("dq") > 1e-12)
    order = Window.partitionBy("symbol").orderBy("ts", "_seq", "k")
    run = F.sum(F.col("dq")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    y = y.withColumn("_p", F.round(run, 9))
    opens = (F.col("k") == 1) & (F.abs(F.col("_p") - F.col("dq")) < 1e-9)
    y = y.withColumn("trade", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    done = F.max((F.abs("_p") < 1e-9).cast("int")) == 1
    size = F.sum(F.when(F.col("k") == 1, F.abs("dq")).otherwise(0.0))
    return y.groupBy("symbol", "trade").agg(
        F.min("ts").alias("entry"), F.when(done, F.max("ts")).alias("exit"), F.max("side").cast("int").alias("direction"), size.alias("quantity"), F.when(done, -F.sum(F.col("dq") * F.col("price"))).alias("pnl")
    )


def excursions(tr: DataFrame, bars: DataFrame) -> DataFrame:
    """Best and worst price inside each closed trade, relative to its side."""
    t = tr.filter("exit is not null").select("symbol", "trade", "entry", "exit", "direction", "pnl")
    x = range_join(t, bars.select("symbol", "ts", "high", "low"), "symbol", "entry", "exit", "ts")
    up, dn = F.max("high"), F.min("low")
    return x.groupBy("symbol", "trade", "direction").agg(F.when(F.col("direction") > 0, up).otherwise(dn).alias("favourable"), F.when(F.col("direction") > 0, dn).otherwise(up).alias("adverse"), F.count(F.lit(1)).alias("bars"))


def costs(executions: DataFrame, rates: DataFrame, on: Sequence[str]) -> DataFrame:
    """``cost`` of each execution: the taker's rate if it crossed the market, else the maker's,
    of the amount traded (of the quantity alone for futures). Without a rate it is null."""
    x = executions.join(small(rates), list(on), "left")
    amount = F.abs(F.when(F.col("is_futures"), F.col("quantity")).otherwise(F.col("quantity") * F.col("price")))
    return x.withColumn("cost", amount * F.when(F.col("crossed"), F.col("taker")).otherwise(F.col("maker")))


def tiered_costs(executions: DataFrame, rates: DataFrame, calculator: str, level: str | None = None, period: str = "month") -> DataFrame:
    """``cost`` of each execution by a named calculator with levels.

    ``rates``: calculator, level, least_volume, taker, maker, of_quantity (the
    amount is the quantity alone). A ``level`` that is named holds for all; else
    each calendar period has the level with the largest ``least_volume`` up to the
    amount traded in the period before (0 without one). Without a rate, a time, a
    quantity or a price the cost is null; an unknown calculator or level is an
    error. Columns of ``executions``: ts, quantity, price, crossed.
    """
    own = rates.filter((F.col("calculator") == calculator) & (F.lit(True) if level is None else F.col("level") == level))
    if own.isEmpty():
        raise ValueError(f"no rates of {calculator} {level or ''}".strip())
    at = F.date_trunc(period, "ts").cast("timestamp_ntz")
    before = executions.filter(F.col("ts").isNotNull()).groupBy(at.alias("_at")).agg(F.sum(F.abs(F.col("quantity") * F.col("price"))).alias("_v"))
    after = (F.col("_at") + F.expr(f"interval 1 {period}")).alias("_at")
    seen = before.select("_at", F.lit(0.0).alias("_v")).unionByName(before.select(after, F.coalesce("_v", F.lit(0.0)).alias("_v"))).groupBy("_at").agg(F.max("_v").alias("_v"))
    every = own.agg(F.collect_list(F.struct(F.lit(0.0).alias("least") if level is not None else F.coalesce("least_volume", F.lit(0.0)).alias("least"), "taker", "maker", "of_quantity")).alias("_r"))
    # one row per calendar period, of which there are few in any span of time
    tier = with_totals(seen, every).select("_at", F.array_max(F.filter("_r", lambda r: r["least"] <= F.col("_v"))).alias("_t"))
    x = executions.withColumn("_at", at).join(F.broadcast(tier), "_at", "left")
    amount = F.abs(F.when(F.col("_t.of_quantity"), F.col("quantity")).otherwise(F.col("quantity") * F.col("price")))
    return x.withColumn("cost", amount * F.when(F.col("crossed"), F.col("_t.taker")).otherwise(F.col("_t.maker"))).drop("_at", "_t")


def traded_volume(executions: DataFrame, period: str) -> DataFrame:
    """Amount traded per symbol and period, by market and limit executions."""
    v = F.abs(F.col("quantity") * F.col("price"))
    return executions.groupBy("symbol", F.date_trunc(period, "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum(F.when(F.col("crossed"), v).otherwise(0.0)).alias("market"), F.sum(F.when(~F.col("crossed"), v).otherwise(0.0)).alias("limit"))


def sampled(states: DataFrame, seconds: int, columns: Sequence[str]) -> DataFrame:
    """The last state of each symbol and period."""
    at = F.struct("ts", "seq")
    return states.groupBy("symbol", F.window("ts", f"{seconds} seconds").start.alias("at")).agg(*[F.max_by(c, at).alias(c) for c in columns]).withColumnRenamed("at", "ts")


def cut_at_margin(equity: DataFrame, cash: float, part: float = 0.33) -> DataFrame:
    """Rows up to the first at which the equity is down to ``part`` of the cash."""
    low = equity.filter(cash + F.col("pnl") <= part * cash).groupBy("symbol").agg(F.min("ts").alias("_c"))
    return equity.join(low, "symbol", "left").filter(F.col("_c").isNull() | (F.col("ts") <= F.col("_c"))).drop("_c")


def stats(df: DataFrame, cash: float) -> DataFrame:
    """One row of figures per symbol from daily returns ``r`` and cumulative ``pnl``."""
    r = F.col("r")
    a = df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), (cash + F.max_by("pnl", "ts")).alias("equity"), cagr(r).alias("cagr"), sharpe(r).alias("sharpe"), sortino(r).alias("sortino"), volatility(r).alias("volatility"),
        omega(r).alias("omega"), tail_ratio(r).alias("tail_ratio"), value_at_risk(r, cash).alias("var"),
    )
    d = max_drawdown(df, "pnl").select("symbol", "mdd")
    return a.join(d, "symbol").join(max_drawdown_pct(df), "symbol").join(stability(df), "symbol").join(quality(df, "pnl"), "symbol").withColumn("calmar", F.when(F.col("mdd_pct") < 0, F.col("cagr") / F.abs("mdd_pct")))


def growth(daily: DataFrame, cash: float | None = None) -> DataFrame:
    """Returns on the equity of the day before and the growth index. ``daily``: symbol, ts, pnl and,
    without a fixed ``cash``, flow (cash brought in). Days without equity before them are left
    out; a return of -1 or less loses everything, for good."""
    w = by_symbol()
    base = F.lit(cash) + F.sum("pnl").over(so_far(w)) if cash is not None else F.sum(F.col("pnl") + F.col("flow")).over(so_far(w))
    x = daily.withColumn("_e", base)
    x = x.withColumn("r", F.col("pnl") / F.nullif(F.lag("_e").over(w), F.lit(0.0))).filter("r is not null")
    return x.withColumn("growth", compounded("r", so_far(w))).drop("_e")


def cash_flow(active: DataFrame, per_instrument: float) -> DataFrame:
    """Cash brought in as instruments become active: ``ts``, ``flow`` from symbol, ts, price."""
    n = active.groupBy("ts").agg(F.count("price").alias("_n"))
    x = with_previous(n, [], ["ts"], ["_n"])
    return x.select("ts", (per_instrument * (F.col("_n") - F.coalesce("_prev._n", F.lit(0)))).alias("flow"))


def merge_chunks(*chunks: DataFrame) -> DataFrame:
    """One log of chunks with cumulative PnL that overlap: a later chunk counts from its first time on,
    its PnL continuing what stood there."""
    out = per_row(chunks[0], "pnl")
    for c in chunks[1:]:
        border = c.groupBy("symbol").agg(F.min("ts").alias("_b"))
        d = per_row(c, "pnl").join(border, "symbol")
        own = d.filter(F.col("ts") > F.col("_b")).drop("_b")
        head = out.join(border, "symbol", "left").filter(F.col("_b").isNull() | (F.col("ts") <= F.col("_b"))).drop("_b")
        out = head.unionByName(own)
    return out
