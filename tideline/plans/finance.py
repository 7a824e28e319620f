"""Queries of returns, risk, positions, costs, signals and statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..frames import by_symbol, with_totals
from ..operators import portfolio as P
from ..operators import signals as G
from ..operators import stats as T
from .base import BARS, DAYS, RETURNS, bars, days, returns
from .registry import Registry

R = Registry()
_w = "over (partition by symbol order by ts"


def _q(x, *columns):
    return x.select(*[c if not isinstance(c, tuple) else F.round(c[0], c[1]).alias(c[0]) for c in columns])


def _figures(name: str, sql: str, build, source: str = RETURNS, get=returns, digits: int = 6):
    """A query of one figure per symbol."""

    @R.query(name, f"with {source} select symbol, round({sql}, {digits}) as value from rets where r is not null group by 1")
    def _(t):
        return get(t).filter("r is not null").groupBy("symbol").agg(F.round(build(), digits).alias("value"))


r = lambda: F.col("r")
_figures("cagr", "power(product(1 + r), 252.0 / count(*)) - 1", lambda: P.cagr(r()), digits=4)
_figures("sharpe", "avg(r) / stddev_samp(r) * sqrt(252)", lambda: P.sharpe(r()))
_figures("sortino", "252 * avg(r) / (sqrt(avg(power(least(r, 0), 2))) * sqrt(252))", lambda: P.sortino(r()))
_figures("omega", "sum(greatest(r - 0.001, 0)) / sum(greatest(0.001 - r, 0))", lambda: P.omega(r(), 0.001))
_figures("annual_volatility", "stddev_samp(r) * sqrt(252)", lambda: P.volatility(r()))
_figures("tail_ratio", "abs(quantile_cont(r, 0.95)) / abs(quantile_cont(r, 0.05))", lambda: P.tail_ratio(r()))
_figures("var_normal", "100000 - 100000 * (avg(r) + stddev_pop(r) * -1.6448536269514722 + 1)", lambda: P.value_at_risk(r(), 100000.0), digits=3)

_PAIR = RETURNS + ", p as (select a.symbol, a.ts, a.r, b.r as f from rets a join rets b on a.ts = b.ts where b.symbol = 'view' and a.symbol <> 'view' and a.r is not null and b.r is not null)"


def _pairs(t):
    x = returns(t).filter("r is not null")
    return x.filter("symbol <> 'view'").join(x.filter("symbol = 'view'").select("ts", F.col("r").alias("f")), "ts")


@R.query("beta_alpha_information", f"with {_PAIR} select symbol, round(covar_pop(r, f) / var_pop(f), 6) as beta, round((avg(r) - covar_pop(r, f) / var_pop(f) * avg(f)) * 252, 6) as alpha, round(avg(r - f) / stddev_samp(r - f), 6) as ir from p group by 1")
def _(t):
    a, b = F.col("r"), F.col("f")
    return _pairs(t).groupBy("symbol").agg(F.round(P.beta(a, b), 6).alias("beta"), F.round(P.alpha(a, b), 6).alias("alpha"), F.round(P.information_ratio(a, b), 6).alias("ir"))


@R.query("rolling_sharpe", f"with {RETURNS} select symbol, ts, round(case when count(r) {_w} rows 9 preceding) = 10 then avg(r) {_w} rows 9 preceding) / stddev_samp(r) {_w} rows 9 preceding) * sqrt(252) end, 6) as rolling_sharpe from rets")
def _(t):
    return _q(P.with_rolling_sharpe(returns(t), 10), "symbol", "ts", ("rolling_sharpe", 6))


@R.query("stability", f"with {RETURNS}, c as (select symbol, sum(ln(1 + r)) {_w}) as c, row_number() {_w})::double as i from rets where r > -1) select symbol, round(regr_r2(c, i), 6) as stability from c group by 1")
def _(t):
    return _q(P.stability(returns(t)), "symbol", ("stability", 6))


_EQ = DAYS + f", eq as (select symbol, ts, sum(close - 50) {_w}) as pnl from days)"


def _equity(t):
    return days(t).select("symbol", "ts", F.sum(F.col("close") - 50).over(by_symbol()).alias("pnl"))


@R.query("qr", f"with {_EQ}, i as (select symbol, pnl, 2.0::double * (row_number() {_w}) - 1) / (count(*) over (partition by symbol) - 1) - 1 as i from eq) select symbol, round(regr_r2(pnl, i) * regr_slope(pnl, i) / sqrt(regr_syy(pnl, i) / count(*) * (1 - regr_r2(pnl, i))), 6) as qr from i group by 1")
def _(t):
    return _q(P.quality(_equity(t), "pnl"), "symbol", ("qr", 6))


@R.query("drawdown", f"with {_EQ} select symbol, ts, round(max(pnl) {_w}) - pnl, 6) as dd from eq")
def _(t):
    return _q(P.with_drawdown(_equity(t), "pnl"), "symbol", "ts", ("dd", 6))


@R.query(
    "max_drawdown",
    f"with {_EQ}, d as (select *, max(pnl) {_w}) - pnl as dd from eq), m as (select symbol, max(dd) as mdd, max(ts) as z, min(ts) as a from d group by 1), p as (select d.symbol, m.mdd, z, a, min(ts) as peak from d join m on d.symbol = m.symbol and d.dd = m.mdd group by 1, 2, 3, 4) "
    "select p.symbol, round(mdd, 6) as mdd, case when mdd = 0 then a else coalesce(max(case when ts < peak then ts end), a) end as start, case when mdd = 0 then a else peak end as peak, case when mdd = 0 then a else coalesce(min(case when ts > peak then ts end), z) end as recovered from p join d on d.symbol = p.symbol and d.dd = 0 group by p.symbol, mdd, a, z, peak",
)
def _(t):
    return _q(P.max_drawdown(_equity(t), "pnl"), "symbol", ("mdd", 6), "start", "peak", "recovered")


@R.query(
    "drawdown_episodes",
    f"with {_EQ}, d as (select *, max(pnl) {_w}) - pnl as dd from eq), n as (select *, case when (dd > 0) is distinct from lag(dd > 0) {_w}) then 1 else 0 end as n from d), g as (select *, sum(n) {_w}) as g from n), e as (select symbol, g, count(*) as duration, max(dd) as m from g where dd > 0 group by 1, 2) "
    "select symbol, duration, count(*) as occurrences, round(avg(m), 6) as mean, round(max(m), 6) as largest, round(min(m), 6) as smallest from e group by 1, 2",
)
def _(t):
    return _q(P.drawdown_episodes(_equity(t), "pnl"), "symbol", "duration", "occurrences", ("mean", 6), ("largest", 6), ("smallest", 6))


@R.query("max_dd_pct", f"with {RETURNS}, c as (select symbol, ts, case when min(coalesce(r, 0)) {_w}) <= -1 then 0 else exp(sum(case when coalesce(r, 0) > -1 then ln(1 + coalesce(r, 0)) end) {_w})) end as c from rets), d as (select symbol, c / greatest(max(c) {_w}), 1) - 1 as d from c) select symbol, round(min(d), 6) as mdd_pct from d group by 1")
def _(t):
    return _q(P.max_drawdown_pct(returns(t)), "symbol", ("mdd_pct", 6))


for _m, _base in (("pct", f"1000 + lag(pnl) {_w})"), ("fixed", "1000"), ("gmv", f"lag(close) {_w})")):

    @R.query(f"portfolio_returns_{_m}", f"with {_EQ}, e as (select eq.*, close from eq join days using (symbol, ts)) select symbol, ts, round(coalesce((pnl - lag(pnl) {_w})) / nullif({_base}, 0), 0), 6) as r from e")
    def _(t, m=_m):
        x = _equity(t).join(days(t).select("symbol", "ts", F.col("close").alias("gmv")), ["symbol", "ts"])
        return _q(P.portfolio_returns(x, 1000.0, m), "symbol", "ts", ("r", 6))


@R.query("margin_cut", f"with {_EQ}, c as (select symbol, min(case when 200 + pnl <= 66 then ts end) as c from eq group by 1) select symbol, ts, round(pnl, 6) as pnl from eq join c using (symbol) where c is null or ts <= c")
def _(t):
    return _q(P.cut_at_margin(_equity(t), 200.0), "symbol", "ts", ("pnl", 6))


_STATS = ("equity", "cagr", "sharpe", "sortino", "volatility", "omega", "tail_ratio", "var", "mdd", "mdd_pct", "stability", "qr", "calmar")


@R.query(
    "portfolio_stats",
    f"with {_EQ}, e as (select symbol, ts, pnl, coalesce((pnl - lag(pnl) {_w})) / nullif(10000 + lag(pnl) {_w}), 0), 0) as r from eq), x as (select *, exp(sum(ln(1 + r)) {_w})) as c, sum(ln(1 + r)) {_w}) as lc, row_number() {_w})::double as i, count(*) over (partition by symbol) as n, max(pnl) {_w}) - pnl as dd from e), "
    f"y as (select *, c / greatest(max(c) {_w}), 1) - 1 as d, 2 * (i - 1) / (n - 1) - 1 as j from x), "
    "a as (select symbol, count(*) as days, 10000 + arg_max(pnl, ts) as equity, power(product(1 + r), 252.0 / count(*)) - 1 as cagr, avg(r) / stddev_samp(r) * sqrt(252) as sharpe, 252 * avg(r) / (sqrt(avg(power(least(r, 0), 2))) * sqrt(252)) as sortino, stddev_samp(r) * sqrt(252) as volatility, "
    "sum(greatest(r, 0)) / sum(greatest(-r, 0)) as omega, abs(quantile_cont(r, 0.95)) / abs(quantile_cont(r, 0.05)) as tail_ratio, 10000 - 10000 * (avg(r) + stddev_pop(r) * -1.6448536269514722 + 1) as var, max(dd) as mdd, min(d) as mdd_pct, regr_r2(lc, i) as stability, regr_r2(pnl, j) * regr_slope(pnl, j) / sqrt(regr_syy(pnl, j) / count(*) * (1 - regr_r2(pnl, j))) as qr from y group by 1), "
    "b as (select *, case when mdd_pct < 0 then cagr / abs(mdd_pct) end as calmar from a) select symbol, days, " + ", ".join(f"round({c}, 5) as {c}" for c in _STATS) + " from b",
)
def _(t):
    x = P.stats(P.portfolio_returns(_equity(t), 10000.0), 10000.0)
    return x.select("symbol", "days", *[F.round(c, 5).alias(c) for c in _STATS])


_LOG = """lg as (select distinct run, log_id, date, etceth_pnl, etceth_commissions from portfolio_log)"""


@R.query("net_pnl_by_month", f"with {_LOG} select run as symbol, date_trunc('month', date)::timestamp as ts, round(sum(coalesce(case when not isnan(etceth_pnl) then etceth_pnl end, 0) - coalesce(case when not isnan(etceth_commissions) then etceth_commissions end, 0)), 6) as pnl from lg group by 1, 2")
def _(t):
    x = t.portfolio_log.select(F.col("run").alias("symbol"), "log_id", F.col("date").alias("ts"), F.nanvl("etceth_pnl", F.lit(None)).alias("pnl"), F.nanvl("etceth_commissions", F.lit(None)).alias("commissions")).dropDuplicates(["symbol", "log_id"])
    return _q(P.net_pnl(x, "month"), "symbol", "ts", ("pnl", 6))


@R.query("split_cumulative", f"with {_EQ} select symbol, ts, round(pnl - coalesce(lag(pnl) {_w}), 0), 6) as pnl from eq")
def _(t):
    return _q(P.per_row(_equity(t), "pnl"), "symbol", "ts", ("pnl", 6))


@R.query("total_pnl", f"with {_EQ} select ts, round(sum(pnl), 6) as pnl, round(sum(0.5::double), 6) as commissions from eq group by 1")
def _(t):
    return _q(P.totals(_equity(t).withColumn("commissions", F.lit(0.5))), "ts", ("pnl", 6), ("commissions", 6))


# executions --------------------------------------------------------------------------------------------------------

_EX = "ex as (select event_type as symbol, ts, event_id as seq, (user_id % 5 - 2)::double as quantity, value as price, user_id % 2 = 0 as crossed, event_type = 'view' as is_futures from events where user_id % 5 <> 2)"


def _executions(t):
    x = t.events.filter("user_id % 5 <> 2")
    return x.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), (F.col("user_id") % 5 - 2).cast("double").alias("quantity"), F.col("value").alias("price"), (F.col("user_id") % 2 == 0).alias("crossed"), (F.col("event_type") == "view").alias("is_futures"))


@R.query(
    "pnl_identity",
    f"with {BARS}, {_EX}, c as (select symbol, ts, sum(quantity) {_w}) as q, sum(quantity * price) {_w}) as c from ex), m as (select b.symbol, b.ts, b.close - 0.5 as bid, b.close + 0.5 as ask, coalesce(q, 0) as pos, c from bars b asof left join c on b.symbol = c.symbol and b.ts >= c.ts) "
    "select symbol, ts, pos, round(pos * case when pos > 0 then bid else ask end, 6) as value, round(coalesce(pos * case when pos > 0 then bid else ask end - c, 0), 6) as pnl from m",
)
def _(t):
    m = bars(t).select("symbol", "ts", (F.col("close") - 0.5).alias("bid"), (F.col("close") + 0.5).alias("ask"))
    return _q(P.linear_pnl(_executions(t), m), "symbol", "ts", "pos", ("value", 6), ("pnl", 6))


_TR = """x as (select symbol, ts, seq, quantity as q, price, round(sum(quantity) over (partition by symbol order by ts, seq), 9) as pos from ex where quantity <> 0), y as (select *, coalesce(lag(pos) over (partition by symbol order by ts, seq), 0) as b from x),
z as (select *, case when b * q < 0 then least(abs(b), abs(q)) * sign(q) else 0 end as cl from y),
p as (select symbol, ts, seq, price, 0 as k, cl as dq, sign(b) as side from z where abs(cl) > 1e-12 union all select symbol, ts, seq, price, 1, q - cl, sign(q) from z where abs(q - cl) > 1e-12),
s as (select *, sum(dq) over (partition by symbol order by ts, seq, k) as p from p), n as (select *, sum(case when k = 1 and abs(p - dq) < 1e-9 then 1 else 0 end) over (partition by symbol order by ts, seq, k) as trade from s),
tr as (select symbol, trade::bigint as trade, min(ts) as entry, case when max((abs(p) < 1e-9)::int) = 1 then max(ts) end as exit, max(side)::int as direction, sum(case when k = 1 then abs(dq) else 0 end) as quantity, case when max((abs(p) < 1e-9)::int) = 1 then -sum(dq * price) end as pnl from n group by 1, 2)"""
_TRADES = f"{_EX}, {_TR}"
_HOURLY = _EX.replace("ts, event_id", "date_trunc('hour', ts)::timestamp as ts, event_id")


@R.query("trades_from_executions", f"with {_TRADES} select symbol, trade, entry, exit, direction, quantity, round(pnl, 6) as pnl from tr")
def _(t):
    return _q(P.trades(_executions(t)), "symbol", "trade", "entry", "exit", "direction", "quantity", ("pnl", 6))


@R.query("trades_at_equal_times", f"with {_HOURLY}, {_TR} select symbol, trade, entry, exit, direction, quantity, round(pnl, 6) as pnl from tr")
def _(t):
    """The executions of an hour at one time, so that many net to nothing."""
    x = _executions(t).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return _q(P.trades(x), "symbol", "trade", "entry", "exit", "direction", "quantity", ("pnl", 6))


@R.query(
    "trade_excursions",
    f"with {BARS}, {_TRADES} select tr.symbol, trade, direction, case when direction > 0 then max(high) else min(low) end as favourable, case when direction > 0 then min(low) else max(high) end as adverse, count(*) as bars from tr join bars b on b.symbol = tr.symbol and b.ts between entry and exit group by 1, 2, 3",
)
def _(t):
    return P.excursions(P.trades(_executions(t)), bars(t))


_RATES = "rates as (select * from (values ('click', 0.001, 0.0005), ('view', 0.0004, 0.0002), ('error', 0.002, 0.002)) as v(symbol, taker, maker))"


@R.query("execution_costs", f"with {_EX}, {_RATES} select seq, round(abs(case when is_futures then quantity else quantity * price end) * case when crossed then taker else maker end, 9) as cost from ex left join rates using (symbol)")
def _(t):
    rates = t.spark.createDataFrame([("click", 0.001, 0.0005), ("view", 0.0004, 0.0002), ("error", 0.002, 0.002)], "symbol string, taker double, maker double")
    return P.costs(_executions(t), rates, ["symbol"]).select("seq", F.round("cost", 9).alias("cost"))


_TIERS = [("house", "low", 0.0, 0.001, 0.0008, False), ("house", "middle", 1500.0, 0.0007, 0.0005, False), ("house", "high", 15000.0, 0.0004, -0.0001, False), ("each", "one", 0.0, 0.01, 0.01, True)]
_TIER_SQL = "tiers as (select * from (values " + ", ".join(f"('{c}', '{n}', {v}::double, {a}::double, {b}::double, {q})" for c, n, v, a, b, q in _TIERS) + ") as v(calculator, level, least, taker, maker, of_quantity))"


@R.query(
    "tiered_costs",
    f"with {_EX}, {_TIER_SQL}, d as (select date_trunc('day', ts) as d, sum(abs(quantity * price)) as v from ex group by 1), x as (select ex.*, coalesce(v, 0) as v from ex left join d on date_trunc('day', ex.ts) = d.d + interval 1 day), "
    "r as (select seq, v, max(least) as least from x join tiers on calculator = 'house' and least <= v group by 1, 2), o as (select taker from tiers where calculator = 'each') "
    "select x.seq, round(abs(quantity * price) * case when crossed then t.taker else t.maker end, 9) as cost, round(abs(quantity) * o.taker, 9) as each from x join r using (seq) join tiers t on t.calculator = 'house' and t.least = r.least, o",
)
def _(t):
    rates = t.spark.createDataFrame(_TIERS, "calculator string, level string, least_volume double, taker double, maker double, of_quantity boolean")
    x = P.tiered_costs(_executions(t), rates, "house", period="day").withColumnRenamed("cost", "house")
    x = P.tiered_costs(x, rates, "each", "one", period="day")
    return x.select("seq", F.round("house", 9).alias("cost"), F.round("cost", 9).alias("each"))


@R.query("traded_volume", f"with {_EX} select symbol, date_trunc('day', ts)::timestamp as ts, round(sum(case when crossed then abs(quantity * price) else 0 end), 6) as market, round(sum(case when not crossed then abs(quantity * price) else 0 end), 6) as limit from ex group by 1, 2".replace(" as limit", ' as "limit"'))
def _(t):
    return _q(P.traded_volume(_executions(t), "day"), "symbol", "ts", ("market", 6), ("limit", 6))


@R.query("sampled_log", f"with {_EX}, p as (select symbol, ts, seq, sum(quantity) {_w}) as pos from ex) select symbol, time_bucket(interval 1 hour, ts) as ts, arg_max(pos, ts) as pos from p group by 1, 2")
def _(t):
    x = _executions(t).select("symbol", "ts", "seq", F.sum("quantity").over(by_symbol()).alias("pos"))
    return P.sampled(x, 3600, ["pos"])


@R.query("average_trades", f"with {_EX}, p as (select symbol, ts, sum(quantity) {_w}) as pos from ex), n as (select symbol, date_trunc('week', ts) as m, count(*) filter (pos <> 0) as n from p group by 1, 2), s as (select m, sum(n) as n from n group by 1) select round(avg(n), 6) as trades from s")
def _(t):
    x = _executions(t).select("symbol", "ts", F.sum("quantity").over(by_symbol()).alias("pos"))
    n = x.groupBy("symbol", F.date_trunc("week", "ts").alias("m")).agg(F.count_if(F.col("pos") != 0).alias("n")).groupBy("m").agg(F.sum("n").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("trades"))


@R.query("trades_by_hour", f"with {_TRADES} select coalesce(hour(entry)::varchar, 'Total') as hour, count(*) as trades, sum((direction > 0)::int)::bigint as long, round(sum(pnl), 6) as pnl, round(quantile_cont(pnl, 0.5), 6) as median from tr where exit is not null group by rollup (hour(entry))")
def _(t):
    x = P.trades(_executions(t)).filter("exit is not null").rollup(F.hour("entry").alias("h"))
    x = x.agg(F.count(F.lit(1)).alias("trades"), F.sum((F.col("direction") > 0).cast("bigint")).alias("long"), F.round(F.sum("pnl"), 6).alias("pnl"), F.round(F.percentile("pnl", F.lit(0.5)), 6).alias("median"))
    return x.select(F.coalesce(F.col("h").cast("string"), F.lit("Total")).alias("hour"), "trades", "long", "pnl", "median")


# signals -----------------------------------------------------------------------------------------------------------

_MA = "with {b}, m as (select symbol, ts, close, case when count(close) {w} rows {f1} preceding) = {f} then avg(close) {w} rows {f1} preceding) end as f, case when count(close) {w} rows {s1} preceding) = {s} then avg(close) {w} rows {s1} preceding) end as s from {src}), l as (select *, lag(f) {w}) as f1, lag(s) {w}) as s1 from m), {n} as (select symbol, ts, case when f > s and f1 <= s1 then 1.0::double when f < s and f1 >= s1 then -1.0::double end as target from l where (f > s and f1 <= s1) or (f < s and f1 >= s1))"


def _ma(n: str, f: int, s: int, b: str = BARS, src: str = "bars") -> str:
    return _MA.format(b=b, w=_w, f=f, f1=f - 1, s=s, s1=s - 1, n=n, src=src)


@R.query("crossing_means", _ma("sig", 5, 20) + " select * from sig")
def _(t):
    return G.crossing_means(bars(t), 5, 20)


FLAGSHIP = (
    _ma("sg", 5, 10, DAYS, "days")
    + f", ex as (select g.symbol, g.ts, target, e.value as px from (select symbol, ts + interval 1 day as ts, target from sg) g asof join events e on g.symbol = e.event_type and g.ts > e.ts), tr as (select *, target - coalesce(lag(target) {_w}), 0) as dq from ex), "
    "mk as (select event_type as symbol, arg_max(value, ts) as last_px from events group by 1) select tr.symbol, count(*) as n_exec, arg_max(target, ts) as final_pos, round(arg_max(target, ts) * max(last_px) - sum(dq * px), 6) as pnl from tr join mk on tr.symbol = mk.symbol group by 1"
)


@R.query("flagship_cross_pnl", FLAGSHIP)
def flagship(t):
    sig = G.shifted(G.crossing_means(days(t), 5, 10), "1 day")
    quotes = t.events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))
    ex = G.executed(sig, quotes)
    mark = quotes.groupBy("symbol").agg(F.max_by("price", "ts").alias("last_px"))
    a = ex.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_exec"), F.max_by("target", "ts").alias("final_pos"), F.sum(F.col("quantity") * F.col("price")).alias("_c"))
    return a.join(mark, "symbol").select("symbol", "n_exec", "final_pos", F.round(F.col("final_pos") * F.col("last_px") - F.col("_c"), 6).alias("pnl"))


_BRK = f"bo as (select * from (select symbol, ts, case when count(close) {_w} rows between 12 preceding and 1 preceding) = 12 then case when close > max(high) {_w} rows between 12 preceding and 1 preceding) then 1.0::double when close < min(low) {_w} rows between 12 preceding and 1 preceding) then -1.0::double end end as target from bars) where target is not null)"


@R.query("range_breakout", f"with {BARS}, {_BRK} select * from bo")
def _(t):
    return G.range_breakout(bars(t), 12)


@R.query("bar_strength", f"with {BARS}, s as (select symbol, ts, (close - low) / nullif(high - low, 0) as s from bars) select symbol, ts, case when s > 0.9 then -1.0::double else 1.0::double end as target from s where s > 0.9 or s < 0.1")
def _(t):
    return G.bar_strength(bars(t))


@R.query("level_crossing", f"with {BARS}, l as (select symbol, ts, close, lag(close) {_w}) as p from bars) select symbol, ts, case when close < 100 and p >= 100 then -1.0::double else 1.0::double end as target from l where (close < 100 and p >= 100) or (close > 20 and p <= 20)")
def _(t):
    return G.level_crossing(bars(t), "close", 100.0, 20.0)


_TWO = _ma("sig", 5, 20) + f", {_BRK}"


def _two(t):
    return G.crossing_means(bars(t), 5, 20), G.range_breakout(bars(t), 12)


@R.query("imply_signals", _TWO + f", u as (select b.symbol, b.ts, sig.target as f, bo.target as target from bars b left join sig using (symbol, ts) left join bo using (symbol, ts)), c as (select symbol, ts, target, last_value(f ignore nulls) {_w} rows 10 preceding) as f from u) select symbol, ts, target from c where f = target")
def _(t):
    return G.imply(*_two(t), bars(t), memory=10)


@R.query("filter_signals", _TWO + f", sw as (select symbol, ts, volume > 3 as st from bars where volume <> 2), u as (select coalesce(s.symbol, w.symbol) as symbol, coalesce(s.ts, w.ts) as ts, target, st from sig s full join sw w on s.symbol = w.symbol and s.ts = w.ts), c as (select symbol, ts, target, last_value(st ignore nulls) {_w} rows unbounded preceding) as st from u) select symbol, ts, target from c where st and target is not null")
def _(t):
    sw = bars(t).filter("volume <> 2").select("symbol", "ts", (F.col("volume") > 3).alias("on"))
    return G.where_on(_two(t)[0], sw)


@R.query("join_signals", _TWO + " select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.ts, b.ts) as ts, coalesce(b.target, a.target) as target from sig a full join bo b on a.symbol = b.symbol and a.ts = b.ts")
def _(t):
    return G.both(*_two(t))


@R.query("multiply_signals", _TWO + " select symbol, ts, a.target * b.target as target from sig a join bo b using (symbol, ts)")
def _(t):
    return G.times(*_two(t))


@R.query("either_switch", f"with {BARS}, a as (select symbol, ts, volume > 4 as st from bars where volume <> 1), b as (select symbol, ts, close > 60 as st from bars where volume <> 2) select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.ts, b.ts) as ts, coalesce(a.st, false) or coalesce(b.st, false) as flag from a full join b on a.symbol = b.symbol and a.ts = b.ts")
def _(t):
    b = bars(t)
    return G.either(b.filter("volume <> 1").select("symbol", "ts", (F.col("volume") > 4).alias("on")), b.filter("volume <> 2").select("symbol", "ts", (F.col("close") > 60).alias("on"))).withColumnRenamed("on", "flag")


@R.query("negate_shift", _ma("sig", 5, 20) + " select symbol, ts + interval 3599 second as ts, -target as target from sig")
def _(t):
    return G.shifted(G.negated(G.crossing_means(bars(t), 5, 20)), "3599 seconds")


_FWD = _ma("sig", 5, 20) + ", z as (select symbol, max(ts) as z from bars group by 1), p as (select symbol, ts, close, ts + interval 6 hour as at from bars join z using (symbol) where ts <= z - interval 6 hour), f as (select p.symbol, p.ts, p.close, b.close as later from p asof join bars b on p.symbol = b.symbol and p.at >= b.ts)"


@R.query("forward_direction_score", _FWD + " select symbol, round(avg((sign(later - close) = sign(target))::int), 6) as score, count(*) as n from sig join f using (symbol, ts) group by 1")
def _(t):
    p = bars(t).select("symbol", "ts", F.col("close").alias("price"))
    return _q(G.direction_score(G.crossing_means(bars(t), 5, 20), p, "6 hours"), "symbol", ("score", 6), "n")


@R.query("forward_sharpe", _FWD + ", x as (select symbol, (later / close - 1) * target - 0.0004 * abs(target) as r from sig join f using (symbol, ts)) select symbol, round(avg(r) / stddev_pop(r), 6) as score, count(r) as n from x group by 1")
def _(t):
    p = bars(t).select("symbol", "ts", F.col("close").alias("price"))
    return _q(G.forward_sharpe(G.crossing_means(bars(t), 5, 20), p, "6 hours", 0.0004, relative=True), "symbol", ("score", 6), "n")


@R.query("reversal_sharpe", _ma("sig", 5, 20) + f", g as (select *, lag(target) {_w}) as p from sig), x as (select g.symbol, g.ts, target, close as price from g join bars b on g.symbol = b.symbol and g.ts = b.ts where p is not null and p <> target), y as (select symbol, (lead(price) {_w}) - price) * target as r from x) select symbol, round(avg(r) / stddev_pop(r), 6) as score, count(r) as n from y group by 1")
def _(t):
    p = bars(t).select("symbol", "ts", F.col("close").alias("price"))
    return _q(G.reversal_sharpe(G.crossing_means(bars(t), 5, 20), p), "symbol", ("score", 6), "n")


@R.query("size_by_risk", "select event_id, round(least(10000 * 1.5 / 100 / nullif(abs((value + 3) / value - 1), 0), 5000) / case when event_type = 'view' then 1.0 else value end) as size from events where value > 0")
def _(t):
    x = t.events.filter("value > 0").select("event_id", F.col("value").alias("entry"), (F.col("value") + 3).alias("stop"), (F.col("event_type") == "view").alias("is_futures"))
    return x.select("event_id", G.size_by_risk(10000.0, 1.5, 5000.0).alias("size"))


# statistics --------------------------------------------------------------------------------------------------------

_ALL = ["click", "error", "purchase", "signup", "view"]


@R.query("j_divergence", f"with {BARS}, m as (select symbol, avg(open) as mp, avg(close) as mq, stddev_pop(open) as sp, stddev_pop(close) as sq from bars group by 1) select symbol, round(0.5 * (power(mp - mq, 2) * (1 / sp + 1 / sq) + sq / sp + sp / sq - 2), 9) as divergence from m")
def _(t):
    return _q(T.j_divergence(bars(t), "open", "close"), "symbol", ("divergence", 9))


@R.query(
    "hurst",
    f"with {BARS}, d as (" + " union all ".join(f"select symbol, {k} as k, lead(close, {k}) {_w}) - close as d from bars" for k in range(2, 12)) + "), s as (select symbol, k, stddev_pop(d) as s from d group by 1, 2) select symbol, round(2 * regr_slope(log10(sqrt(s)), log10(k)), 6) as hurst from s group by 1",
)
def _(t):
    return _q(T.hurst(bars(t), "close", 12), "symbol", ("hurst", 6))


for _name, _f, _cols in (
    ("hurst_rescaled", lambda p: dict(zip(("corrected", "raw"), T.hurst_rescaled(p.close), strict=True)), "corrected double, raw double"),
    ("density_mode", lambda p: {"mode": T.density_mode(p.close)}, "mode double"),
    ("dickey_fuller", lambda p: dict(zip(("statistic", "critical"), T.dickey_fuller(p.close), strict=True)), "statistic double, critical double"),
    ("spectrum_rebuild", lambda p: {"error": float(np.abs(T.rebuild(*[T.spectrum(p.close, 10)[k] for k in (0, 2)], range(10)) - p.close.to_numpy()).max()), "count": T.component_count(p.close, 10)}, "error double, count int"),
    ("spectrum_forecast", lambda p: {"ahead": T.forecast(p.close.to_numpy(), 8, [0, 1], 3).tolist()[-3:]}, "ahead array<double>"),
):

    @R.query(_name)
    def _(t, f=_f, cols=_cols):
        return T.per_group(bars(t), ["symbol"], f, cols)


@R.query("johansen")
def _(t):
    wide = days(t).groupBy("ts").pivot("symbol", _ALL).agg(F.max("close")).dropna().withColumn("g", F.lit(1))

    def f(p):
        j = T.johansen(p[_ALL].to_numpy(), 2)
        return {"eigenvalues": j["eigenvalues"].tolist(), "trace": j["trace"].tolist(), "largest": j["largest"].tolist()}

    return T.per_group(wide, ["g"], f, "eigenvalues array<double>, trace array<double>, largest array<double>").drop("g")


@R.query("warp_nearest")
def _(t):
    x = days(t).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("s")).select("symbol", F.col("s.close").alias("v"))
    return T.nearest_of_all(x, 5).select("symbol", "nearest")


for _name, _f in (("weights_tangency", T.tangency), ("weights_least_variance", T.least_variance)):

    @R.query(_name)
    def _(t, f=_f):
        return T.rolling_weights(returns(t).filter("r is not null"), 15, 5, f, _ALL)


@R.query("rolling_regression")
def _(t):
    from ..operators.smoothers import per_symbol

    def f(p):
        b, e, s = T.rolling_fit(p.close.to_numpy(), np.column_stack([p.open, p.volume, np.ones(len(p))]), 30)
        return {"b_open": b[:, 0], "b_volume": b[:, 1], "constant": b[:, 2], "error": e, "deviation": s}

    return per_symbol(bars(t), f, "b_open double, b_volume double, constant double, error double, deviation double")


_POLY = np.linalg.qr(np.vander(np.linspace(-1, 1, 20), 3, increasing=True))[0]
_PARTS = [" + ".join(f"lag(close, {19 - k}) {_w}) * ({_POLY[k, j]:.17g})" for k in range(20)) for j in range(3)]


@R.query(
    "rolling_detrend",
    f"with {BARS}, q as (select symbol, ts, close, row_number() {_w}) as i, {', '.join(f'{x} as q{j}' for j, x in enumerate(_PARTS))}, sum(close * close) {_w} rows 19 preceding) as yy, sum(close) {_w} rows 19 preceding) as y from bars) "
    f"select symbol, ts, case when i >= 20 then round(close - ({' + '.join(f'q{j} * ({_POLY[19, j]:.17g})' for j in range(3))}), 6) end as residual, case when i >= 20 then round(1 - (yy - q0 * q0 - q1 * q1 - q2 * q2) / (yy - y * y / 20), 6) end as r2 from q",
)
def _(t):
    from ..operators.smoothers import per_symbol

    x = per_symbol(bars(t), lambda p: dict(zip(("residual", "r2"), T.rolling_detrend(p.close.to_numpy(), 2, 20), strict=True)), "residual double, r2 double")
    return x.withColumns({c: F.round(c, 6) for c in ("residual", "r2")})


@R.query("weights_inverse_drawdown", f"with {_EQ}, d as (select symbol, max(dd) as dd from (select symbol, max(pnl) {_w}) - pnl as dd from eq) group by 1) select symbol, round((sum(dd) over () - dd) / ((count(*) over () - 1) * sum(dd) over ()), 9) as weight from d")
def _(t):
    d = P.with_drawdown(_equity(t), "pnl").groupBy("symbol").agg(F.max("dd").alias("dd"))
    tot = d.agg(F.sum("dd").alias("_t"), F.count(F.lit(1)).alias("_n"))
    return with_totals(d, tot).select("symbol", F.round((F.col("_t") - F.col("dd")) / ((F.col("_n") - 1) * F.col("_t")), 9).alias("weight"))
