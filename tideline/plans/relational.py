"""Queries of scans, resampling, joins, frames, runs and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import by_symbol, small, so_far, trailing
from ..operators import joins, resample, rolling
from .base import BARS, DAYS, RETURNS, bars, days, returns
from .registry import Registry

R = Registry()
_w = "over (partition by symbol order by ts"


@R.query("resample_ohlcv", f"with {BARS} select symbol, ts, open, high, low, close, volume from bars")
def _(t):
    return bars(t)


@R.query("rebar_4h", f"with {BARS} select symbol, time_bucket(interval 4 hour, ts) as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume) as volume from bars group by 1, 2")
def _(t):
    return resample.rebar(bars(t), "4 hours")


@R.query(
    "resample_tz",
    "select event_type as symbol, time_bucket(interval 1 day, ts + interval 9 hour) - interval 9 hour as ts, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close, count(*)::double as volume from events group by 1, 2",
)
def _(t):
    return resample.bars(t.events, "event_type", "ts", F.col("value"), "1 day", "event_id", tz="Asia/Tokyo")


_MID = """m as (select distinct symbol, time, quote_id, case when isnan(bid) then null else bid end as b, case when isnan(ask) then null else ask end as a, coalesce(bidvol, 0) as bv, coalesce(askvol, 0) as av from quotes),
v as (select symbol, time, quote_id, {} as v from m), qb as (select symbol, time_bucket(interval 1 hour, time) as ts, arg_min(v, time) as open, max(v) as high, min(v) as low, arg_max(v, time) as close, count(*)::double as volume from v where v is not null group by 1, 2)"""


@R.query("quote_bars_mid", f"with {_MID.format('(b + a) / 2')} select symbol, ts, round(open, 9) as open, round(high, 9) as high, round(low, 9) as low, round(close, 9) as close, volume from qb")
def _(t):
    return resample.quote_bars(t.quotes, "1 hour").select("symbol", "ts", *[F.round(c, 9).alias(c) for c in ("open", "high", "low", "close")], "volume")


@R.query("quote_bars_weighted", f"with {_MID.format('case when bv + av > 0 then (b * av + a * bv) / (bv + av) else (b + a) / 2 end')} select symbol, ts, round(open, 6) as open, round(close, 6) as close from qb")
def _(t):
    return resample.quote_bars(t.quotes, "1 hour", weighted=True).select("symbol", "ts", *[F.round(c, 6).alias(c) for c in ("open", "close")])


@R.query(
    "gap_fill",
    f"""with {BARS}, s as (select symbol, min(ts) as a, max(ts) as z from bars group by 1), g as (select symbol, unnest(generate_series(a, z, interval 1 hour)) as ts from s),
x as (select g.symbol, g.ts, close, volume from g left join bars using (symbol, ts)) select symbol, ts, last_value(close ignore nulls) {_w} rows unbounded preceding) as close, volume from x""",
)
def _(t):
    return resample.fill_gaps(bars(t), "1 hour").select("symbol", "ts", "close", "volume")


@R.query("modal_step", f"with {BARS}, d as (select symbol, epoch_us(ts) - epoch_us(lag(ts) {_w})) as d from bars), n as (select symbol, d, count(*) as n from d where d is not null group by 1, 2) select symbol, arg_max(d, n * 1000000000000 - d / 1000000) as step_us from n group by 1")
def _(t):
    return resample.modal_step(bars(t))


@R.query(
    "gap_report",
    f"""with {BARS}, d as (select symbol, epoch_us(ts) - epoch_us(lag(ts) {_w})) as d from bars), n as (select symbol, d, count(*) as n from d where d is not null group by 1, 2),
m as (select symbol, arg_max(d, n * 1000000000000 - d / 1000000) as s from n group by 1) select symbol, count(*) as gaps, max(d) as longest_us from d join m using (symbol) where d <> s group by 1""",
)
def _(t):
    return resample.gap_report(bars(t))


@R.query("compound_monthly", f"with {RETURNS} select symbol, date_trunc('month', ts)::timestamp as period, round(product(1 + coalesce(r, 0)) - 1, 6) as ret from rets group by 1, 2")
def _(t):
    return resample.compound(returns(t), "month").withColumn("ret", F.round("ret", 6))


@R.query("compound_weekly", f"with {RETURNS} select symbol, date_trunc('week', ts)::timestamp as period, round(product(1 + coalesce(r, 0)) - 1, 6) as ret from rets group by 1, 2")
def _(t):
    return resample.compound(returns(t), "week").withColumn("ret", F.round("ret", 6))


@R.query("intraday_min_max", f"with {BARS} select symbol, ts, min(low) over (partition by symbol, (ts + interval 9 hour)::date order by ts rows unbounded preceding) as day_low, max(high) over (partition by symbol, (ts + interval 9 hour)::date order by ts rows unbounded preceding) as day_high from bars")
def _(t):
    return resample.running_range(bars(t), "Asia/Tokyo").select("symbol", "ts", "day_low", "day_high")


@R.query(
    "walk_forward_folds",
    f"""with {DAYS}, s as (select min(ts)::date as a, max(ts)::date as z from days), f as (select a, z, unnest(generate_series(0, (z - a - 10) // 5)) as fold from s)
select symbol, ts, fold::int as fold, case when ts::date - a < fold * 5 + 10 then 'train' else 'test' end as part from days, f where ts::date - a >= fold * 5 and ts::date - a < fold * 5 + 15""",
)
def _(t):
    return resample.walk_forward(days(t), 10, 5).select("symbol", "ts", "fold", "part")


@R.query(
    "session_windows",
    """with d as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as n from events),
g as (select user_id, ts, sum(n) over (partition by user_id order by ts) as g from d) select user_id, min(ts) as start, count(*) as rows from g group by user_id, g""",
)
def _(t):
    return resample.session_windows(t.events, "user_id", "ts", "2 hours")


# joins -------------------------------------------------------------------------------------------------------------

_LR = "l as (select event_id, event_type, ts from events where user_id % 2 = 0), r as (select event_type, ts, value from events where user_id % 2 = 1)"


def _sides(t):
    return t.events.filter("user_id % 2 = 0").select("event_id", "event_type", "ts"), t.events.filter("user_id % 2 = 1").select("event_type", "ts", "value")


for _name, _op, _kw in (("asof_backward", ">=", {}), ("asof_strict", ">", {"strict": True}), ("asof_forward", "<=", {"direction": "forward"}), ("asof_forward_strict", "<", {"direction": "forward", "strict": True})):

    @R.query(_name, f"with {_LR} select l.event_id, l.event_type, l.ts, r.value, r.ts as right_ts from l asof left join r on l.event_type = r.event_type and l.ts {_op} r.ts")
    def _(t, kw=_kw):
        return joins.asof_join(*_sides(t), ["event_type"], "ts", ["value"], **kw)


@R.query("asof_tolerance", f"with {_LR}, x as (select l.event_id, l.ts, r.value, r.ts as right_ts from l asof left join r on l.event_type = r.event_type and l.ts >= r.ts) select event_id, case when ts - right_ts <= interval 10 minute then value end as value from x")
def _(t):
    return joins.asof_join(*_sides(t), ["event_type"], "ts", ["value"], tolerance_us=600_000_000).select("event_id", "value")


@R.query(
    "asof_fills_to_quotes",
    r"""with n as (select upper(symbol) as n, symbol as s from instruments union select upper(instrument), symbol from instruments), f as (select distinct fill_id, s as symbol, time from fills join n on upper(regexp_replace(instrument, '^\s+|\s+$', '', 'g')) = n),
q as (select distinct symbol, time, quote_id, case when isnan(bid) then null else bid end as bid from quotes) select f.fill_id, q.quote_id, q.bid from f asof left join q on f.symbol = q.symbol and f.time > q.time""",
)
def _(t):
    from ..operators.nearest import plain, symbol_names

    f = t.fills.withColumn("_n", plain(F.col("instrument"))).join(small(symbol_names(t.instruments)), F.col("_n") == F.col("_name")).select("fill_id", F.col("_symbol").alias("symbol"), "time").distinct()
    q = t.quotes.select("symbol", "time", "quote_id", F.nanvl("bid", F.lit(None).cast("double")).alias("bid")).distinct()
    return joins.asof_join(f, q, ["symbol"], "time", ["quote_id", "bid"], strict=True, seq="quote_id").select("fill_id", "quote_id", "bid")


for _name, _sign, _lim, _out, _back in (("forward_values", "+", "ts <= z - interval 6 hour", "later", False), ("backward_values", "-", "ts >= a + interval 6 hour", "earlier", True)):

    @R.query(
        _name,
        f"""with {BARS}, s as (select symbol, min(ts) as a, max(ts) as z from bars group by 1), p as (select symbol, ts, close, ts {_sign} interval 6 hour as at from bars join s using (symbol) where {_lim})
select p.symbol, p.ts, p.close, b.close as {_out} from p asof left join bars b on p.symbol = b.symbol and p.at >= b.ts""",
    )
    def _(t, back=_back):
        return joins.forward_values(bars(t), "symbol", "ts", "close", "6 hours", back=back)


@R.query("outer_align", f"with {BARS} select ts, max(case when symbol = 'click' then close end) as a, max(case when symbol = 'view' then close end) as b from bars where symbol in ('click', 'view') group by 1")
def _(t):
    b = bars(t)
    return joins.align({"a": b.filter("symbol = 'click'"), "b": b.filter("symbol = 'view'")}, ["ts"], "close")


@R.query("inner_align", f"with {BARS} select a.ts, a.close as a, b.close as b from bars a join bars b on a.ts = b.ts where a.symbol = 'click' and b.symbol = 'view'")
def _(t):
    b = bars(t)
    return b.filter("symbol = 'click'").select("ts", F.col("close").alias("a")).join(b.filter("symbol = 'view'").select("ts", F.col("close").alias("b")), "ts")


@R.query("pivot_close", f"with {BARS} select ts, " + ", ".join(f"max(case when symbol = '{s}' then close end) as {s}" for s in ("click", "error", "purchase", "signup", "view")) + " from bars group by 1")
def _(t):
    return bars(t).groupBy("ts").pivot("symbol", ["click", "error", "purchase", "signup", "view"]).agg(F.max("close"))


@R.query(
    "range_join_trades",
    f"""with {BARS}, d as (select symbol, ts, close, row_number() {_w}) as i from bars), tr as (select symbol, i as trade, ts as entry, ts + interval 9 hour as exit from d)
select tr.symbol, trade, count(*) as n, max(high) as best, min(low) as worst from tr join bars b on tr.symbol = b.symbol and b.ts between tr.entry and tr.exit group by 1, 2""",
)
def _(t):
    b = bars(t)
    d = b.withColumn("trade", F.row_number().over(by_symbol()).cast("bigint"))
    tr = d.select("symbol", "trade", F.col("ts").alias("entry"), (F.col("ts") + F.expr("interval 9 hours")).alias("exit"))
    return joins.range_join(tr, b, "symbol", "entry", "exit", "ts").groupBy("symbol", "trade").agg(F.count(F.lit(1)).alias("n"), F.max("high").alias("best"), F.min("low").alias("worst"))


_NEAR = f"with {BARS}, i as (select *, row_number() {_w}) as i from bars), p as (select symbol, i from i where high > 150)"


@R.query("semi_neighbourhood", f"{_NEAR} select symbol, ts, close from i where exists (select 1 from p where p.symbol = i.symbol and p.i between i.i - 1 and i.i + 2)")
def _(t):
    b = bars(t)
    return joins.near_points(b, b.filter("high > 150"), "symbol", "ts", 2, 1).select("symbol", "ts", "close")


@R.query("anti_neighbourhood", f"{_NEAR} select symbol, ts, close from i where not exists (select 1 from p where p.symbol = i.symbol and p.i between i.i - 1 and i.i + 2)")
def _(t):
    b = bars(t)
    return joins.near_points(b, b.filter("high > 150"), "symbol", "ts", 2, 1, inside=False).select("symbol", "ts", "close")


@R.query("flat_prices", f"with {BARS} select symbol, ts, open as price from bars union all select symbol, ts + interval 3599 second, close from bars")
def _(t):
    return joins.flat_prices(bars(t), "1 hour")


@R.query("density", "with n as (select event_type as symbol, date_trunc('day', ts) as d, count(*) as n from events group by 1, 2) select symbol, round(avg(n), 9) as density from n group by 1")
def _(t):
    return joins.density(t.events.withColumnRenamed("event_type", "symbol"), "ts", "day").withColumn("density", F.round("density", 9))


_PF = """p as (select user_id % 7 as u, event_type as symbol, date_trunc('day', ts)::timestamp as ts, sum(value) as pnl, count(*)::double as pos, max(value) as price from events group by 1, 2, 3)"""


def _portfolio(t, k):
    x = t.events.filter(f"pmod(user_id, 7) = {k}").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
    return x.agg(F.count(F.lit(1)).cast("double").alias("pos"), F.sum("value").alias("pnl"), F.max("value").alias("price"), F.sum("value").alias("value"), (F.count(F.lit(1)) * 0.1).alias("commissions"))


@R.query("combine_portfolios", f"with {_PF} select symbol, ts, sum(pos) as pos, round(sum(pnl), 6) as pnl, round(avg(price), 6) as price, round(sum(pnl), 6) as value, round(sum(pos * 0.1), 6) as commissions from p group by 1, 2")
def _(t):
    x = joins.combine_portfolios(*[_portfolio(t, k) for k in range(7)])
    return x.select("symbol", "ts", "pos", *[F.round(c, 6).alias(c) for c in ("pnl", "price", "value", "commissions")])


@R.query("pick_symbols", "select event_id, event_type, case when regexp_matches(event_type, '^pur') then 0 when regexp_matches(event_type, 'c') then 1 when regexp_matches(event_type, '^v.*w$') then 2 end as rule from events where regexp_matches(event_type, '^pur|c|^v.*w$')")
def _(t):
    return joins.first_match(t.events, "event_type", ["^pur", "c", "^v.*w$"]).select("event_id", "event_type", "rule")


# frames ------------------------------------------------------------------------------------------------------------

def _frame(name: str, sql: str, **columns):
    """A query that adds columns over the hourly bars, rounded to 6 digits."""

    @R.query(name, f"with {BARS}, x as (select symbol, ts, {sql} from bars) select symbol, ts, " + ", ".join(f"round({c}, 6) as {c}" for c in columns) + " from x")
    def _(t):
        return bars(t).select("symbol", "ts", *[F.round(f(), 6).alias(c) for c, f in columns.items()])


def _sql_full(n: int, expr: str) -> str:
    return f"case when count(close) {_w} rows {n - 1} preceding) = {n} then {expr} end"


c = F.col
_frame("lag_lead_shift", f"lag(close, 2) {_w}) as back, lead(close, 3) {_w}) as ahead", back=lambda: F.lag("close", 2).over(by_symbol()), ahead=lambda: F.lead("close", 3).over(by_symbol()))
_frame("rolling_sum", f"case when row_number() {_w}) >= 5 then sum(coalesce(close, 0)) {_w} rows 4 preceding) end as s", s=lambda: rolling.rolling_sum(c("close"), by_symbol(), 5))
_frame("sma", f"{_sql_full(10, f'avg(close) {_w} rows 9 preceding)')} as m", m=lambda: rolling.sma(c("close"), by_symbol(), 10))
_frame("wma", "(" + " + ".join(f"lag(close, {4 - k}) {_w}) * {k + 1} / 15.0" for k in range(5)) + ") as m", m=lambda: rolling.wma(c("close"), by_symbol(), 5))
_frame("stdev_roll", f"{_sql_full(12, f'stddev_pop(close) {_w} rows 11 preceding)')} as s", s=lambda: rolling.stdev(c("close"), by_symbol(), 12))
_frame("vwap_roll", f"sum(close * volume) {_w} rows 7 preceding) / sum(volume) {_w} rows 7 preceding) as v", v=lambda: rolling.vwap(c("close"), c("volume"), by_symbol(), 8))
_frame("min_max_roll", f"max(high) {_w} rows 19 preceding) as hi, min(low) {_w} rows 19 preceding) as lo", hi=lambda: F.max("high").over(trailing(by_symbol(), 20)), lo=lambda: F.min("low").over(trailing(by_symbol(), 20)))
_frame(
    "stochastic",
    f"case when row_number() {_w}) >= 14 and max(high) {_w} rows 13 preceding) > min(low) {_w} rows 13 preceding) then 100 * (close - min(low) {_w} rows 13 preceding)) / (max(high) {_w} rows 13 preceding) - min(low) {_w} rows 13 preceding)) end as k",
    k=lambda: rolling.stochastic(by_symbol(), 14),
)
_frame("rolling_corr", f"case when count(close) {_w} rows 11 preceding) = 12 then covar_pop(close, volume) {_w} rows 11 preceding) / nullif(stddev_pop(close) {_w} rows 11 preceding) * stddev_pop(volume) {_w} rows 11 preceding), 0) end as r", r=lambda: rolling.correlation(c("close"), c("volume"), by_symbol(), 12))
_frame("percent_rank", f"case when row_number() {_w}) >= 20 then len(list_filter(list(close) {_w} rows between 19 preceding and 1 preceding), lambda v: v < close)) * 100.0 / 20 end as p", p=lambda: rolling.percent_rank(c("close"), by_symbol(), 20))


@R.query("rolling_percentile", f"with {BARS} select symbol, ts, " + ", ".join(f"round({_sql_full(20, f'quantile_cont(close, {q}) {_w} rows 19 preceding)')}, 6) as p{int(q * 100)}" for q in (0.05, 0.5, 0.95)) + " from bars")
def _(t):
    x = bars(t).withColumn("p", rolling.percentiles(F.col("close"), by_symbol(), 20, (0.05, 0.5, 0.95)))
    return x.select("symbol", "ts", *[F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("p5", "p50", "p95"))])


@R.query(
    "rolling_rank",
    f"with {BARS}, p as (select symbol, ts, close, count(close) {_w} rows between 20 preceding and 1 preceding) as n, " + ", ".join(f"quantile_cont(close, {q}) {_w} rows between 20 preceding and 1 preceding) as p{int(q * 100)}" for q in (0.25, 0.5, 0.75)) + " from bars) select symbol, ts, case when n = 20 then ((p25 <= close)::int + (p50 <= close)::int + (p75 <= close)::int) end as bucket from p",
)
def _(t):
    return bars(t).select("symbol", "ts", rolling.rank_bucket(F.col("close"), by_symbol(), 20).alias("bucket"))


_IDX = f"with {BARS}, i as (select *, row_number() {_w})::double as i from bars)"


@R.query("rolling_slope_r2", f"{_IDX}, x as (select symbol, ts, {_sql_full(10, f'regr_slope(close, i) {_w} rows 9 preceding)')} as slope, {_sql_full(10, f'regr_r2(close, i) {_w} rows 9 preceding)')} as slope_r2 from i) select symbol, ts, round(slope, 6) as slope, round(slope_r2, 6) as slope_r2 from x")
def _(t):
    return rolling.with_slope(bars(t), "close", by_symbol(), 10).select("symbol", "ts", F.round("slope", 6).alias("slope"), F.round("slope_r2", 6).alias("slope_r2"))


@R.query(
    "rolling_slope_past",
    f"{_IDX}, x as (select symbol, ts, case when count(close) {_w} rows between 10 preceding and 1 preceding) = 10 then regr_slope(close, i) {_w} rows between 10 preceding and 1 preceding) end as slope, case when count(close) {_w} rows between 10 preceding and 1 preceding) = 10 then regr_r2(close, i) {_w} rows between 10 preceding and 1 preceding) end as r2 from i) select symbol, ts, round(slope, 6) as slope, round(exp(-2 * (1 - r2)), 6) as alpha from x",
)
def _(t):
    x = rolling.with_slope(bars(t), "close", by_symbol(), 10, past=True)
    return x.select("symbol", "ts", F.round("slope", 6).alias("slope"), F.round(F.exp(-2 * (1 - F.col("slope_r2"))), 6).alias("alpha"))


@R.query("time_range_count", "select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as n, round(sum(value) over (partition by user_id order by ts range between interval 1 day preceding and current row), 6) as s from events")
def _(t):
    spec = "over (partition by user_id order by ts range between interval 1 day preceding and current row)"
    return t.events.select("event_id", F.expr(f"count(1) {spec}").alias("n"), F.round(F.expr(f"sum(value) {spec}"), 6).alias("s"))


@R.query("streaks", f"with {BARS}, d as (select symbol, ts, coalesce(sign(close - lag(close) {_w})), 0) as s from bars), g as (select *, case when s is distinct from lag(s) {_w}) then 1 else 0 end as n from d), h as (select *, sum(n) {_w}) as g from g) select symbol, ts, (s * row_number() over (partition by symbol, g order by ts))::int as streak from h")
def _(t):
    return rolling.streaks(bars(t), ["symbol"], ["ts"], "close").select("symbol", "ts", "streak")


@R.query(
    "continuous_periods",
    f"with {BARS}, d as (select symbol, ts, close > 50 as s from bars), g as (select *, case when s is distinct from lag(s) {_w}) then 1 else 0 end as n from d), h as (select *, sum(n) {_w}) as g from g) select symbol, min(ts) as start, max(ts) as end, count(*) as rows from h where s group by symbol, g",
)
def _(t):
    return rolling.periods(bars(t), ["symbol"], "ts", F.col("close") > 50)


_beside = [k for k in range(-2, 3) if k]


@R.query(
    "fractals",
    f"with {BARS}, f as (select symbol, ts, case when lag(high, 2) {_w}) is not null and lead(high, 2) {_w}) is not null and high > greatest("
    + ", ".join(f"lag(high, {k}) {_w})" for k in _beside)
    + f") then high end as u, case when lag(high, 2) {_w}) is not null and lead(high, 2) {_w}) is not null and low < least("
    + ", ".join(f"lag(low, {k}) {_w})" for k in _beside)
    + f") then low end as d from bars) select symbol, ts, lag(u, 2) {_w}) as fractal_up, lag(d, 2) {_w}) as fractal_down from f",
)
def _(t):
    return rolling.fractals(bars(t), by_symbol(), 2).select("symbol", "ts", "fractal_up", "fractal_down")


@R.query("crossings", f"with {BARS}, m as (select symbol, ts, close, {_sql_full(5, f'avg(close) {_w} rows 4 preceding)')} as m from bars), x as (select *, lag(close) {_w}) as c1, lag(m) {_w}) as m1 from m) select symbol, ts, case when close > m then 1 else -1 end as side from x where (close > m and c1 <= m1) or (close < m and c1 >= m1)")
def _(t):
    x = bars(t).withColumn("m", rolling.sma(F.col("close"), by_symbol(), 5))
    up, dn = rolling.crossed_up(F.col("close"), F.col("m"), by_symbol()), rolling.crossed_down(F.col("close"), F.col("m"), by_symbol())
    return x.withColumn("side", F.when(up, 1).when(dn, -1)).filter(F.col("side").isNotNull()).select("symbol", "ts", "side")


# order, limits, repeats, sets --------------------------------------------------------------------------------------

@R.query("last_n_rows", f"with {BARS} select symbol, ts, close from (select *, row_number() over (partition by symbol order by ts desc) as n from bars) where n <= 3")
def _(t):
    return rolling.last_rows(bars(t), "symbol", ["ts"], 3).select("symbol", "ts", "close")


@R.query("dedup_first", "select * from (select o_custkey, o_orderdate, min(o_orderkey) as o_orderkey from orders group by 1, 2)")
def _(t):
    return rolling.one_per_time(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderdate", "o_orderkey")


@R.query("dedup_last", "select * from (select o_custkey, o_orderdate, max(o_orderkey) as o_orderkey from orders group by 1, 2)")
def _(t):
    return rolling.one_per_time(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey", keep="last").select("o_custkey", "o_orderdate", "o_orderkey")


@R.query("spread_equal_times", "select o_orderkey, o_orderdate + (row_number() over (partition by o_custkey, o_orderdate order by o_orderkey) - 1) * interval 1 microsecond as ts from orders")
def _(t):
    return rolling.spread_equal_times(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", F.col("o_orderdate").alias("ts"))


@R.query("changes_only", "select quote_id, bid, ask from (select *, row_number() over w as n, lag(b) over w as b1, lag(a) over w as a1 from (select distinct symbol, time, quote_id, bid, ask, coalesce(bid::varchar, '') as b, coalesce(ask::varchar, '') as a from quotes) window w as (partition by symbol order by time, quote_id)) where n = 1 or a <> a1 or b <> b1")
def _(t):
    q = t.quotes.select("symbol", "time", "quote_id", "bid", "ask").distinct()
    return rolling.changes_only(q, "symbol", ["time", "quote_id"], ["bid", "ask"]).select("quote_id", "bid", "ask")


@R.query("topk_customers", "select o_custkey, round(sum(o_totalprice), 2) as total from orders group by 1 order by total desc, o_custkey limit 20")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.col("total").desc(), "o_custkey").limit(20)


@R.query("page", "select event_id, value from events order by value desc, event_id limit 25 offset 50")
def _(t):
    return t.events.select("event_id", "value").orderBy(F.col("value").desc(), "event_id").offset(50).limit(25)


@R.query("union_keep_last", "select user_id, arg_max(value, event_id) as value from (select * from events where event_type = 'click' union all select * from events where event_type = 'view') group by 1")
def _(t):
    e = t.events
    return e.filter("event_type = 'click'").unionByName(e.filter("event_type = 'view'")).groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


@R.query("except_times", f"with {BARS} select ts from bars where symbol = 'click' except select ts from bars where symbol = 'error'")
def _(t):
    b = bars(t)
    return b.filter("symbol = 'click'").select("ts").exceptAll(b.filter("symbol = 'error'").select("ts")).distinct()


@R.query("intersect_users", "select user_id from events where event_type = 'purchase' intersect select user_id from events where event_type = 'error'")
def _(t):
    return t.events.filter("event_type = 'purchase'").select("user_id").intersect(t.events.filter("event_type = 'error'").select("user_id"))


@R.query("report_rollup", "select coalesce(r_name, 'Total') as region, coalesce(n_name, 'Total') as nation, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def _(t):
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    x = x.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return x.select(F.coalesce("r_name", F.lit("Total")).alias("region"), F.coalesce("n_name", F.lit("Total")).alias("nation"), "customers", "balance")


@R.query("pricing_summary", "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def _(t):
    x = t.lineitem.filter(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02 00:00:00'")).groupBy("l_returnflag", "l_linestatus")
    return x.agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@R.query("revenue_by_nation", "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def _(t):
    x = t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return x.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@R.query("json_props", "select (props->>'k')::int as k, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def _(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@R.query("column_moments", f"with {BARS} select symbol, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from bars group by 1")
def _(t):
    return bars(t).groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@R.query("split_at_dates", f"with {DAYS} select symbol, ts, close, case when ts < timestamp '2024-01-10' then 0 when ts < timestamp '2024-01-20' then 1 else 2 end as chunk from days")
def _(t):
    at = [F.expr(f"timestamp_ntz'2024-01-{d} 00:00:00'") for d in (10, 20)]
    return days(t).select("symbol", "ts", "close", sum(((F.col("ts") >= a).cast("int") for a in at), F.lit(0)).alias("chunk"))


@R.query("running_total", f"with {DAYS} select symbol, ts, round(sum(total) {_w} rows unbounded preceding), 6) as s from days")
def _(t):
    return days(t).select("symbol", "ts", F.round(F.sum("total").over(so_far(by_symbol())), 6).alias("s"))
