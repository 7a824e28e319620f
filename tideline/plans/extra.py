"""Queries of further indicators, generators, segments and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import by_symbol
from ..operators import indicators as I
from ..operators import portfolio as P
from ..operators import resample, segments
from ..operators import signals as G
from ..operators import smoothers as S
from ..operators import stats as T
from . import sweep
from .base import BARS, DAYS, bars, days
from .registry import Registry
from .technical import X, ema_cte

R = Registry()
_w = "over (partition by symbol order by ts"


@R.query(
    "rolling_range",
    f"with {BARS}, d as (select symbol, time_bucket(interval 4 hour, ts) as ts, max(high) as high, min(low) as low from bars group by 1, 2), r as (select symbol, ts + interval 4 hour as ts, case when count(high) {_w} rows 4 preceding) = 5 then max(high) {_w} rows 4 preceding) end as top, min(low) {_w} rows 4 preceding) as bottom from d), k as (select * from r where top is not null) "
    "select b.symbol, b.ts, k.top as range_top, k.bottom as range_bottom from bars b asof left join k on b.symbol = k.symbol and b.ts >= k.ts",
)
def _(t):
    return I.rolling_range(bars(t), "4 hours", 5).select("symbol", "ts", "range_top", "range_bottom")


_SIDES = [k for k in range(-2, 3) if k]


@R.query(
    "fractal_range",
    f"with {BARS}, d as (select symbol, time_bucket(interval 4 hour, ts) as ts, max(high) as high, min(low) as low from bars group by 1, 2), f as (select symbol, ts, lag(high, 2) {_w}) is not null and lead(high, 2) {_w}) is not null as ok, high, low, greatest("
    + ", ".join(f"lag(high, {k}) {_w})" for k in _SIDES) + ") as h, least(" + ", ".join(f"lag(low, {k}) {_w})" for k in _SIDES) + ") as l from d), "
    f"k as (select symbol, ts, lag(case when ok and high > h then high end, 2) {_w}) as u, lag(case when ok and low < l then low end, 2) {_w}) as d from f), r as (select symbol, ts + interval 4 hour as ts, last_value(u ignore nulls) {_w} rows unbounded preceding) as top, last_value(d ignore nulls) {_w} rows unbounded preceding) as bottom from k) "
    "select b.symbol, b.ts, r.top as range_top, r.bottom as range_bottom from bars b asof left join r on b.symbol = r.symbol and b.ts >= r.ts",
)
def _(t):
    return I.fractal_range(bars(t), "4 hours").select("symbol", "ts", "range_top", "range_bottom")


@R.query(
    "pivot_breakout",
    f"with {BARS}, d as (select symbol, date_trunc('day', ts) + interval 1 day as ts, max(high) as h, min(low) as l, arg_max(close, ts) as c from bars group by 1, 2), p as (select b.symbol, b.ts, b.open, b.close, 2 * (h + l + c) / 3 - l as r1, 2 * (h + l + c) / 3 - h as s1 from bars b asof left join d on b.symbol = d.symbol and b.ts >= d.ts), "
    f"q as (select *, lag(open) {_w}) as o, lag(close) {_w}) as c from p), z as (select symbol, ts, case when o > s1 and c > s1 and close < s1 then -1.0::double when o < r1 and c < r1 and close > r1 then 1.0::double end as target from q) select * from z where target is not null",
)
def _(t):
    b = bars(t)
    x = b.join(I.pivots(b).select("symbol", "ts", "r1", "s1"), ["symbol", "ts"])
    return G.level_breakout(x, ("r1",), ("s1",))


@R.query(
    "outstretched",
    f"with recursive {X}, e as (select symbol, ts, i, coalesce((close > lag(close, 3) {_w}))::int, 0) - coalesce((close < lag(close, 3) {_w}))::int, 0) as e from x), s as (select symbol, ts, i, case when i >= 3 then sum(e) {_w} rows 2 preceding)::double end as s from e), "
    + ema_cte("a", "s", "s", 5, 3)
    + f", o as (select s.symbol, s.ts, a.e as o from s left join a using (symbol, i)), l as (select *, lag(o) {_w}) as o1, lag(o, 2) {_w}) as o2 from o) "
    "select symbol, ts, case when o1 > -2.1 and o2 > -2.1 and o <= -2.1 then 1.0::double else -1.0::double end as target from l where (o1 > -2.1 and o2 > -2.1 and o <= -2.1) or (o1 < 2.1 and o2 < 2.1 and o >= 2.1)",
)
def _(t):
    return G.outstretched(bars(t), 3, 5, 0.3)


@R.query(
    "equilibrium",
    f"with recursive {X}, s as (select symbol, ts, i, case when i >= 8 then avg(close) {_w} rows 7 preceding) - close end as s from x), "
    + ema_cte("a", "s", "s", 8, 8)
    + f", o as (select s.symbol, s.ts, a.e as o from s left join a using (symbol, i)), l as (select *, lag(o) {_w}) as o1, lag(o, 2) {_w}) as o2 from o) "
    "select symbol, ts, case when o1 < 10 and o2 < 10 and o >= 10 then -1.0::double else 1.0::double end as target from l where (o1 < 10 and o2 < 10 and o >= 10) or (o1 > -10 and o2 > -10 and o <= -10)",
)
def _(t):
    return G.equilibrium(bars(t), 8, 10.0)


@R.query("movements_hilo")
def _(t):
    return segments.movements_hilo(bars(t), 100.0)


@R.query("pullbacks")
def _(t):
    return segments.pullbacks(bars(t), 5, 0.1, absolute=True)


@R.query("reversal_points")
def _(t):
    return segments.reversal_points(bars(t), 5, 0.5, absolute=True)


@R.query("scaled_slope")
def _(t):
    return S.per_symbol(bars(t), lambda p: {"slope": T.scaled_slope(p.close, 12), "angle": T.scaled_slope(p.close, 12, "angle", None)}, "slope double, angle double")


@R.query("locked_trend")
def _(t):
    def f(p):
        rest, r2 = T.locked_trend(p.close, 1, 20, 2)
        return {"rest1": rest[:, 0], "rest2": rest[:, 1], "r2": r2}

    return S.per_symbol(bars(t), f, "rest1 double, rest2 double, r2 double")


@R.query("growth_index", f"with {DAYS}, p as (select symbol, ts, close - 45 as pnl from days), e as (select *, 5000 + sum(pnl) {_w}) as e from p), r as (select *, pnl / nullif(lag(e) {_w}), 0) as r from e) select symbol, ts, round(case when min(r) {_w}) <= -1 then 0 else exp(sum(case when r > -1 then ln(1 + r) end) {_w})) end, 6) as growth from r where r is not null")
def _(t):
    x = days(t).select("symbol", "ts", (F.col("close") - 45).alias("pnl"))
    return P.growth(x, 5000.0).select("symbol", "ts", F.round("growth", 6).alias("growth"))


@R.query("cash_flow", f"with {BARS}, n as (select ts, count(close) as n from bars where volume > 2 group by 1) select ts, 100.0::double * (n - coalesce(lag(n) over (order by ts), 0)) as flow from n")
def _(t):
    return P.cash_flow(bars(t).filter("volume > 2").select("symbol", "ts", F.col("close").alias("price")), 100.0)


@R.query("merge_chunks", f"with {DAYS}, e as (select symbol, ts, sum(close) {_w}) as pnl from days) select symbol, ts, round(pnl - coalesce(lag(pnl) {_w}), 0), 6) as pnl from e")
def _(t):
    e = days(t).select("symbol", "ts", F.sum("close").over(by_symbol()).alias("pnl"))
    a, b = (F.expr(f"timestamp_ntz'2024-01-{d} 00:00:00'") for d in (12, 18))
    return P.merge_chunks(e.filter(F.col("ts") <= b), e.filter(F.col("ts") >= a)).select("symbol", "ts", F.round("pnl", 6).alias("pnl"))


@R.query("grid_search")
def _(t):
    b = bars(t)
    folds = resample.walk_forward(b, 12, 6).select("symbol", "ts", "fold", "part")
    prices = b.select("symbol", "ts", F.col("close").alias("price"))
    move = prices.withColumn("later", F.lead("price", 6).over(by_symbol()))

    def score(s):
        r = (F.col("later") / F.nullif("price", F.lit(0.0)) - 1) * F.col("target")
        x = s.join(move, ["symbol", "ts"]).withColumn("_r", r).groupBy("run", "fold", "part")
        return x.agg(F.when(F.stddev_pop("_r") > 0, F.avg("_r") / F.stddev_pop("_r")).alias("score"))

    grid = sweep.grid({"fast": [3, 5, 8], "slow": [8, 20]}, "fast < slow")
    return sweep.walk_forward_choice(sweep.search(grid, lambda p: G.crossing_means(b, p["fast"], p["slow"]), score, folds))


@R.query("best_runs", "with g as (select user_id % 50 as run, sum(value) as gain, count(*) as n from events group by 1) select run, round(gain, 6) as gain from g where n > 100 order by gain desc, run limit 5")
def _(t):
    g = t.events.groupBy((F.col("user_id") % 50).alias("run")).agg(F.sum("value").alias("gain"), F.count(F.lit(1)).alias("n"))
    return sweep.best(g, "n > 100", "gain", 5).select("run", F.round("gain", 6).alias("gain"))


@R.query("varying_parameters", "with p as (select n_regionkey as run, 'name' as name, n_name as value from nation union all select n_regionkey, 'fixed', 'x' from nation) select * from p where name in (select name from p group by 1 having count(distinct value) > 1)")
def _(t):
    n = t.nation.select(F.col("n_regionkey").alias("run"), F.inline(F.array(F.struct(F.lit("name").alias("name"), F.col("n_name").alias("value")), F.struct(F.lit("fixed").alias("name"), F.lit("x").alias("value")))))
    return sweep.varying(n).select("run", "name", "value")
