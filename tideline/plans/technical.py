"""Queries of smoothers, indicators and segments over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import by_symbol, trailing
from ..operators import indicators as I
from ..operators import rolling, segments
from ..operators import smoothers as S
from .base import BARS, bars
from .registry import Registry

R = Registry()
_w = "over (partition by symbol order by ts"
#: Bars with row numbers; recursive queries go from one row to the next.
X = f"{BARS}, x as (select *, close as v, row_number() {_w}) as i from bars)"


def ema_cte(name: str, src: str, col: str, n: int, start: int = 1) -> str:
    return (
        f"{name} as (select symbol, {start + n - 1}::bigint as i, avg({col}) as e from {src} where i between {start} and {start + n - 1} group by symbol having count(*) = {n} "
        f"union all select s.symbol, s.i, r.e + {2.0 / (1 + n)!r}::double * (s.{col} - r.e) from {name} r join {src} s on s.symbol = r.symbol and s.i = r.i + 1)"
    )


def _all(sql: str, value: str, join: str) -> str:
    return f"with recursive {X}, {sql} select x.symbol, x.ts, round({value}, 6) as value from x {join}"


def _smooth(name: str, sql: str, kind, n: int = 0, column: str = "close"):
    @R.query(name, sql)
    def _(t):
        return S.smooth(bars(t), column, kind, n).withColumn("value", F.round("value", 6))


_smooth("ema", _all(ema_cte("a", "x", "v", 10), "a.e", "left join a using (symbol, i)"), "ema", 10)
_smooth(
    "ema_unseeded",
    _all("a as (select symbol, i, v as e from x where i = 1 union all select x.symbol, x.i, a.e + 2.0::double / 11 * (x.v - a.e) from a join x on x.symbol = a.symbol and x.i = a.i + 1)", "a.e", "left join a using (symbol, i)"),
    lambda: S.Ema(10, seeded=False),
)
_smooth("dema", _all(ema_cte("a", "x", "v", 10) + ", " + ema_cte("b", "a", "e", 10, 10), "2 * a.e - b.e", "left join a using (symbol, i) left join b using (symbol, i)"), "dema", 10)
_smooth("tema", _all(", ".join([ema_cte("a", "x", "v", 8), ema_cte("b", "a", "e", 8, 8), ema_cte("c", "b", "e", 8, 15)]), "3 * a.e - 3 * b.e + c.e", "left join a using (symbol, i) left join b using (symbol, i) left join c using (symbol, i)"), "tema", 8)
_smooth("zlema", _all(f"z as (select symbol, i, 2 * v - lag(v, 6) {_w}) as v from x), " + ema_cte("a", "z", "v", 6, 7), "a.e", "left join a using (symbol, i)"), "zlema", 6)
_smooth(
    "hma",
    _all(
        ", ".join(
            [
                "f as (select symbol, ts, i, (" + " + ".join(f"lag(v, {4 - k}) {_w}) * {k + 1}" for k in range(5)) + ") / 15.0 as f, (" + " + ".join(f"lag(v, {9 - k}) {_w}) * {k + 1}" for k in range(10)) + ") / 55.0 as s from x)",
                "g as (select symbol, ts, i, 2 * f - s as d from f)",
                "h as (select symbol, i, (" + " + ".join(f"lag(d, {2 - k}) {_w}) * {k + 1}" for k in range(3)) + ") / 6.0 as e from g)",
            ]
        ),
        "h.e",
        "left join h using (symbol, i)",
    ),
    "hma",
    10,
)
_smooth(
    "kama",
    _all(
        f"d as (select *, abs(v - lag(v) {_w})) as c, abs(v - lag(v, 10) {_w})) as m from x), k as (select *, power(m / nullif(sum(c) {_w} rows 9 preceding), 0) * (2.0::double / 3 - 2.0::double / 31) + 2.0::double / 31, 2) as sc from d), "
        "a as (select symbol, i, v as e from k where i = 10 union all select k.symbol, k.i, a.e + k.sc * (k.v - a.e) from a join k on k.symbol = a.symbol and k.i = a.i + 1)",
        "case when x.i > 10 then a.e end",
        "left join a using (symbol, i)",
    ),
    "kama",
    10,
)
_smooth(
    "jma",
    _all(
        "p as (select 0.45::double * 6 / (0.45::double * 6 + 2) as b), q as (select b, b * b as a from p), "
        "a as (select symbol, i, v as e0, 0.0::double as e1, 0.0::double as e2, v as e from x where i = 1 union all "
        "select symbol, i, n0, n1, n2, e + n2 from (select s.symbol, s.i, s.n0, s.n1, q.a * q.a * s.e2 + (1 - q.a) * (1 - q.a) * (s.n0 + 1.5 * s.n1 - s.e) as n2, s.e from "
        "(select x.symbol, x.i, a.e2, a.e, a.e0 + (1 - q.a) * (x.v - a.e0) as n0, q.b * a.e1 + (1 - q.b) * (x.v - (a.e0 + (1 - q.a) * (x.v - a.e0))) as n1 from a join x on x.symbol = a.symbol and x.i = a.i + 1 cross join q) s cross join q))",
        "a.e",
        "left join a using (symbol, i)",
    ),
    "jma",
    7,
)
@R.query(
    "mcginley",
    _all("a as (select symbol, i, high + 1000 as e from x where i = 1 union all select x.symbol, x.i, a.e + (x.high + 1000 - a.e) / (8 * power((x.high + 1000) / a.e, 4)) from a join x on x.symbol = a.symbol and x.i = a.i + 1)", "a.e", "left join a using (symbol, i)"),
)
def _(t):
    return S.smooth(bars(t).withColumn("level", F.col("high") + 1000), "level", "mcginley", 8).withColumn("value", F.round("value", 6))


_smooth(
    "holt",
    _all(
        "a as (select symbol, i, v as e, 0.0::double as b from x where i = 1 union all select symbol, i, n, 0.3 * (n - e) + 0.7 * b from (select x.symbol, x.i, a.e, a.b, 0.2 * x.v + 0.8 * (a.e + a.b) as n from a join x on x.symbol = a.symbol and x.i = a.i + 1))",
        "a.e",
        "left join a using (symbol, i)",
    ),
    lambda: S.Holt(9, 0.3),
)
_POLES = (
    "a as (select symbol, i, 0.0::double as l0, 0.0::double as l1, 0.0::double as l2, 0.0::double as l3 from x where i = 1 union all select symbol, i, n0, n1, n2, l2 + {g} * (l3 - n2) from "
    "(select *, l1 + {g} * (l2 - n1) as n2 from (select *, l0 + {g} * (l1 - n0) as n1 from (select x.symbol, x.i, a.l0, a.l1, a.l2, a.l3, (1 - {g}) * x.v + {g} * a.l0 as n0 from a join x on x.symbol = a.symbol and x.i = a.i + 1))))"
)
_smooth("laguerre", _all(_POLES.format(g="0.8::double"), "(l0 + 2 * l1 + 2 * l2 + l3) / 6", "left join a using (symbol, i)"), lambda: S.Laguerre(0.8))
_smooth(
    "lrsi",
    _all(
        _POLES.format(g="0.5::double"),
        "case when abs(l0 - l1) + abs(l1 - l2) + abs(l2 - l3) > 0 then 100 * (greatest(l0 - l1, 0) + greatest(l1 - l2, 0) + greatest(l2 - l3, 0)) / (abs(l0 - l1) + abs(l1 - l2) + abs(l2 - l3)) else 0 end",
        "left join a using (symbol, i)",
    ),
    lambda: S.LaguerreRsi(0.5),
)
_smooth(
    "kalman_level",
    _all(
        "s as (select symbol, i, v, 0.01::double as q, 4.0::double as r from x), a as (select symbol, i, v as e, (1 - (1 + q) / (1 + q + r)) * (1 + q) as p from s where i = 1 union all "
        "select s.symbol, s.i, a.e + (a.p + q) / (a.p + q + r) * (s.v - a.e), (1 - (a.p + q) / (a.p + q + r)) * (a.p + q) from a join s on s.symbol = a.symbol and s.i = a.i + 1)",
        "a.e",
        "left join a using (symbol, i)",
    ),
    lambda: S.Kalman(0.01, 4.0),
)
_smooth(
    "pwma",
    _all(
        "a as (select symbol, i, v as m, 0.0::double as var from x where i = 1 union all select symbol, i, m + (1 - k) * d, k * (var + d * d * (1 - k)) from "
        "(select *, case when i - 2 > 20 then 0.9 * (1 - 0.5 * case when var > 0 then exp(-(d * d / var) / 2) / sqrt(2 * pi()) else 0 end) else 1 - 1.0::double / (i - 1) end as k from (select x.symbol, x.i, a.m, a.var, x.v - a.m as d from a join x on x.symbol = a.symbol and x.i = a.i + 1)))",
        "a.m",
        "left join a using (symbol, i)",
    ),
    lambda: S.Pwma(0.9, 0.5, 20),
)


@R.query(
    "ema_time",
    _all(
        f"s as (select *, (epoch_us(ts) - epoch_us(lag(ts) {_w}))) / 36000000000.0::double as a, lag(v) {_w}) as pv from x), "
        "a as (select symbol, i, v as e from s where i = 1 union all select s.symbol, s.i, exp(-s.a) * a.e + ((1 - exp(-s.a)) / s.a - exp(-s.a)) * s.pv + (1 - (1 - exp(-s.a)) / s.a) * s.v from a join s on s.symbol = a.symbol and s.i = a.i + 1)",
        "case when x.i > 1 then a.e end",
        "left join a using (symbol, i)",
    ),
)
def _(t):
    def f(p):
        step = S.EmaTime(36_000_000_000)
        us = p.ts.astype("datetime64[us]").astype("int64")
        return {"value": [step(a, b) for a, b in zip(us, p.close, strict=True)]}

    return S.per_symbol(bars(t), f, "value double").withColumn("value", F.round("value", 6))


@R.query(
    "bidirectional_ema",
    f"with recursive {X}, y as (select symbol, v, (count(*) over (partition by symbol) - i + 1)::bigint as i from x), " + ema_cte("a", "x", "v", 10) + ", " + ema_cte("b", "y", "v", 10) + ", n as (select symbol, count(*) as n from x group by 1) "
    "select x.symbol, x.ts, round((a.e + b.e) / 2, 6) as value from x join n using (symbol) left join a on a.symbol = x.symbol and a.i = x.i left join b on b.symbol = x.symbol and b.i = n.n - x.i + 1",
)
def _(t):
    return S.per_symbol(bars(t), lambda p: {"value": S.both_ways(p.close, 10)}, "value double").withColumn("value", F.round("value", 6))


@R.query(
    "pwma_outliers",
    f"with recursive {X}, a as (select symbol, i, 0.0::double as z, 1::bigint as n, v as m1, v * v as m2, 0.0::double as sd from x where i = 1 union all "
    "select symbol, i, z, n, k * m1 + (1 - k) * v, k * m2 + (1 - k) * v * v, sqrt(abs(k * m2 + (1 - k) * v * v - power(k * m1 + (1 - k) * v, 2))) from ("
    "select *, case when n >= 30 then 0.98::double * (1 - 0.5 * exp(-z * z / 2) / sqrt(2 * pi())) else 1 - 1.0::double / n end as k from ("
    "select x.symbol, x.i, x.v, a.m1, a.m2, a.n + 1 as n, case when a.sd > 0 then (x.v - a.m1) / a.sd else 0 end as z from a join x on x.symbol = a.symbol and x.i = a.i + 1))) "
    "select x.symbol, x.ts, round(z, 6) as z, abs(z) >= 1.959963984540054 as outlier from x join a using (symbol, i)",
)
def _(t):
    def f(p):
        step, z, flags = S.PwmaOutlier(0.98, 0.5), [], []
        for v in p.close:
            z.append(step(v))
            flags.append(step.flag)
        return {"z": z, "outlier": flags}

    return S.per_symbol(bars(t), f, "z double, outlier boolean").withColumn("z", F.round("z", 6))


@R.query(
    "kalman_regression",
    f"with recursive {X}, a as (select symbol, i, close / open as b, 0.0::double as c, 0.0::double as p, 0.0::double as q, 0.0::double as q2, 0.0::double as r, close - close / open * open as e, 1.0::double as s from x where i = 1 union all "
    "select symbol, i, b + g * e, c + h * e, p * (1 - g * x), q * (1 - h), q2 * (1 - g * x), r * (1 - h), e, s from (select *, (p * x + q) / s as g, (q2 * x + r) / s as h from (select *, y - b * x - c as e, x * (p * x + q) + q2 * x + r + 1 as s from ("
    "select n.symbol, n.i, n.open as x, n.close as y, a.b, a.c, a.p + 1e-4 as p, a.q + 1e-4 as q, a.q2 + 1e-4 as q2, a.r + 1e-4 as r from a join x n on n.symbol = a.symbol and n.i = a.i + 1)))) "
    "select x.symbol, x.ts, round(b, 5) as beta, round(c, 5) as alpha, round(e, 5) as error, round(s, 5) as variance from x join a using (symbol, i)",
)
def _(t):
    def f(p):
        b, e, q = S.kalman_regression(p.open.to_numpy(), p.close.to_numpy(), 1e-4, 1.0)
        return {"beta": b[:, 0], "alpha": b[:, 1], "error": e, "variance": q}

    x = S.per_symbol(bars(t), f, "beta double, alpha double, error double, variance double")
    return x.withColumns({c: F.round(c, 5) for c in ("beta", "alpha", "error", "variance")})


@R.query(
    "macd",
    _all(", ".join([ema_cte("a", "x", "v", 12), ema_cte("b", "x", "v", 26), "d as (select a.symbol, a.i, a.e - b.e as d from a join b using (symbol, i))", ema_cte("c", "d", "d", 9, 26)]), "c.e", "left join c using (symbol, i)"),
)
def _(t):
    return I.macd(bars(t)).select("symbol", "ts", F.round("macd", 6).alias("value"))


_TR = f"tr as (select *, greatest(high - low, abs(high - lag(close) {_w})), abs(low - lag(close) {_w}))) as tr from bars)"


def _windowed(name: str, ctes: str, columns: dict[str, str], build):
    """A query of columns over bars, rounded to 6 digits."""

    @R.query(name, f"with {BARS}{', ' + ctes if ctes else ''}, y as (select symbol, ts, " + ", ".join(f"{v} as {k}" for k, v in columns.items()) + f" from {'z' if ctes else 'bars'}) select symbol, ts, " + ", ".join(f"round({k}, 6) as {k}" for k in columns) + " from y")
    def _(t):
        return build(bars(t)).select("symbol", "ts", *[F.round(F.col(k).cast("double"), 6).alias(k) for k in columns])


def _full(col: str, n: int, expr: str) -> str:
    return f"case when count({col}) {_w} rows {n - 1} preceding) = {n} then {expr} end"


_windowed("atr", f"{_TR}, z as (select * from tr)", {"atr": _full("tr", 14, f"avg(tr) {_w} rows 13 preceding)")}, lambda b: I.with_atr(b, 14))
_windowed("atr_percent", f"{_TR}, z as (select *, {_full('tr', 14, f'avg(tr) {_w} rows 13 preceding)')} as a from tr)", {"atr": f"100 * a / lag(close) {_w})"}, lambda b: I.with_atr(b, 14, percent=True))
_BB = f"m as (select *, {_full('close', 14, f'avg(close) {_w} rows 13 preceding)')} as median from bars), d as (select *, power(close - median, 2) as d from m), z as (select *, {_full('d', 14, f'sqrt(sum(d) {_w} rows 13 preceding) / 13)')} as s from d)"
_windowed("bollinger", _BB, {"median": "median", "upper": "median + 2 * s", "lower": "median - 2 * s"}, lambda b: I.with_bollinger(b, 14, 2))
_windowed(
    "bollinger_atr",
    f"{_TR}, z as (select *, {_full('close', 14, f'avg(close) {_w} rows 13 preceding)')} as median, {_full('tr', 10, f'avg(tr) {_w} rows 9 preceding)')} as a from tr)",
    {"median": "median", "upper": "median + 2 * a", "lower": "median - 2 * a"},
    lambda b: I.with_bollinger_atr(b, 14, 10, 2),
)
_RSI = f"d as (select *, coalesce({{c}} - lag({{c}}) {_w}), 0) as d from {{s}}), u as (select *, {_full('d', 14, f'avg(greatest(d, 0)) {_w} rows 13 preceding)')} as u, {_full('d', 14, f'avg(greatest(-d, 0)) {_w} rows 13 preceding)')} as v from d)"
_windowed("rsi", _RSI.format(c="close", s="bars") + ", z as (select * from u)", {"rsi": "case when u + v > 0 then 100 * u / (u + v) end"}, lambda b: I.with_rsi(b, 14))
_windowed(
    "denoised_trend",
    f"d as (select *, abs(close - open) as r, close - lag(open, 12) {_w}) as d from bars), z as (select *, {_full('r', 13, f'sum(r) {_w} rows 12 preceding)')} as p from d)",
    {"trend": "case when p is not null and d is not null then case when greatest(p, abs(d)) > 0 then abs(d) * d / greatest(p, abs(d)) else 0 end end"},
    lambda b: I.with_denoised_trend(b, 12),
)
_CHOP = f"{_TR}, a as (select *, {_full('tr', 14, f'avg(tr) {_w} rows 13 preceding)')} as a from tr), c as (select *, case when count(a) {_w} rows 13 preceding) = 14 then 100 * ln(sum(a) {_w} rows 13 preceding) / nullif(max(high) {_w} rows 13 preceding) - min(low) {_w} rows 13 preceding), 0)) / ln(14) end as c from a), z as (select *, case when c >= 61.8 then 1 when c <= 38.2 then 0 end as s from c)"
_windowed("choppiness", _CHOP, {"choppy": f"coalesce(last_value(s ignore nulls) {_w} rows unbounded preceding), 0)::double"}, lambda b: I.with_choppiness(b, 14).withColumn("choppy", F.col("choppy").cast("int")))
_windowed(
    "rolling_atr",
    f"{_TR}, z as (select *, max(high) over r - min(low) over r as a from tr window r as (partition by symbol order by ts range between interval 6 hour preceding and current row))",
    {"range6h": "a"},
    lambda b: b.withColumn("range6h", F.expr("max(high) over (partition by symbol order by ts range between interval 6 hours preceding and current row) - min(low) over (partition by symbol order by ts range between interval 6 hours preceding and current row)")),
)


@R.query(
    "trend_detector",
    f"with {BARS}, {_BB}, k as (select *, median + 1.0 * s as upper, median - 1.0 * s as lower from z), b as (select *, case when close > lag(upper) {_w}) then 1 when close < lag(lower) {_w}) then -1 end as b from k), "
    f"t as (select *, coalesce(last_value(b ignore nulls) {_w} rows unbounded preceding), 0) as trend from b), n as (select *, case when trend is distinct from lag(trend) {_w}) then 1 else 0 end as n from t), g as (select *, sum(n) {_w} rows unbounded preceding) as g from n) "
    "select symbol, ts, trend::int as trend, round(case when trend > 0 then max(lower) over r end, 6) as up_line, round(case when trend < 0 then min(upper) over r end, 6) as down_line from g window r as (partition by symbol, g order by ts rows unbounded preceding)",
)
def _(t):
    return I.with_trend(bars(t), 14, 1.0).select("symbol", "ts", F.col("trend").cast("int").alias("trend"), F.round("up_line", 6).alias("up_line"), F.round("down_line", 6).alias("down_line"))


@R.query(
    "rad_stop",
    f"with {BARS}, {_TR}, a as (select *, {_full('tr', 10, f'avg(tr) {_w} rows 9 preceding)')} as a, {_full('high', 10, f'max(high) {_w} rows 9 preceding)')} as hh, {_full('low', 10, f'min(low) {_w} rows 9 preceding)')} as ll from tr), "
    f"l as (select *, hh - a as ls, ll + a as ss from a), s as (select *, case when lag(close) {_w}) < lag(ss) {_w}) and close > ss then -1 when lag(close) {_w}) > lag(ls) {_w}) and close < ls then 1 end as s from l), "
    f"t as (select *, last_value(s ignore nulls) {_w} rows unbounded preceding) as side from s), n as (select *, case when row_number() {_w}) = 1 or side is distinct from lag(side) {_w}) then 1 else 0 end as n from t), g as (select *, sum(n) {_w} rows unbounded preceding) as g from n) "
    "select symbol, ts, side::int as side, round(case when side < 0 then max(ls) over r when side > 0 then min(ss) over r end, 6) as rad from g window r as (partition by symbol, g order by ts rows unbounded preceding)",
)
def _(t):
    return I.with_rad(bars(t), 10, 1.0).select("symbol", "ts", F.col("side").cast("int").alias("side"), F.round("rad", 6).alias("rad"))


@R.query(
    "psar",
    f"with recursive {X}, s as (select *, lag(low) {_w}) as l1, lag(low, 2) {_w}) as l2, lag(high) {_w}) as h1, lag(high, 2) {_w}) as h2 from x), "
    "a as (select symbol, i, ts, v as sar, true as lng, 0.02::double as sp, high as hp, low as lp from s where i = 1 union all "
    "select symbol, i, ts, case when i = 2 then v when hit then case when lng then hp else lp end when lng then least(p, l1, l2) else greatest(p, h1, h2) end, case when i = 2 then lng else lng <> hit end, "
    "case when i = 2 then sp when hit then 0.02 when (lng and high > hp) or (not lng and low < lp) then least(sp + 0.02, 0.2) else sp end, "
    "case when i = 2 then hp when hit and not lng then high when not hit and lng then greatest(hp, high) else hp end, case when i = 2 then lp when hit and lng then low when not hit and not lng then least(lp, low) else lp end "
    "from (select *, case when lng then low < p else high > p end as hit from (select s.symbol, s.i, s.ts, s.v, s.high, s.low, s.l1, s.l2, s.h1, s.h2, a.lng, a.sp, a.hp, a.lp, a.sar + a.sp * (case when a.lng then a.hp else a.lp end - a.sar) as p "
    "from a join s on s.symbol = a.symbol and s.i = a.i + 1))) select symbol, ts, round(sar, 6) as psar, case when i > 2 then case when lng then 1 else -1 end else 0 end as side from a",
)
def _(t):
    return I.psar(bars(t)).select("symbol", "ts", F.round("psar", 6).alias("psar"), F.when(F.col("down").isNotNull(), 1).when(F.col("up").isNotNull(), -1).otherwise(0).alias("side"))


_FDI = 12


@R.query(
    "fdi",
    f"with {BARS}, c as (select symbol, ts, row_number() {_w}) as i, list(close) {_w} rows {_FDI - 1} preceding) as l from bars), s as (select *, list_min(l) as lo, list_max(l) as hi from c), "
    f"p as (select *, list_sum(list_transform(range(3, {_FDI + 1}), lambda k: sqrt(power((l[k] - l[k - 1]) / nullif(hi - lo, 0), 2) + 1.0::double / {_FDI**2}))) as len from s) "
    f"select symbol, ts, round(case when i > {_FDI} then coalesce(1 + (ln(len) + ln(2)) / ln(2 * {_FDI}), 0) end, 6) as fdi from p",
)
def _(t):
    return I.fdi(bars(t), _FDI).withColumn("fdi", F.round("fdi", 6))


@R.query(
    "pivot_points",
    f"with {BARS}, d as (select symbol, date_trunc('day', ts) + interval 1 day as ts, max(high) as h, min(low) as l, arg_max(close, ts) as c from bars group by 1, 2) "
    "select b.symbol, b.ts, round((h + l + c) / 3, 6) as p, round(2 * (h + l + c) / 3 - l, 6) as r1, round(2 * (h + l + c) / 3 - h, 6) as s1, round((h + l + c) / 3 + 3 * (h - l), 6) as r4 from bars b asof left join d on b.symbol = d.symbol and b.ts >= d.ts",
)
def _(t):
    return I.pivots(bars(t)).select("symbol", "ts", *[F.round(c, 6).alias(c) for c in ("p", "r1", "s1", "r4")])


@R.query(
    "pivot_points_camarilla",
    f"with {BARS}, d as (select symbol, date_trunc('day', ts) + interval 1 day as ts, max(high) as h, min(low) as l, arg_max(close, ts) as c from bars group by 1, 2) select b.symbol, b.ts, round(c + (h - l) * 1.1 / 2, 6) as r4, round(c - (h - l) * 1.1 / 12, 6) as s1 from bars b asof left join d on b.symbol = d.symbol and b.ts >= d.ts",
)
def _(t):
    return I.pivots(bars(t), "camarilla").select("symbol", "ts", F.round("r4", 6).alias("r4"), F.round("s1", 6).alias("s1"))


@R.query(
    "connors_rsi",
    f"with {BARS}, sg as (select *, coalesce(sign(close - lag(close) {_w})), 0) as s from bars), n as (select *, case when s is distinct from lag(s) {_w}) then 1 else 0 end as n from sg), g as (select *, sum(n) {_w} rows unbounded preceding) as g from n), k as (select *, s * row_number() over (partition by symbol, g order by ts) as streak from g), "
    + f"d as (select *, coalesce(close - lag(close) {_w}), 0) as d, coalesce(streak - lag(streak) {_w}), 0) as e from k), u as (select *, {_full('d', 3, f'avg(greatest(d, 0)) {_w} rows 2 preceding)')} as u, {_full('d', 3, f'avg(greatest(-d, 0)) {_w} rows 2 preceding)')} as v, {_full('e', 2, f'avg(greatest(e, 0)) {_w} rows 1 preceding)')} as a, {_full('e', 2, f'avg(greatest(-e, 0)) {_w} rows 1 preceding)')} as b, "
    f"case when row_number() {_w}) >= 50 then len(list_filter(list(close) {_w} rows between 49 preceding and 1 preceding), lambda q: q < close)) * 100.0 / 50 end as p from d) "
    "select symbol, ts, round((case when u + v > 0 then 100 * u / (u + v) end + case when a + b > 0 then 100 * a / (a + b) end + p) / 3, 6) as crsi from u",
)
def _(t):
    return I.with_connors_rsi(bars(t), rank_n=50).select("symbol", "ts", F.round("crsi", 6).alias("crsi"))


@R.query("halflife", f"with {BARS}, d as (select symbol, lag(close) {_w}) as b, close - lag(close) {_w}) as d from bars) select symbol, ceil(-ln(2) / nullif(regr_slope(d, b), 0))::bigint as halflife from d group by 1")
def _(t):
    return I.halflife(bars(t), "close").withColumn("halflife", F.col("halflife").cast("bigint"))


_STOPS = (
    f"w as (select *, lag(high) {_w}) as h1, lag(low) {_w}) as l1, (high + low) / 2 - 1.0 * a as dn, (high + low) / 2 + 1.0 * a as up from (select *, row_number() {_w}) as i, {_full('tr', 10, f'avg(tr) {_w} rows 9 preceding)')} as a from tr)), "
    "k as (select symbol, i, ts, high, low, null::double as dn, null::double as up from w where i = 1 union all "
    "select symbol, i, ts, high, low, case when s_dn is null then k_dn when k_dn is null then s_dn when s_dn <= 0 or high = low then k_dn when l1 > k_dn then greatest(s_dn, k_dn) else s_dn end, "
    "case when s_up is null then k_up when k_up is null then s_up when s_up <= 0 or high = low then k_up when h1 < k_up then least(s_up, k_up) else s_up end from "
    "(select w.symbol, w.i, w.ts, w.high, w.low, w.h1, w.l1, w.dn as s_dn, w.up as s_up, k.dn as k_dn, k.up as k_up from k join w on w.symbol = k.symbol and w.i = k.i + 1)), "
    f"d as (select *, case when high > lag(up) {_w}) then 1.0::double when low < lag(dn) {_w}) then -1.0::double end as d from k), t as (select *, last_value(d ignore nulls) {_w} rows unbounded preceding) as trend from d)"
)


@R.query("super_trend", f"with recursive {BARS}, {_TR}, {_STOPS} select symbol, ts, case when trend = 1 then round(dn, 6) end as utl, case when trend = -1 then round(up, 6) end as dtl, trend from t")
def _(t):
    x = I.super_trend(bars(t), 10, 1.0)
    return x.withColumns({c: F.round(c, 6) for c in ("utl", "dtl")})


_MOVE = (
    "m as (select symbol, i, v as x, v as hi, v as lo, 1::bigint as ih, 1::bigint as il, 0 as side, null::bigint as point from x where i = 1 union all select symbol, i, x, case when up then x when dn then x else h end, case when up then x when dn then x else l end, "
    "case when up or dn then i else jh end, case when up or dn then i else jl end, case when dn then -1 when up then 1 else side end, case when dn then jh when up then jl end from ("
    "select *, side >= 0 and h - x >= {t} * {h} and jh < i as dn, not (side >= 0 and h - x >= {t} * {h} and jh < i) and side <= 0 and x - l >= {t} * {l} and jl < i as up from ("
    "select n.symbol, n.i, n.v as x, m.side, case when n.v > m.hi then n.v else m.hi end as h, case when n.v > m.hi then n.i else m.ih end as jh, case when n.v < m.lo then n.v else m.lo end as l, case when n.v < m.lo then n.i else m.il end as jl from m join x n on n.symbol = m.symbol and n.i = m.i + 1))), "
    "p as (select symbol, point from m where point is not null), z as (select symbol, arg_max(case when side > 0 then ih when side < 0 then il end, i) as last, max(i) as n from m group by 1), "
    "q as (select symbol, point from p union select p.symbol, 1::bigint from p union select z.symbol, z.last from z join (select symbol, max(point) as b from p group by 1) b using (symbol) where z.last > b), "
    f"r as (select q.symbol, x.ts, x.v, lead(x.ts) over (partition by q.symbol order by point) as e, lead(x.v) over (partition by q.symbol order by point) as w from q join x on x.symbol = q.symbol and x.i = q.point) "
    'select symbol, ts, e as "end", v as start_price, w as end_price, round(w - v, 6) as delta from r where e is not null'
)
for _name, _args, _t, _h, _l in (("movements", {"threshold": 60.0}, "60", "1", "1"), ("movements_percent", {"threshold": 0.5, "percent": True}, "0.5", "h", "l")):

    @R.query(_name, f"with recursive {X}, {_MOVE.format(t=_t, h=_h, l=_l)}")
    def _(t, args=_args):
        return segments.movements(bars(t), "close", **args).withColumn("delta", F.round("delta", 6))


_SIDE = R.sql["psar"].replace("select symbol, ts, round(sar, 6) as psar,", "o as (select symbol, ts, i,", 1)
_SIDE = _SIDE[: _SIDE.rindex(" from a")] + " from a)"


@R.query(
    "swings",
    _SIDE.replace("))) o as", "))), o as")
    + f", b as (select o.*, x.high, x.low from o join x using (symbol, i) where side <> 0), n as (select *, case when side is distinct from lag(side) {_w}) then 1 else 0 end as n from b), g as (select *, sum(n) {_w} rows unbounded preceding) as g from n), "
    "e as (select symbol, g, side, case when side > 0 then max(high) else min(low) end as price, case when side > 0 then arg_max(ts, (high, -epoch_us(ts))) else arg_min(ts, (low, epoch_us(ts))) end as ts from g group by 1, 2, 3), "
    f"l as (select *, lead(price) {_w}) as p1, lead(ts) {_w}) as z, lead(side) {_w}) as d from e) select symbol, ts, price as p0, p1, z as \"end\", d as direction, round(abs(p1 - price), 6) as length from l where d is not null",
)
def _(t):
    return I.swings(bars(t)).withColumn("length", F.round("length", 6))


@R.query(
    "explosion",
    f"with recursive {X}, r as (select x.*, greatest(high - low, abs(high - lag(close) {_w})), abs(low - lag(close) {_w}))) as tr from x), "
    + ", ".join([ema_cte("a", "x", "v", 20), ema_cte("b", "x", "v", 40), ema_cte("d", "r", "tr", 41)])
    + f", m as (select x.symbol, x.ts, x.i, a.e - b.e as m, d.e as z, case when count(v) {_w} rows 19 preceding) = 20 then 4 * stddev_pop(v) {_w} rows 19 preceding) end as k from x left join a using (symbol, i) left join b using (symbol, i) left join d using (symbol, i)), "
    f"c as (select *, (m - lag(m) {_w})) * 150 as c from m) select symbol, ts, round(3.7 * z, 6) as dead_zone, round(k, 6) as explosion, round(case when c > 0 then c else 0 end, 6) as trend_up, round(case when c < 0 then -c else 0 end, 6) as trend_down from c",
)
def _(t):
    return I.explosion(bars(t), atr=20).withColumns({c: F.round(c, 6) for c in ("dead_zone", "explosion", "trend_up", "trend_down")})


def _hull(name: str, col: str, n: int, src: str = "x") -> str:
    """Columns ``name`` of a Hull mean of n rows, as three tables one after the other."""
    mean = lambda c, k: "(" + " + ".join(f"lag({c}, {k - 1 - j}) {_w}) * {j + 1}" for j in range(k)) + f") / {k * (k + 1) / 2}::double"
    return f"{name}1 as (select *, {mean(col, n // 2)} as f, {mean(col, n)} as s from {src}), {name}2 as (select *, 2 * f - s as d from {name}1), {name} as (select symbol, i, {mean('d', int(n**0.5))} as e from {name}2)"


@R.query(
    "ssl_exits",
    f"with recursive {X}, r as (select x.*, greatest(high - low, abs(high - lag(close) {_w})), abs(low - lag(close) {_w}))) as tr from x), {ema_cte('a', 'r', 'tr', 14)}, {_hull('b', 'v', 20)}, {_hull('h', 'high', 8)}, {_hull('l', 'low', 8)}, "
    "z as (select x.*, a.e as a, b.e as b, h.e as h, l.e as l from x left join a using (symbol, i) left join b using (symbol, i) left join h using (symbol, i) left join l using (symbol, i)), "
    f"s as (select *, last_value(case when close > h then 1 when close < l then -1 end ignore nulls) {_w} rows unbounded preceding) as s from z), k as (select *, case when s < 0 then h when s > 0 then l end as k from s), p as (select *, lag(close) {_w}) as pc, lag(k) {_w}) as pk from k) "
    "select symbol, ts, case when pc >= pk and close < k then high end as exit_long, case when pc <= pk and close > k then low end as exit_short, round(case when close > b + 0.2 * a then b end, 6) as grow, round(case when close < b - 0.2 * a then b end, 6) as decline, round(b, 6) as base from p",
)
def _(t):
    return I.ssl_exits(bars(t), base=20, exit_n=8).withColumns({c: F.round(c, 6) for c in ("grow", "decline", "base")})


for _name, _f in {"adx": lambda b: I.adx(b, 14), "qqe": lambda b: I.qqe(b)}.items():

    @R.query(_name)
    def _(t, f=_f):
        return f(bars(t))


@R.query(
    "band_signals",
    f"with recursive {BARS}, z as (select symbol, ts, row_number() {_w}) as i, (close - avg(close) {_w} rows 19 preceding)) / nullif(stddev_samp(close) {_w} rows 19 preceding), 0) as z from bars), "
    "a as (select symbol, i, ts, 0 as pos, z as before, null::int as sig from z where i = 1 union all select symbol, i, ts, new, z, case when new <> pos then new end from ("
    "select z.symbol, z.i, z.ts, z.z, a.pos, case when z.z is null then a.pos when a.pos = 0 then case when abs(z.z) < 1 then case when a.before <= -1 then 1 when a.before >= 1 then -1 else 0 end else 0 end when a.pos * z.z >= 0.2 then 0 else a.pos end as new "
    "from a join z on z.symbol = a.symbol and z.i = a.i + 1)) select symbol, ts, sig::double as signal from a where sig is not null",
)
def _(t):
    z = (F.col("close") - F.avg("close").over(trailing(by_symbol(), 20))) / F.nullif(F.stddev_samp("close").over(trailing(by_symbol(), 20)), F.lit(0.0))
    return segments.band_signals(bars(t).withColumn("z", z), "z", 1.0, 0.2)


@R.query(
    "triple_barrier",
    f"with {BARS}, e as (select symbol, ts as entry, close as p0 from bars), x as (select e.symbol, entry, p0, b.ts, b.close as p from e join bars b on b.symbol = e.symbol and b.ts > entry and b.ts <= entry + interval 12 hour), "
    "g as (select symbol, entry, p0, min(case when p >= p0 * 1.5 then ts end) as u, min(case when p <= p0 * 0.6 then ts end) as d, arg_max(p, ts) as lp, max(ts) as lt from x group by 1, 2, 3) "
    "select symbol, entry as ts, case when u is not null and (d is null or u <= d) then 2 when d is not null then -2 else sign(lp - p0)::int end as label, case when u is not null and (d is null or u <= d) then u else coalesce(d, lt) end as hit from g",
)
def _(t):
    p = bars(t).select("symbol", "ts", F.col("close").alias("price"))
    return segments.triple_barrier(p, p, 0.5, 0.4, "12 hours")


@R.query("autocorrelation_filter", f"with recursive {BARS}, r as (select symbol, ts, close - lag(close) {_w}) as r from bars), l as (select *, lag(r) {_w}) as r1 from r), c as (select symbol, ts, case when count(r1) {_w} rows 19 preceding) = 20 then covar_pop(r, r1) {_w} rows 19 preceding) / nullif(stddev_pop(r) {_w} rows 19 preceding) * stddev_pop(r1) {_w} rows 19 preceding), 0) end as c from l) select symbol, ts, round(lag(c) {_w}), 6) as value from c")
def _(t):
    x = bars(t).withColumn("r", F.col("close") - F.lag("close").over(by_symbol())).withColumn("r1", F.lag("r").over(by_symbol()))
    x = x.withColumn("c", rolling.correlation(F.col("r"), F.col("r1"), by_symbol(), 20))
    return x.select("symbol", "ts", F.round(F.lag("c").over(by_symbol()), 6).alias("value"))


@R.query("volatility_filter", f"with {BARS}, {_TR}, a as (select *, {_full('tr', 5, f'avg(tr) {_w} rows 4 preceding)')} as f, {_full('tr', 20, f'avg(tr) {_w} rows 19 preceding)')} as s from tr), b as (select symbol, ts, f > s as ok from a) select symbol, ts from (select symbol, ts, lag(ok) {_w}) as ok from b) where ok")
def _(t):
    x = I.with_atr(I.with_atr(bars(t), 5, "f"), 20, "s").withColumn("ok", F.col("f") > F.col("s"))
    return x.withColumn("ok", F.lag("ok").over(by_symbol())).filter("ok").select("symbol", "ts")
