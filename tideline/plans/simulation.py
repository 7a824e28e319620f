"""Queries of the simulator, its trackers and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import by_symbol, trailing
from ..operators import incremental as N
from ..operators import indicators as I
from ..operators import signals as G
from ..operators import simulate as S
from ..operators import smoothers
from ..streaming import flows
from .base import BARS, bars, days
from .finance import _ma
from . import sweep, technical
from .registry import Registry

R = Registry()
_w = "over (partition by symbol order by ts"

_TICKS = """tk as (select symbol, ts, 0 as leg, open - 0.5 as bid, open + 0.5 as ask, true as real from bars union all select symbol, ts + interval 24 minute, 1, {a} - 0.5, {a} + 0.5, false from bars
union all select symbol, ts + interval 36 minute, 2, {b} - 0.5, {b} + 0.5, false from bars union all select symbol, ts + interval 48 minute, 3, close - 0.5, close + 0.5, true from bars)"""


@R.query("ohlc_to_ticks", f"with {BARS}, {_TICKS.format(a='low', b='high')} select * from tk")
def _(t):
    return S.bar_ticks(bars(t), 3600, 0.5)


@R.query("ohlc_to_ticks_by_colour", f"with {BARS}, {_TICKS.format(a='(case when close < open then high else low end)', b='(case when close < open then low else high end)')} select * from tk")
def _(t):
    return S.bar_ticks(bars(t), 3600, 0.5, by_colour=True)


def _sig(t):
    return G.crossing_means(bars(t), 5, 20)


def _ticks(t):
    return S.bar_ticks(bars(t), 3600, 0.5)


_SIG = _ma("sig", 5, 20) + ", " + _TICKS.format(a="low", b="high")


@R.query(
    "simulate_plain",
    _SIG + f", rt as (select * from tk where real), e as (select s.symbol, s.ts, s.target, r.bid, r.ask from sig s asof join rt r on s.symbol = r.symbol and s.ts > r.ts), d as (select *, target - coalesce(lag(target) {_w}), 0) as q from e) select symbol, ts, target as position, q as quantity, round(case when q > 0 then ask else bid end, 6) as price from d where q <> 0",
)
def _(t):
    return S.simulate(_sig(t), _ticks(t), S.Tracker()).select("symbol", "ts", "position", "quantity", F.round("price", 6).alias("price"))


_TAKE_STOP = (
    _SIG.replace("with ", "with recursive ", 1)
    + """, u as (select symbol, ts, 0 as kind, null::double as bid, null::double as ask, false as real, target from sig union all select symbol, ts, 1, bid, ask, real, null from tk),
v as (select *, row_number() over (partition by symbol order by ts, kind) as i from u),
f as (select symbol, 0::bigint as i, null::timestamp as ts, 0.0::double as pos, null::double as tp, null::double as sl, null::double as lb, null::double as la, null::double as px, null::varchar as why from v group by 1 union all
select symbol, i, ts, case when kind = 0 and lb is not null then target * 10 when hit is not null then 0 else pos end,
case when kind = 0 and lb is not null then (lb + la) / 2 + target * 20 when hit is not null then null else tp end, case when kind = 0 and lb is not null then (lb + la) / 2 - target * 15 when hit is not null then null else sl end,
case when real then bid else lb end, case when real then ask else la end,
case when kind = 0 and lb is not null and target * 10 <> pos then case when target * 10 > pos then la else lb end when hit = 'take' then tp when hit = 'stop' then case when pos > 0 then ask else bid end end,
case when kind = 0 and lb is not null and target * 10 <> pos then 'signal' else hit end
from (select v.symbol, v.i, v.ts, v.kind, v.bid, v.ask, v.real, v.target, f.pos, f.tp, f.sl, f.lb, f.la,
case when v.kind = 1 and ((f.pos > 0 and v.bid >= f.tp) or (f.pos < 0 and v.ask <= f.tp)) then 'take' when v.kind = 1 and ((f.pos > 0 and v.ask <= f.sl) or (f.pos < 0 and v.bid >= f.sl)) then 'stop' end as hit
from f join v on v.symbol = f.symbol and v.i = f.i + 1)) select symbol, ts, pos as position, round(px, 6) as price, why as comment from f where px is not null"""
)


@R.query("take_stop_fold", _TAKE_STOP)
def _(t):
    return S.simulate(_sig(t), _ticks(t), S.TakeStop(size=10, take_points=20, stop_points=15)).select("symbol", "ts", "position", F.round("price", 6).alias("price"), "comment")


def _levels(t):
    x = I.with_rad(I.with_atr(bars(t), 10), 10, 1.0)
    past = by_symbol().rowsBetween(-9, 0)
    x = x.withColumns({"exit_low": F.min("low").over(past), "exit_high": F.max("high").over(past)})
    cols = {"bar_high": "high", "bar_low": "low", "atr": "atr", "long_stop": "long_stop", "short_stop": "short_stop", "side": "side", "exit_low": "exit_low", "exit_high": "exit_high"}
    # what a bar shows is known from the start of the next one
    return x.select("symbol", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), *[F.col(c).cast("double").alias(n) for n, c in cols.items()]), list(cols)


# trackers, and the same folds as recursive SQL -----------------------------------------------------------------------

_MID = "((lb + la) / 2)"
#: Levels that a bar shows, from the next one on.
_LEVELS = (
    f"l0 as (select *, greatest(high - low, abs(high - lag(close) {_w})), abs(low - lag(close) {_w}))) as tr from bars), "
    f"l1 as (select *, case when count(tr) {_w} rows 9 preceding) = 10 then avg(tr) {_w} rows 9 preceding) end as atr, min(low) {_w} rows 9 preceding) as exit_low, max(high) {_w} rows 9 preceding) as exit_high, "
    f"case when count(high) {_w} rows 9 preceding) = 10 then max(high) {_w} rows 9 preceding) end as hh, case when count(low) {_w} rows 9 preceding) = 10 then min(low) {_w} rows 9 preceding) end as ll from l0), "
    "l2 as (select *, hh - atr as long_stop, ll + atr as short_stop from l1), "
    f"l3 as (select *, case when lag(close) {_w}) < lag(short_stop) {_w}) and close > short_stop then -1 when lag(close) {_w}) > lag(long_stop) {_w}) and close < long_stop then 1 end as s from l2), "
    f"lv as (select symbol, ts + interval 1 hour as ts, high as bar_high, low as bar_low, atr, exit_low, exit_high, long_stop, short_stop, last_value(s ignore nulls) {_w} rows unbounded preceding)::double as side from l3)"
)


_END = "select symbol, ts, (n - 1)::int as seq, position, quantity, round(price, 6) as price, comment, case when position = 0 then round(-sum(quantity * price) over (partition by symbol order by n), 6) end as realised from q"


def _fold(state: dict[str, str], steps: list[dict[str, str]], levels: tuple[str, ...] = (), given: str = _SIG, end: str = _END) -> str:
    """SQL of a tracker: ``state`` its columns and types, ``steps`` what each row does to them in turn.

    The steps see the row (kind 0 signal, 1 tick; ts, us, bid, ask, real, target), the position ``pos``, the executions
    ``ex`` so far of the row, the last real tick (lb, la) and its ``levels`` (l_...), and the tick before (pb, pa).
    """
    cols = {"pos": "double", **state, "lb": "double", "la": "double", "pb": "double", "pa": "double", **{f"l_{n}": "double" for n in levels}}
    row = ("symbol", "i", "ts", "us", "kind", "bid", "ask", "real", "target", "info", *levels)
    x = f"select {', '.join('v.' + c for c in row)}, {', '.join('f.' + c for c in cols)}, []::struct(pos double, px double, why varchar)[] as ex from f join v on v.symbol = f.symbol and v.i = f.i + 1"
    for k, step in enumerate(steps):
        names = [*row, *cols, "ex"]
        x = f"select {', '.join(f'{step[c]} as {c}' if c in step else c for c in names)} from ({x}) s{k}"
    last = {"lb": "case when real then bid else lb end", "la": "case when real then ask else la end", "pb": "coalesce(bid, pb)", "pa": "coalesce(ask, pa)", **{f"l_{n}": f"case when real then {n} else l_{n} end" for n in levels}}
    start = ", ".join(f"{'0' if c == 'pos' else 'null'}::{t} as {c}" for c, t in cols.items())
    src = "tk" if not levels else f"(select tk.*, {', '.join('lv.' + n for n in levels)} from tk asof left join lv on tk.symbol = lv.symbol and tk.ts >= lv.ts)"
    more = "".join(f", {n}" for n in levels)
    return (
        given.replace("with ", "with recursive ", 1)
        + (f", {_LEVELS}" if levels else "")
        + f", u as (select symbol, ts, 0 as kind, null::double as bid, null::double as ask, false as real, target, null::varchar as info{''.join(f', null::double as {n}' for n in levels)} from sig union all select symbol, ts, 1, bid, ask, real, null, null{more} from {src}"
        + (" union all select symbol, ts, -1, null, null, false, null, info from texts), " if "texts as" in given else "), ")
        + f"v as (select *, epoch_us(ts) as us, row_number() over (partition by symbol order by ts, kind) as i from u), "
        + f"f as (select symbol, 0::bigint as i, null::timestamp as ts, {start}, []::struct(pos double, px double, why varchar)[] as ex from v group by 1 union all "
        + f"select symbol, i, ts, {', '.join(last.get(c, c) for c in cols)}, ex from ({x})), "
        + "e as (select symbol, ts, i, unnest(ex) as x, generate_subscripts(ex, 1) as k from f where len(ex) > 0), g as (select symbol, ts, row_number() over (partition by symbol order by i, k) as n, x.pos as position, x.px as price, x.why as comment from e), "
        + "q as (select *, position - coalesce(lag(position) over (partition by symbol order by n), 0) as quantity from g) "
        + end
    )


_GO = "kind = 0 and lb is not null"


def _to(when: str, target: str, price: str, why: str) -> dict[str, str]:
    """The step that trades to a target: nothing is traded where it is the position already."""
    return {"ex": f"case when {when} and pos <> {target} then list_append(ex, {{'pos': {target}, 'px': {price}, 'why': {why}}}) else ex end", "pos": f"case when {when} then {target} else pos end"}


def _signal(size: str, when: str = _GO) -> dict[str, str]:
    return _to(when, f"(target * {size})", f"case when target * {size} > pos then la else lb end", "'signal'")


_IN_TAKE = "(kind = 1 and ((pos > 0 and bid >= {0}) or (pos < 0 and ask <= {0})))"
_IN_STOP = "(kind = 1 and ((pos > 0 and ask <= sl) or (pos < 0 and bid >= sl)))"
_OUT = "case when pos > 0 then ask else bid end"


def _take_stop(exact: bool) -> list[dict[str, str]]:
    hit, out = _IN_TAKE.format("tp"), []
    out.append(_to(hit, "0", "tp", "'take'") | {"tp": f"case when {hit} then null else tp end", "sl": f"case when {hit} then null else sl end"})
    out.append(_to(_IN_STOP, "0", "sl" if exact else _OUT, "'stop'") | {"tp": f"case when {_IN_STOP} then null else tp end", "sl": f"case when {_IN_STOP} then null else sl end"})
    return out


def _set(take: str | None, stop: str | None, when: str = _GO) -> dict[str, str]:
    return {n: f"case when {when} then {v or 'null'} else {n} end" for n, v in (("tp", take), ("sl", stop))}


_PARTS = [f"t{k}" for k in range(1, 4)]


def _partial(parts: list[tuple[str, float]]) -> list[dict[str, str]]:
    """Takes that close a part each, then the stop."""
    out = []
    for name, part in parts:
        hit = _IN_TAKE.format(name)
        left = f"trunc(pos * (1 - {part!r}::double))"
        out.append(_to(hit, left, name, f"case when {left} = 0 then 'take' else 'part take' end") | {name: f"case when {hit} then null else {name} end", "sl": f"case when {hit} and {left} = 0 then null else sl end"})
    out.append(_to(_IN_STOP, "0", _OUT, "'stop'") | {"sl": f"case when {_IN_STOP} then null else sl end"})
    out.append({name: f"case when kind = 1 and pos = 0 then null else {name} end" for name, _ in parts})
    return out


def _orders(kind: str) -> str:
    way = 1 if kind == "stop" else -1
    price = f"(case when target > 0 then la else lb end + sign(target) * {5 * way})"
    up, down = "(pa < op and op <= ask)", "(pb > op and op >= bid)"
    if kind == "limit":
        up, down = "(pa > op and op >= ask)", "(pb < op and op <= bid)"
    fires = f"(kind = 1 and op is not null and case when oq > 0 then {up} else {down} end)"
    return _fold(
        {"op": "double", "oq": "double", "sl": "double", "t1": "double"},
        [
            {"op": f"case when {_GO} then {price} else op end", "oq": f"case when {_GO} then target * 10 else oq end"},
            _to(f"coalesce({fires}, false)", "oq", "op", f"'{kind} order'") | {"sl": f"case when {fires} then op - sign(oq) * 15 else sl end", "t1": f"case when {fires} then op + sign(oq) * 20 else t1 end", "op": f"case when {fires} then null else op end"},
            *_partial([("t1", 1.0)]),
        ],
    )


_LATE = "(kind = 1 and real and pos <> 0 and us - traded >= 21600000000)"


def _expired(size: str) -> list[dict[str, str]]:
    acts = f"{_GO} and pos <> target * {size}"
    return [{"traded": f"case when {acts} then us else traded end"}, _signal(size)]


_ATR = f"({_GO} and l_atr is not null)"
_STOP = _to(_IN_STOP, "0", _OUT, "'stop'") | {"sl": f"case when {_IN_STOP} then null else sl end"}


def _trailing(sided: bool) -> str:
    level = "case when target > 0 then l_long_stop else l_short_stop end"
    ok = f"({_GO} and pos = 0" + (" and not coalesce(l_side * target < 0, false))" if sided else ")")
    tight = "case when pos > 0 then greatest(sl, long_stop) else least(sl, short_stop) end"
    steps = [{"sl": f"case when {ok} then {level} else sl end"}, _signal("10", f"({ok} and {level} is not null)"), _STOP, {"sl": f"case when kind = 1 and real and pos <> 0 then {tight} else sl end"}]
    return _fold({"sl": "double"}, steps, ("long_stop", "short_stop", "side"))


def _signal_bar() -> str:
    price, other = "case when target > 0 then l_bar_high + 0.01::double else l_bar_low - 0.01::double end", "case when target > 0 then l_bar_low - 0.01::double else l_bar_high + 0.01::double end"
    fires = "coalesce(kind = 1 and case when oq > 0 then pa < op and op <= ask else pb > op and op >= bid end, false)"
    better = "(kind = 1 and real and op is not null and case when oq > 0 then bar_high + 0.01::double < op else bar_low - 0.01::double > op end)"
    return _fold(
        {"op": "double", "oq": "double", "os": "double", "sl": "double"},
        [
            {"op": f"case when {_GO} then {price} else op end", "oq": f"case when {_GO} then target * 10 else oq end", "os": f"case when {_GO} then {other} else os end"},
            _to(fires, "oq", "op", "'stop order'") | {"sl": f"case when {fires} then os else sl end", "op": f"case when {fires} then null else op end"},
            _STOP,
            {"op": f"case when {better} then case when oq > 0 then bar_high + 0.01::double else bar_low - 0.01::double end else op end", "os": f"case when {better} then case when oq > 0 then bar_low - 0.01::double else bar_high + 0.01::double end else os end"},
        ],
        ("bar_high", "bar_low"),
    )


def _pyramid(size: int, stop: float, next_: float, adds: str, first: int, most: int, leaves: bool) -> str:
    """``adds``: SQL of what is added at a step ``stp``."""
    ok, price = f"({_ATR} and pos = 0)", "case when target > 0 then la else lb end"
    away = "(kind = 1 and real and ((pos > 0 and bid < exit_low) or (pos < 0 and ask > exit_high)))"
    go = "(kind = 1 and real and pos <> 0 and atr is not null and lvl is not null and case when pos > 0 then bid - lvl else lvl - ask end >= 0)"
    over = f"(go = 1 and (stp > {most} or (stp >= {first} and more = 0)))"
    return _fold(
        {"sl": "double", "lvl": "double", "stp": "bigint", "cost": "double", "go": "int", "more": "double"},
        [
            {"sl": f"case when {ok} then {price} - sign(target) * {stop!r}::double * l_atr else sl end", "lvl": f"case when {ok} then {price} + sign(target) * {next_!r}::double * l_atr else lvl end", "stp": f"case when {ok} then 1 else stp end", "cost": f"case when {ok} then {price} else cost end"},
            _to(ok, f"(sign(target) * {size})", price, "'signal'"),
            _STOP,
            *([_to(away, "0", "case when pos > 0 then bid else ask end", "'exit'") | {"sl": f"case when {away} then null else sl end"}] if leaves else []),
            {"go": f"coalesce({go}, false)::int"},
            {"stp": "stp + go"},
            {"more": f"case when stp >= {first} then {adds} else 0 end"},
            {"go": f"case when {over} then 0 else go end", "lvl": f"case when {over} then null else lvl end"},
            _to("(go = 1 and more > 0)", "(pos + sign(pos) * more)", "case when pos > 0 then ask else bid end", "'step ' || stp") | {"cost": "case when go = 1 and more > 0 then (cost * abs(pos) + case when pos > 0 then ask else bid end * more) / (abs(pos) + more) else cost end"},
            {"sl": f"case when go = 1 then case when more > 0 then cost - sign(pos) * {stop!r}::double * atr else cost end else sl end", "lvl": f"case when go = 1 then lvl + sign(pos) * {next_!r}::double * atr else lvl end"},
        ],
        ("atr", "exit_low", "exit_high"),
    )


def _dispatch() -> str:
    turn = "(kind = -1 and lb is not null and active is distinct from info)"
    far = "case active when 'calm' then 10 when 'wild' then 40 end"
    given = _SIG + f", texts as (select distinct event_type as symbol, date_trunc('day', ts)::timestamp as ts, case when day(ts) % 2 = 0 then 'calm' else 'wild' end as info from events)"
    return _fold(
        {"active": "varchar", "tp": "double", "sl": "double"},
        [
            _to(turn, "0", "case when pos > 0 then lb else la end", "info || ' activated'") | {"active": f"case when {turn} then info else active end", "tp": f"case when {turn} then null else tp end", "sl": f"case when {turn} then null else sl end"},
            _set(f"{_MID} + sign(target) * {far}", f"{_MID} - sign(target) * {far}"),
            _signal("(case active when 'calm' then 10 when 'wild' then 5 else 1 end)"),
            *_take_stop(False),
        ],
        given=given,
    )

_TRACKERS = (
    ("partial_takes", S.PartialTakes(size=12, stop_points=15, ladder=((10, 1 / 3), (20, 1 / 2), (30, 1.0))), False,
     _fold({"sl": "double", **dict.fromkeys(_PARTS, "double")}, [{"sl": f"case when {_GO} then {_MID} - sign(target) * 15 else sl end", **{n: f"case when {_GO} then {_MID} + sign(target) * {10 * k} else {n} end" for k, n in enumerate(_PARTS, 1)}}, _signal("12"), *_partial(list(zip(_PARTS, (1 / 3, 1 / 2, 1.0), strict=True)))])),
    ("stop_orders", S.Triggered(size=10, entry=5, stop_points=15, ladder=((20, 1.0),)), False, _orders("stop")),
    ("limit_orders", S.Triggered(size=10, entry=5, kind="limit", stop_points=15, ladder=((20, 1.0),)), False, _orders("limit")),
    ("fixed_risk_percent", S.TakeStop(size=10, take_points=30, stop_points=20, percent=True, exact=True), False,
     _fold({"tp": "double", "sl": "double"}, [_set(f"{_MID} + sign(target) * 30 * ({_MID} / 100)", f"{_MID} - sign(target) * 20 * ({_MID} / 100)"), _signal("10"), *_take_stop(True)])),
    ("time_expiration", S.Expiring(after_us=6 * 3_600_000_000, size=10), False, _fold({"traded": "bigint"}, [*_expired("10"), _to(_LATE, "0", "case when pos > 0 then bid else ask end", "'expired'")])),
    ("atr_stops", S.AtrStop(size=10, take_multiple=1.0, stop_multiple=0.7), True,
     _fold({"tp": "double", "sl": "double"}, [_set(f"{_MID} + sign(target) * nullif(1.0 * l_atr, 0)", f"{_MID} - sign(target) * nullif(0.7::double * l_atr, 0)", _ATR), _signal("10", _ATR), *_take_stop(False)], ("atr",))),
    ("signal_bar_orders", S.SignalBar(size=10, tick_size=0.01, improve=True), True, _signal_bar()),
    ("trailing_stop", S.Trailing(size=10), True, _trailing(False)),
    ("trailing_sided", S.Trailing(size=10, sided=True), True, _trailing(True)),
    ("pyramiding", S.Pyramid(size=10, stop_multiple=1.0, next_multiple=0.3, most=5), True, _pyramid(10, 1.0, 0.3, "case stp when 3 then 5 when 4 then 2 when 5 then 1 else 0 end", 3, 5, False)),
    ("turtles", S.Turtle(size=5, stop_multiple=2.0, next_multiple=0.2), True, _pyramid(5, 2.0, 0.2, "5", 2, 4, True)),
    ("pipeline_trackers", S.Pipeline(parts=(S.TakeStop(size=10, take_points=20), S.Expiring(after_us=6 * 3_600_000_000))), False,
     _fold({"tp": "double", "sl": "double", "traded": "bigint"}, [_set(f"{_MID} + sign(target) * 20", None), *_expired("10"), {"traded": f"case when {_IN_TAKE.format('tp')} then us else traded end"}, *_take_stop(False)[:1], _to(_LATE, "0", "case when pos > 0 then bid else ask end", "'expired'")])),
)

def _given(x):
    return x.select("symbol", "ts", "seq", "position", "quantity", F.round("price", 6).alias("price"), "comment", F.when(F.col("position") == 0, F.round("realised", 6)).alias("realised"))


for _name, _tracker, _needs, _sql in _TRACKERS:

    @R.query(_name, _sql)
    def _(t, tracker=_tracker, needs=_needs):
        lv, names = _levels(t) if needs else (None, [])
        return _given(S.simulate(_sig(t), _ticks(t), tracker, 0.001, lv, names))


@R.query("dispatch_trackers", _dispatch())
def _(t):
    info = days(t).select("symbol", "ts", F.lit(None).cast("double").alias("target"), F.when(F.dayofmonth("ts") % 2 == 0, "calm").otherwise("wild").alias("info"))
    s = _sig(t).withColumn("info", F.lit(None).cast("string")).unionByName(info)
    return _given(S.simulate(s, _ticks(t), S.Dispatch(trackers={"calm": S.TakeStop(size=10, take_points=10, stop_points=10), "wild": S.TakeStop(size=5, take_points=40, stop_points=40)}, flat=True)))


_GRID = sweep.grid({"fast": [3, 5], "slow": [10, 20, 3]}, "fast < slow")


def _sweep() -> str:
    """The fold of all runs at once: a run's name goes before the symbol's."""
    each = ", ".join(_ma(f"g{k}", p["fast"], p["slow"]).split("from bars), l as", 1)[0].replace(f"with {BARS}, m as", f"m{k} as") + f"from bars), l{k} as" + _ma(f"g{k}", p["fast"], p["slow"]).split("from bars), l as", 1)[1].replace("from m)", f"from m{k})").replace("from l where", f"from l{k} where") for k, p in enumerate(_GRID))
    runs = [sweep.run_id(p) for p in _GRID]
    sig = "sig as (" + " union all ".join(f"select '{r}|' || symbol as symbol, ts, target from g{k}" for k, r in enumerate(runs)) + ")"
    tk = "tk as (select r || '|' || symbol as symbol, ts, bid, ask, real from tk0, (values " + ", ".join(f"('{r}')" for r in runs) + ") as w(r))"
    given = f"with {BARS}, {each}, {_TICKS.format(a='low', b='high').replace('tk as', 'tk0 as', 1)}, {sig}, {tk}"
    end = (
        "z as (select symbol, -sum(quantity * price) + arg_max(position * price, n) as gain, sum(0.001::double * abs(quantity * price)) as fees, count(*) as executions from q group by 1) "
        "select split_part(symbol, '|', 1) as run, round(sum(gain - fees), 6) as gain, round(sum(fees), 6) as fees, sum(executions)::bigint as executions, count(*) filter (gain - fees < 0) as losing, round(sum(gain - fees) / sum(executions), 6) as per_execution from z group by 1"
    )
    return _fold({"tp": "double", "sl": "double"}, [_set(f"{_MID} + sign(target) * 20", f"{_MID} - sign(target) * 15"), _signal("1"), *_take_stop(False)], given=given, end=", " + end).replace(" from g) , z", " from g), z")


@R.query("sweep_runs", _sweep())
def _(t):
    """A grid of parameters as runs of one job."""
    b, s = bars(t), None
    for p in _GRID:
        x = G.crossing_means(b, p["fast"], p["slow"]).withColumn("run", F.lit(sweep.run_id(p)))
        s = x if s is None else s.unionByName(x)
    e = S.simulate(s, _ticks(t), S.TakeStop(size=1, take_points=20, stop_points=15), 0.001, keys=("run", "symbol"))
    g = e.groupBy("run", "symbol").agg(F.max_by("realised", "seq").alias("gain"), F.sum("fee").alias("fees"), F.count(F.lit(1)).alias("executions"))
    return sweep.report(g).withColumns({c: F.round(c, 6) for c in ("gain", "fees", "per_execution")})


@R.query(
    "portfolio_log_sim",
    _SIG
    + f", rt as (select * from tk where real), e as (select s.symbol, s.ts, s.target, r.bid, r.ask from sig s asof join rt r on s.symbol = r.symbol and s.ts > r.ts), d as (select *, target - coalesce(lag(target) {_w}), 0) as q from e), x as (select symbol, ts, q, case when q > 0 then ask else bid end as p from d where q <> 0), "
    + f"c as (select symbol, ts, sum(q) {_w}) as pos, sum(q * p) {_w}) as cost, sum(0.001::double * abs(q * p)) {_w}) as fees from x), mm as (select b.symbol, b.ts, b.close, coalesce(pos, 0) as pos, cost, coalesce(fees, 0) as fees from bars b asof left join c on b.symbol = c.symbol and b.ts >= c.ts), "
    + "k as (select *, case when pos > 0 then close - 0.5 else close + 0.5 end as mark from mm) select symbol, ts, pos, case when pos <> 0 then round(mark, 6) end as price, round(pos * mark, 6) as value, round(coalesce(pos * mark - cost, 0), 6) as pnl, round(fees, 6) as commissions from k",
)
def _(t):
    m = bars(t).select("symbol", "ts", (F.col("close") - 0.5).alias("bid"), (F.col("close") + 0.5).alias("ask"))
    x = S.portfolio_log(S.simulate(_sig(t), _ticks(t), S.Tracker(), 0.001), m)
    return x.select("symbol", "ts", "pos", *[F.round(c, 6).alias(c) for c in ("price", "value", "pnl", "commissions")])


@R.query(
    "convert_cross",
    f"with {BARS}, a as (select ts, symbol as currency, close as amount from bars where symbol in ('click', 'error', 'view', 'signup')), r as (select 'click' as base, 'view' as quote, ts, close + 1 as rate from bars where symbol = 'purchase' union all select 'view', 'click', ts, close + 1 from bars where symbol = 'signup' union all select 'view', 'error', ts, close + 2 from bars where symbol = 'signup'), "
    "k as (select base as currency, ts, rate as k, 1 as way from r where quote = 'view' union all select quote, ts, 1 / rate, 0 from r where base = 'view'), o as (select currency, ts, arg_max(k, way) as k from k group by 1, 2) "
    "select a.ts, a.currency, amount, round(case when a.currency = 'view' then amount else amount * o.k end, 6) as converted from a asof left join o on a.currency = o.currency and a.ts >= o.ts",
)
def _(t):
    b = bars(t)
    a = b.filter("symbol in ('click', 'error', 'view', 'signup')").select("ts", F.col("symbol").alias("currency"), F.col("close").alias("amount"))
    rate = lambda base, quote, of, add: b.filter(F.col("symbol") == of).select(F.lit(base).alias("base"), F.lit(quote).alias("quote"), "ts", (F.col("close") + add).alias("rate"))
    r = rate("click", "view", "purchase", 1).unionByName(rate("view", "click", "signup", 1)).unionByName(rate("view", "error", "signup", 2))
    return S.convert_cross(a, r, "amount", "view").select("ts", "currency", "amount", F.round("amount_converted", 6).alias("converted"))


@R.query("convert_currency", f"with {BARS}, r as (select ts, close as rate from bars where symbol = 'view'), a as (select symbol, ts, close as amount from bars where symbol = 'click') select a.ts, amount, round(amount / nullif(rate, 0), 6) as converted from a asof left join r on a.ts >= r.ts")
def _(t):
    b = bars(t)
    r = b.filter("symbol = 'view'").select(F.lit("click").alias("symbol"), "ts", F.col("close").alias("rate"))
    x = S.convert(b.filter("symbol = 'click'").select("symbol", "ts", F.col("close").alias("amount")), r, "amount", invert=True)
    return x.select("ts", "amount", F.round("amount_converted", 6).alias("converted"))


@R.query("inverse_contracts", "with ex as (select event_type as symbol, (user_id % 5 - 2)::double as quantity, value as price from events where user_id % 5 <> 2 and value > 0), m as (select event_type as symbol, arg_max(value, ts) as price from events group by 1), a as (select symbol, sum(quantity) as q, sum(quantity / price) as c from ex group by 1) select symbol, q, round(c - q / m.price, 6) as pnl from a join m using (symbol)")
def _(t):
    e = t.events.filter("user_id % 5 <> 2 and value > 0").select(F.col("event_type").alias("symbol"), (F.col("user_id") % 5 - 2).cast("double").alias("quantity"), F.col("value").alias("price"))
    m = t.events.groupBy(F.col("event_type").alias("symbol")).agg(F.max_by("value", "ts").alias("price"))
    return S.inverse_pnl(e, m).withColumn("pnl", F.round("pnl", 6))


# streams -----------------------------------------------------------------------------------------------------------

_CLOSED = "lim as (select max(ts) - interval 10 minute as l from events)"


@R.query("stream_bars", f"with {BARS}, {_CLOSED} select bars.* from bars, lim where ts + interval 1 hour <= l")
def _(t):
    return flows.drained(flows.bars(flows.events(t.spark, t.folder), "event_type", "ts", "value", "1 hour", "10 minutes", "event_id"))


@R.query(
    "stream_sessions",
    f"with d as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as n from events), g as (select user_id, ts, sum(n) over (partition by user_id order by ts) as g from d), s as (select user_id, min(ts) as start, max(ts) as last, count(*) as rows from g group by user_id, g), {_CLOSED} select user_id, start, rows from s, lim where last + interval 2 hour <= l",
)
def _(t):
    return flows.drained(flows.sessions(flows.events(t.spark, t.folder), "user_id", "ts", "2 hours", "10 minutes"))


_EMA = "x as (select event_type, ts, value as v, row_number() over (partition by event_type order by ts) as i from events), a as (select event_type, i, v as e from x where i = 1 union all select x.event_type, x.i, a.e + 2.0::double / 11 * (x.v - a.e) from a join x on x.event_type = a.event_type and x.i = a.i + 1)"


@R.query("stream_ema", f"with recursive {_EMA} select x.event_type, x.ts, round(a.e, 6) as value from x join a using (event_type, i)")
def _(t):
    x = flows.drained(flows.stepped(flows.events(t.spark, t.folder), "event_type", "ts", "value", lambda: smoothers.Ema(10, seeded=False)))
    return x.select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("value", 6).alias("value"))


def _live(t, *steps):
    x = flows.drained(flows.live(flows.events(t.spark, t.folder), "event_type", "ts", "value", "event_id", 3_600_000_000, lambda: N.Several(*(s() for s in steps)), "10 minutes"))
    names = [c for c in x.columns if c not in ("event_type", "ts")]
    return x.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.when(~F.isnan(c), F.round(c, 6)).alias(c) for c in names])


_TILL = "where ts + interval 1 hour <= (select max(ts) - interval 10 minute from events)"


def _full(col: str, n: int, expr: str) -> str:
    return f"case when count({col}) {_w} rows {n - 1} preceding) = {n} then {expr} end"


_BANDS = f"""with {BARS}, r as (select *, greatest(high - low, abs(high - lag(close) {_w})), abs(low - lag(close) {_w}))) as tr from bars),
m as (select *, {_full('close', 14, f'avg(close) {_w} rows 13 preceding)')} as m, {_full('tr', 10, f'avg(tr) {_w} rows 9 preceding)')} as a from r), d as (select *, power(close - m, 2) as d from m),
z as (select *, {_full('d', 14, f'sqrt(sum(d) {_w} rows 13 preceding) / 13)')} as s from d)
select symbol, ts, round(a, 6) as atr, round(m - 2 * s, 6) as lower, round(m + 2 * s, 6) as upper, round(m - 1.5 * a, 6) as lower_atr, round(m + 1.5 * a, 6) as upper_atr from z {_TILL}"""


@R.query("stream_bands", _BANDS)
def _(t):
    return _live(t, lambda: N.Atr(10), lambda: N.Bollinger(14, 2.0), lambda: N.BollingerAtr(14, 10, 1.5))


_RANGES = f"""with {BARS}, z as (select symbol, ts, {_full('low', 5, f'min(low) {_w} rows 4 preceding)')} as low, {_full('high', 5, f'max(high) {_w} rows 4 preceding)')} as high,
min(low) over (partition by symbol, ts::date order by ts) as day_low, max(high) over (partition by symbol, ts::date order by ts) as day_high,
{_full('low', 9, f'(max(high) {_w} rows 8 preceding) - close) / nullif(max(high) {_w} rows 8 preceding) - min(low) {_w} rows 8 preceding), 0) * -100')} as williams,
{', '.join(_full('close', 20, f'quantile_cont(close, {q / 100}) {_w} rows 19 preceding)') + f' as p{q}' for q in (5, 50, 95))} from bars)
select symbol, ts, {', '.join(f'round({c}, 6) as {c}' for c in ('low', 'high', 'day_low', 'day_high', 'williams', 'p5', 'p50', 'p95'))} from z {_TILL}"""


@R.query("stream_ranges", _RANGES)
def _(t):
    return _live(t, lambda: N.MinMax(5), N.DayRange, lambda: N.WilliamsR(9), lambda: N.Percentiles(20, (5, 50, 95)))


def _denoised(n: int) -> str:
    return f"case when lag(open, {n}) {_w}) is not null then abs(close - lag(open, {n}) {_w})) * (close - lag(open, {n}) {_w})) / nullif(greatest(sum(abs(close - open)) {_w} rows {n} preceding), abs(close - lag(open, {n}) {_w}))), 0) end"


_TRENDS = f"""with {BARS}, d as (select symbol, ts, {_denoised(5)} as f, {_denoised(12)} as s from bars), k as (select *, f - s as k from d where f - s is not null),
q as (select *, {', '.join(f'quantile_cont(k, {p / 10}) {_w} rows between 19 preceding and 1 preceding) as q{p}' for p in range(1, 11))}, count(k) {_w} rows between 19 preceding and 1 preceding) as n from k),
r as (select symbol, ts, case when n = 19 then sign(s) * ({' + '.join(f'(q{p} <= k)::int' for p in range(1, 11))}) end as rank from q), m as ({{}})
select d.symbol, d.ts, m.value as macd, round(s, 6) as trend, rank::double as rank from d left join r using (symbol, ts) left join m using (symbol, ts) {_TILL.replace('ts +', 'd.ts +', 1)}"""


@R.query("stream_trends", _TRENDS.format(technical.R.sql["macd"]))
def _(t):
    return _live(t, N.Macd, lambda: N.Denoised(12), lambda: N.DeltaRank(5, 12, 20))


@R.query("stream_expirations", f"with {_CLOSED} select user_id, date_trunc('milliseconds', max(ts))::timestamp as ts from events, lim group by user_id, l having date_trunc('milliseconds', max(ts)) + interval 1 hour <= l")
def _(t):
    return flows.drained(flows.expirations(flows.events(t.spark, t.folder), "user_id", "ts", 3_600_000, "10 minutes")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@R.query("moving_min_max_daily", f"with {BARS} select symbol, ts, max(high) {_w} rows 4 preceding) as hi, min(low) {_w} rows 4 preceding) as lo from bars")
def _(t):
    return bars(t).select("symbol", "ts", F.max("high").over(trailing(by_symbol(), 5)).alias("hi"), F.min("low").over(trailing(by_symbol(), 5)).alias("lo"))
