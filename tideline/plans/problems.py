"""Queries of the general data problems p1 to p5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, nearest, rolling_tiles, spikes, timestamps
from .registry import Registry

R = Registry()

_DAILY = """with l as (select distinct run, log_id, cast(date as date) as d, case when not isnan(etceth_pnl) then cast(round(etceth_pnl * 100) as bigint) end as c from portfolio_log where date is not null),
dd as (select run, d, coalesce(sum(c), 0) as c from l group by 1, 2), s as (select run, min(d) as a, max(d) as b from dd group by 1),
k as (select run, cast(unnest(generate_series(a, b, interval 1 day)) as date) as d from s),
x as (select k.run, k.d, coalesce(c, 0) as c from k left join dd on k.run = dd.run and k.d = dd.d),
y as (select run, strftime(d, '%Y-%m-%d') as day, cast(sum(c) over (partition by run order by d rows 6 preceding) as bigint) as total7_cents,
  cast(sum(c) over (partition by run order by d rows 29 preceding) as bigint) as total30_cents from x)
"""


_P1 = r"""with f as (select feed, max(zone) as zone, max(day_order) as o from feeds group by 1),
ab as (select * from (values ('Z', 0), ('UTC', 0), ('GMT', 0), ('BST', 60), ('CET', 60), ('CEST', 120), ('EET', 120), ('EEST', 180), ('EST', -300), ('EDT', -240), ('CST', -360), ('CDT', -300), ('JST', 540), ('IST', 330)) as v(abbr, east)),
r as (select distinct rec_id, feed, time, tz from raw_quotes where time is not null),
c as (select rec_id, regexp_replace(regexp_replace(time, '^[\s"]+', ''), '[\s"]+$', '') as s, coalesce(tz, zone, 'UTC') as z, o from r left join f using (feed)),
k as (select *, regexp_extract(s, '\d(?:\.\d+)?\s*([A-Z]{1,4})$', 1) as word, regexp_extract(s, '\d{2}:?\d{2}(?:\.\d+)?\s*([+-]\d{2}:?\d{2})$', 1) as off from c),
m as (select *, case when word in ('AM', 'PM') then '' else word end as w from k),
b as (select m.*, case when off <> '' then (case when off[1] = '-' then -1 else 1 end) * (off[2:3]::int * 60 + off[-2:]::int) else ab.east end as east, regexp_replace(regexp_replace(regexp_replace(
 case when off <> '' then rtrim(s[:-length(off) - 1]) when w <> '' then rtrim(s[:-length(w) - 1]) else s end, '^(\d{4}\.\d\d\.\d\d)D', '\1 '), '(:\d\d),(\d+)$', '\1.\2'), '(\.\d{6})\d+$', '\1') as t from m left join ab on m.w = ab.abbr),
l as (select *, case when not regexp_full_match(s, '\d+') then coalesce(try_strptime(t, ['%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%Y.%m.%d %H:%M:%S.%f', '%Y.%m.%d %H:%M:%S', '%Y/%m/%d %H:%M:%S', '%Y%m%d-%H:%M:%S.%f', '%Y%m%dT%H%M%S.%f', '%d-%b-%y %H:%M:%S', '%a, %d %b %Y %H:%M:%S']),
 case when o = 'mdy' then try_strptime(t, ['%m/%d/%Y %I:%M:%S %p', '%m/%d/%Y %H:%M:%S']) when o = 'dmy' then try_strptime(t, '%d/%m/%Y %H:%M:%S') end) end as lt from b where w = '' or east is not null),
u as (select rec_id, s, case when regexp_full_match(s, '\d+') then case length(s) when 10 then s::bigint * 1000000 when 13 then s::bigint * 1000 when 16 then s::bigint when 19 then s::bigint // 1000 end
 when east is not null then epoch_us(lt) - east * 60000000::bigint else (select case when timezone(z, make_timestamptz(x - 3600000000)) = lt then x - 3600000000 when timezone(z, make_timestamptz(x)) = lt then x end from (select epoch_us(timezone(z, lt)) as x)) end as v from l),
d as (select distinct bar_id, feed, date from daily_bars where date is not null), e as (select bar_id, regexp_replace(regexp_replace(date, '^[\s"]+', ''), '[\s"]+$', '') as s, o from d left join f using (feed)),
g as (select bar_id, coalesce(try_strptime(s, ['%Y-%m-%d', '%Y%m%d', '%Y-%m-%dT%H:%M:%S', '%d %b %Y', '%Y.%m.%d', '%b %d, %Y', '%d-%b-%y', '%Y/%m/%d']), case when o = 'mdy' then try_strptime(s, '%m/%d/%Y') when o = 'dmy' then try_strptime(s, '%d/%m/%Y') end) as v from e)
select 'raw_quotes' as tab, rec_id, v as utc_us from u where v is not null union all select 'daily_bars', bar_id, epoch_us(v) from g where v is not null"""


@R.query("p1_found", _P1)
def _p1(t):
    return timestamps.found(t.raw_quotes, t.daily_bars, t.feeds)


@R.query("p2_found", _DAILY + "select run, day, total7_cents, total30_cents from y")
def _p2(t):
    return rolling_tiles.pnl_totals(t.portfolio_log).select("run", "day", "total7_cents", "total30_cents")


@R.query("p2_averages", _DAILY + "select run, day, round(total7_cents / 700.0, 6) as avg7, round(total30_cents / 3000.0, 6) as avg30 from y")
def _p2_averages(t):
    return rolling_tiles.pnl_totals(t.portfolio_log).select("run", "day", "avg7", "avg30")


_CELLS = """with q as (select symbol, epoch_us(time) as t, (bid is not null and ask is not null and not isnan(bid) and not isnan(ask)) as ok from quotes where time is not null),
x as (select q.symbol, t // 86400000000 as d, (t % 86400000000) // (grid_sec * 1000000::bigint) as c, ok, grid_sec * 1000000::bigint as len from q join instruments using (symbol)),
s as (select symbol, d, len, min(c) as a, max(c) as b from x group by all), k as (select symbol, d, len, unnest(generate_series(a, b)) as c from s),
u as (select distinct symbol, d, c from x where ok)
"""


@R.query("p3_found", _CELLS + "select symbol, cast(d * 86400000000 + c * len as bigint) as period_us from k anti join u using (symbol, d, c)")
def _p3(t):
    return grid.found(t.quotes, t.instruments)


_STEPS = """, r as (select distinct symbol, epoch_us(time) as t, quote_id, bid, ask from quotes where time is not null and bid is not null and ask is not null and not isnan(bid) and not isnan(ask)),
h as (select symbol, t, case when isfinite(bid) then bid end as bid, case when isfinite(ask) then ask end as ask, coalesce(lead(t) over (partition by symbol order by t, quote_id), 9000000000000000000) as e from r),
c as (select symbol, d * 86400000000 + c * len as a, least(d * 86400000000 + (c + 1) * len, (d + 1) * 86400000000) as z from k),
o as (select c.symbol, a, z, h.t >= a and h.t < z as inside, case when h.t is not null then greatest(least(h.e, z) - greatest(h.t, a), 0) end::double as w, bid, ask from c left join h on c.symbol = h.symbol and h.t < z and (h.e > a or h.t >= a)),
g as (select symbol, a, z, coalesce(sum(inside::int), 0)::bigint as n, coalesce(sum(w), 0) as w, sum(w * bid) / nullif(sum(case when bid is not null then w end), 0) as b, sum(w * ask) / nullif(sum(case when ask is not null then w end), 0) as k from o group by 1, 2, 3)
select symbol, cast(a as bigint) as period_us, n as n_rows, round(b, 6) as bid_twa, round(k, 6) as ask_twa, round(w / (z - a), 9) as coverage, case when n > 0 then 'observed' when w > 0 then 'filled' else 'empty' end as state from g"""


@R.query("p3_grid", _CELLS + _STEPS)
def _p3_grid(t):
    g = grid.regular_grid(t.quotes, t.instruments)
    return _rounded(g)


def _rounded(g):
    return g.withColumns({"bid_twa": F.round("bid_twa", 6), "ask_twa": F.round("ask_twa", 6), "coverage": F.round("coverage", 9)})


#: All periods from a symbol's first to its last row.
_WHOLE = _CELLS.replace("k as (select symbol, d, len, unnest(generate_series(a, b)) as c from s)", """e as (select symbol, len, min(d) as d0, max(d) as d1, arg_min(a, d) as a, arg_max(b, d) as b from s group by 1, 2), y as (select *, unnest(generate_series(d0, d1)) as d from e),
k as (select symbol, d, len, unnest(generate_series(case when d = d0 then a else 0 end, case when d = d1 then b else (86400000000 - 1) // len end)) as c from y)""")
#: A reading holds for six hours at most.
_HELD = _STEPS.replace("9000000000000000000) as e", "9000000000000000000) as e0").replace("from r),\nc as", "from r),\nh as (select *, least(e0, t + 21600000000) as e from h0),\nc as", 1).replace("\nh as (select symbol, t, case", "\nh0 as (select symbol, t, case", 1)


@R.query("p3_series", _WHOLE + _HELD)
def _p3_series(t):
    return _rounded(grid.regular_grid(t.quotes, t.instruments, hold_us=6 * 3_600_000_000, whole=True))


@R.query(
    "p4_found",
    r"""with n as (select upper(symbol) as n, symbol as s, tol_ms from instruments union select upper(instrument), symbol, tol_ms from instruments),
f as (select distinct fill_id, s, time, tol_ms * 1000::bigint as tol from fills join n on upper(regexp_replace(instrument, '^\s+|\s+$', '', 'g')) = n),
q as (select distinct symbol as s, time, quote_id from quotes),
b as (select f.*, q.quote_id as qb, epoch_us(f.time) - epoch_us(q.time) as db from f asof left join q on f.s = q.s and f.time >= q.time),
a as (select b.*, q.quote_id as qa, epoch_us(q.time) - epoch_us(b.time) as da from b asof left join q on b.s = q.s and b.time <= q.time)
select fill_id, case when da is null or db <= da then qb else qa end as quote_id from a where least(coalesce(da, tol + 1), coalesce(db, tol + 1)) <= tol""",
)
def _p4(t):
    return nearest.found(t.fills, t.quotes, t.instruments)


@R.query("p5_found")
def _p5(t):
    return spikes.found(t.quotes, t.fills, t.daily_bars, t.instruments, t.feeds)


@R.query("p5_by_flag")
def _p5_by_flag(t):
    x = spikes.implausible(spikes.readings(t.quotes, t.fills, t.daily_bars, t.instruments, t.feeds))
    return x.groupBy("tab", "flag").agg(F.count(F.lit(1)).alias("readings"))
