"""Queries of sources, sinks and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import checkpoint_dir
from ..sources import catalog as C
from .base import BARS, bars
from .registry import Registry

R = Registry()


def _catalog(t):
    c = C.Catalog(t.spark)
    c.add("quotes", "parquet", path=f"{t.folder}/quotes.parquet", time="time")
    c.add("bars", "memory", frame=bars(t))
    return c


def _folder(t) -> str:
    path = f"{checkpoint_dir(t.spark).rstrip('/')}/tideline-{uuid.uuid4().hex}"
    p = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


@R.query("catalog_load", "select distinct symbol, time as ts, quote_id, bid, ask from quotes where symbol in ('BTCUSDT', 'ETCETH') and time between timestamp '2010-03-01 06:00:00' and timestamp '2010-03-01 18:00:00'")
def _(t):
    return _catalog(t).load("quotes", ["btcusdt", "etceth"], "2010-03-01 06:00:00", "2010-03-01 18:00:00").select("symbol", "ts", "quote_id", "bid", "ask").distinct()


@R.query("catalog_symbols", "select distinct symbol from quotes where regexp_matches(symbol, '(?i)^btc')")
def _(t):
    return _catalog(t).symbols("quotes", "^btc")


@R.query("catalog_last_rows", f"with {BARS} select symbol, ts, close from (select *, row_number() over (partition by symbol order by ts desc) as n from bars where symbol in ('click', 'view')) where n <= 5")
def _(t):
    return _catalog(t).last("bars", ["CLICK", "VIEW"], 5).select("symbol", "ts", "close")


@R.query("time_ranges", 'select symbol, min(time) as start, max(time) as "end", count(*) as rows from quotes group by 1')
def _(t):
    return _catalog(t).ranges("quotes")


@R.query("quote_changes", "select quote_id from (select *, row_number() over w as n, lag(b) over w as b1, lag(a) over w as a1 from (select symbol, time, min(quote_id) as quote_id, coalesce(arg_min(bid::varchar, quote_id), '') as b, coalesce(arg_min(ask::varchar, quote_id), '') as a from (select distinct symbol, time, quote_id, coalesce(bid::varchar, '') as bid, coalesce(ask::varchar, '') as ask from quotes) group by 1, 2) window w as (partition by symbol order by time)) where n = 1 or a <> a1 or b <> b1")
def _(t):
    return C.quote_changes(t.quotes).select("quote_id")


@R.query("csv_round_trip", f"with {BARS} select symbol, ts, round(close, 6) as close from bars")
def _(t):
    path = _folder(t)
    C.export_csv(bars(t).select("symbol", "ts", "close"), path)
    c = C.Catalog(t.spark)
    c.register("folder", lambda path: t.spark.read.option("header", True).schema("ts timestamp_ntz, close double, symbol string").csv(path))
    c.add("out", "folder", path=path)
    return c.load("out").select(F.col("symbol"), "ts", F.round("close", 6).alias("close"))


@R.query("store_append_new", f"with {BARS} select symbol, ts, close from bars")
def _(t):
    path, b = _folder(t), bars(t).select("symbol", "ts", "close")
    C.append_new(b.filter("ts < timestamp_ntz'2024-01-15 00:00:00'"), path, t.spark)
    C.append_new(b, path, t.spark)
    return t.spark.read.parquet(path).select("symbol", "ts", "close")


@R.query("store_verbs", f"with {BARS} select symbol, ts, close from bars where close > 20 and symbol <> 'view' order by close desc, ts, symbol limit 10 offset 5")
def _(t):
    s = C.Store(t.spark, _folder(t))
    b = bars(t).select("symbol", "ts", "close")
    s.save("bars", b.filter("symbol = 'click'"))
    s.append("bars", b.filter("symbol <> 'click'"))
    s.delete("bars", "symbol = 'view'")
    return s.load("bars", "close > 20", [F.col("close").desc(), "ts", "symbol"], 5, 10)


@R.query("adjusted_bars", f"with {BARS} select symbol, ts, round(open * 0.5, 6) as open, round(close * 0.5, 6) as close from bars where close <> 0")
def _(t):
    x = C.adjusted(bars(t).filter("close <> 0").withColumn("adj_close", F.col("close") * 0.5))
    return x.select("symbol", "ts", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"))


_LEGS = ("etceth", "ltcbtc", "xmrbtc", "zecbtc")


@R.query("portfolio_long", " union all ".join(f"select run, date, '{s}' as symbol, {s}_pos as pos, {s}_price as price from (select distinct on (run, log_id) * from portfolio_log)" for s in _LEGS))
def _(t):
    return C.wide_to_long(t.portfolio_log.dropDuplicates(["run", "log_id"]), _LEGS, ("pos", "price"), ("run", "date"))


@R.query("portfolio_wide", "select run, date, max(etceth_pos) as etceth_pos, max(ltcbtc_pos) as ltcbtc_pos from portfolio_log group by 1, 2")
def _(t):
    x = C.wide_to_long(t.portfolio_log, _LEGS, ("pos",), ("run", "date"))
    return C.long_to_wide(x, ("etceth", "ltcbtc"), ("pos",), ("run", "date"))


@R.query("rounding", "select event_id, ceil(value / 0.5) * 0.5 as up, trunc(value / 0.25) * 0.25 as down from events")
def _(t):
    return t.events.select("event_id", X.round_up(F.col("value"), 0.5).alias("up"), X.round_down(F.col("value"), 0.25).alias("down"))


@R.query("time_functions", "select event_id, epoch_us(ts) // 1000 as ms, time_bucket(interval 15 minute, ts) as floor15, case when time_bucket(interval 15 minute, ts) = ts then ts else time_bucket(interval 15 minute, ts) + interval 15 minute end as ceil15, date_trunc('day', ts) + interval 9 hour as at9, strftime(ts, '%Y.%m.%d') as day, (hour(ts) >= 22 or hour(ts) <= 3) as night, time_bucket(interval 1 hour, ts) + interval 3599 second as close_at from events")
def _(t):
    ts = F.col("ts")
    return t.events.select("event_id", X.millis(ts).alias("ms"), X.floor_time(ts, 900).alias("floor15"), X.ceil_time(ts, 900).alias("ceil15"), X.at_time(ts, 9).alias("at9"), X.compact_date(ts).alias("day"), X.hour_in_range(ts, 22, 3).alias("night"), X.bar_close(X.floor_time(ts, 3600), 3600).alias("close_at"))


@R.query("parse_times", "select event_id, date_trunc('second', ts) as t from events")
def _(t):
    k, ts = F.col("event_id") % 4, F.col("ts")
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "dd-MM-yyyy'T'HH:mm:ss", "yyyyMMdd HH:mm:ss")
    text = F.when(k == 0, F.date_format(ts, forms[0])).when(k == 1, F.date_format(ts, forms[1])).when(k == 2, F.date_format(ts, forms[2])).otherwise(F.date_format(ts, forms[3]))
    return t.events.select("event_id", X.parse_time(text).alias("t"))


@R.query("durations", "with d as (select event_id, user_id, epoch_us(ts - lag(ts) over (partition by user_id order by ts)) // 1000000 as s from events) select event_id, case when s is null then null when s = 0 then '0S' else case when s >= 86400 then (s // 86400)::varchar || 'D' else '' end || case when s // 3600 % 24 > 0 then (s // 3600 % 24)::varchar || 'H' else '' end || case when s // 60 % 60 > 0 then (s // 60 % 60)::varchar || 'Min' else '' end || case when s % 60 > 0 then (s % 60)::varchar || 'S' else '' end end as d from d")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return t.events.withColumn("us", us).select("event_id", X.duration_text(F.col("us")).alias("d"))


@R.query("names_round_trip", "select distinct instrument as decoded, replace(instrument, '/', '__slash__') as encoded from instruments")
def _(t):
    e = X.encode_name(F.col("instrument"))
    return t.instruments.select(X.decode_name(e).alias("decoded"), e.alias("encoded")).distinct()


@R.query("short_ids", "select event_id, substring(sha256(event_type || '|' || user_id::varchar), 1, 10) as id from events")
def _(t):
    return t.events.select("event_id", X.short_id(F.col("event_type"), F.col("user_id")).alias("id"))


@R.query("weighted_mid", "select distinct quote_id, (case when coalesce(bidvol, 0) + coalesce(askvol, 0) > 0 then (bid * coalesce(askvol, 0) + ask * coalesce(bidvol, 0)) / (coalesce(bidvol, 0) + coalesce(askvol, 0)) else (bid + ask) / 2 end) as mid from quotes where bid is not null and ask is not null and not isnan(bid) and not isnan(ask) and isfinite(ask)")
def _(t):
    from ..operators.resample import weighted_mid

    z = F.lit(0)
    q = t.quotes.filter("bid is not null and ask is not null and not isnan(bid) and not isnan(ask) and abs(ask) <> double('infinity')")
    return q.select("quote_id", weighted_mid(F.col("bid"), F.col("ask"), F.coalesce("bidvol", z), F.coalesce("askvol", z)).alias("mid")).distinct()
