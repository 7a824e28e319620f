"""Bars of the ``events`` table, as DataFrame and as SQL, that many queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import by_symbol
from ..operators.resample import bars as _bars

#: Hourly bars of each event type.
BARS = """bars as (select event_type as symbol, time_bucket(interval 1 hour, ts) as ts, arg_min(value, ts) as open, max(value) as high, min(value) as low,
arg_max(value, ts) as close, count(*)::double as volume from events group by 1, 2)"""
#: Daily bars of each event type, and the simple returns of their closes.
DAYS = """days as (select event_type as symbol, date_trunc('day', ts) as ts, arg_max(value, ts) as close, sum(value) as total, count(*) as n from events group by 1, 2)"""
RETURNS = DAYS + ", rets as (select *, close / lag(close) over (partition by symbol order by ts) - 1 as r from days)"


def bars(t, freq: str = "1 hour") -> DataFrame:
    return _bars(t.events, "event_type", "ts", F.col("value"), freq, "event_id")


def days(t) -> DataFrame:
    x = t.events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
    return x.agg(F.max_by("value", "ts").alias("close"), F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def returns(t) -> DataFrame:
    return days(t).withColumn("r", F.col("close") / F.lag("close").over(by_symbol()) - 1)
