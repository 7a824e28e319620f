"""Scalar expressions on numbers, names, times and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up(x: Column, step: float) -> Column:
    """Up to the next multiple of ``step``."""
    return F.ceil(x / step) * F.lit(float(step))


def round_down(x: Column, step: float) -> Column:
    """Toward zero to a multiple of ``step``."""
    return (x / step).cast("bigint") * F.lit(float(step))


def hour_in_range(ts: Column, start: int, end: int) -> Column:
    """Whether the hour lies between two hours; a start after the end goes past midnight."""
    h = F.hour(ts)
    return (h >= start) | (h <= end) if start > end else (h >= start) & (h <= end)


#: Notations of dates, with and without a time of day.
_DATES = ("yyyy-MM-dd", "yyyy.MM.dd", "yyyy/MM/dd", "yyyyMMdd", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yyyy", "d-MMM-yyyy", "d-MMM-yy", "d MMM yyyy")
_TIMES = ("", " HH:mm:ss", " HH:mm", " HH:mm:ss.SSS", "'T'HH:mm:ss", "'T'HH:mm:ss.SSS")


def parse_time(text: Column) -> Column:
    """A text in one of the notations, the first that fits to its end; else null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(d + t)) for d in _DATES for t in _TIMES]).cast("timestamp_ntz")


def ago(text: str, now: Column) -> Column:
    """``now``, or so many weeks, days, hours or minutes before it: ``-5d``, ``-3h``."""
    if text == "now":
        return now
    unit = {"w": "weeks", "d": "days", "h": "hours", "m": "minutes"}[text[-1]]
    return now + F.expr(f"interval {int(text[:-1])} {unit}")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_millis(n: Column) -> Column:
    return F.timestamp_millis(n).cast("timestamp_ntz")


def at_time(ts: Column, hour: int = 0, minute: int = 0, second: int = 0) -> Column:
    """The day of a time at another time of day."""
    return F.date_trunc("day", ts).cast("timestamp_ntz") + F.expr(f"interval {hour * 3600 + minute * 60 + second} seconds")


def floor_time(ts: Column, seconds: int) -> Column:
    """Down to a multiple of so many seconds since 1970."""
    us = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(us - F.pmod(us, F.lit(seconds * 1_000_000))).cast("timestamp_ntz")


def ceil_time(ts: Column, seconds: int) -> Column:
    us = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_micros(us + F.pmod(-us, F.lit(seconds * 1_000_000))).cast("timestamp_ntz")


def compact_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy.MM.dd")


def compact_time(ts: Column, digits: int = 0) -> Column:
    return F.date_format(ts, "yyyy.MM.dd'D'HH:mm:ss" + ("." + "S" * digits if digits else ""))


def duration_text(us: Column) -> Column:
    """Microseconds as days, hours, minutes and seconds without the zero parts: ``1D2H``."""
    s = F.floor(F.abs(us) / 1_000_000)
    parts = ((86_400, 10**9, "D"), (3_600, 24, "H"), (60, 60, "Min"), (1, 60, "S"))
    out = F.concat(*[F.when((n := F.floor(s / size) % mod) > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("") for size, mod, unit in parts])
    return F.when(us.isNotNull(), F.concat(F.when(us < 0, "-").otherwise(""), F.when(out == "", "0S").otherwise(out)))


def before_close(seconds: int) -> Column:
    """How long before a bar's end its close counts: a second, or a tenth of a bar of up to a second."""
    if seconds >= 86_400:
        raise ValueError("daily bars have no close within the day")
    return F.make_dt_interval(secs=F.lit(1 if seconds > 1 else seconds / 10).cast("decimal(18,6)"))


def bar_close(ts: Column, seconds: int) -> Column:
    """The time at which a bar that starts at ``ts`` counts as closed."""
    return ts + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")) - before_close(seconds)


def encode_name(x: Column) -> Column:
    """A name without the characters that a store's names can't have."""
    return F.replace(F.replace(F.replace(x, F.lit("."), F.lit("__dot__")), F.lit("-"), F.lit("__dash__")), F.lit("/"), F.lit("__slash__"))


def decode_name(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("__dot__"), F.lit(".")), F.lit("__dash__"), F.lit("-")), F.lit("__slash__"), F.lit("/"))


def short_id(*parts: Column, length: int = 10) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def exchange_of(name: Column) -> Column:
    """The part before the colon of ``EXCH:SYMBOL``; null without one."""
    return F.when(name.contains(":"), F.substring_index(name, ":", 1))
