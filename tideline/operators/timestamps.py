"""Mixed timestamp notations and time zones, brought to one UTC instant.

An ordered cascade of anchored patterns: the date is matched first, what is
left must be a time of day in full, what is left of that a zone. Nothing is
parsed leniently: a text that a pattern doesn't cover to its end, an impossible
date or an unknown zone gives null.

Policy for local readings: one that occurs twice is the earlier instant; one
that the zone's clock skips gives null. All of it is built-in expressions, so
the rows never leave the JVM and nothing is shuffled.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import small, us

#: Minutes east of UTC of the zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "BST": 60, "WET": 0, "WEST": 60,
    "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "JST": 540, "IST": 330,
}

_EDGE = r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff\"'`\u2018\u2019\u201c\u201d\u00ab\u00bb]+"
_WEEKDAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+)?"

#: kind, pattern anchored at the start, and how its groups become "year|month|day|rest".
DATES = (
    ("ymd", r"^(\d{4})([-./])(\d{1,2})\2(\d{1,2})(?!\d)", "$1|$3|$4|"),
    ("ymd", r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1|$2|$3|"),
    ("mdy", r"^(\d{1,2})([-./])(\d{1,2})\2(\d{4}|\d{2})(?!\d)", "$4|$1|$3|"),
    ("dmy", r"^(\d{1,2})([-./])(\d{1,2})\2(\d{4}|\d{2})(?!\d)", "$4|$3|$1|"),
    ("yy", r"^(\d{2})([-./])(\d{1,2})\2(\d{2})(?!\d)", "$1|$3|$4|"),
    ("name", rf"(?i)^{_WEEKDAY}(\d{{1,2}})(?:[-\s/.]+|(?=[A-Za-z]))([A-Za-z]{{3,9}})\.?[-\s/,.]*(\d{{4}}|\d{{2}})(?!\d)", "$3|$2|$1|"),
    ("name", rf"(?i)^{_WEEKDAY}([A-Za-z]{{3,9}})\.?\s*(\d{{1,2}})(?:,\s*|\s+)(\d{{4}}|\d{{2}})(?!\d)", "$3|$1|$2|"),
)

#: What may follow the date: a separator, a time of day, AM or PM, a zone.
_TIME = (
    r"(?i)^(?:T|D|-|:|,?\s+)\s*"
    r"(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)"
    r"(?:\s*([AP])\.?M\.?)?"
    r"\s*(?:(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?|(Z|[A-Za-z]{2,5}|[A-Za-z]+(?:/[A-Za-z_+\-0-9]+)+))?$"
)
_TIME_PARTS = "$1$5|$2$6|$3$7|$4$8|$9|$10|$11|$12|$13"
_MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def clean(text: Column) -> Column:
    """Without the white space and quotation marks around it; blank becomes null."""
    t = F.regexp_replace(F.regexp_replace(text, "^" + _EDGE, ""), _EDGE + "$", "")
    return F.when(t != "", t)


def _int(text: Column, default: int | None = None) -> Column:
    n = F.when(text != "", text).try_cast("int")
    return n if default is None else F.coalesce(n, F.lit(default))


def _months() -> Column:
    """Numbers of months by number, by name and by each of its beginnings from three letters on."""
    names = {w[:n]: k for k, w in enumerate(_MONTH_NAMES, 1) for n in range(3, len(w) + 1)} | {"sept": 9}
    names |= {f"{k}": k for k in range(1, 13)} | {f"{k:02d}": k for k in range(1, 13)}
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def _with_date(df: DataFrame, text: str, day_order: str) -> DataFrame:
    """Adds ``_t`` (cleaned text), ``_y``, ``_m``, ``_d`` and ``_rest``, each step its own projection."""
    df = df.withColumn("_t", clean(F.col(text)))
    t, order, cut = F.col("_t"), F.coalesce(F.col(day_order), F.lit("")), None
    for kind, pattern, form in DATES:
        own = {"mdy": order == "mdy", "dmy": order == "dmy", "yy": order == "ymd"}.get(kind, F.lit(True))
        hit, value = own & t.rlike(pattern), F.regexp_replace(t, pattern, form)
        cut = F.when(hit, value) if cut is None else cut.when(hit, value)
    df = df.withColumn("_cut", F.split(cut, r"\|", 4))
    part = lambda k: F.get(F.col("_cut"), F.lit(k))
    return df.withColumns({
        "_y": _int(part(0)) + F.when(F.length(part(0)) == 2, 2000).otherwise(0),
        "_m": F.try_element_at(_months(), F.lower(part(1))),
        "_d": _int(part(2)),
        "_rest": part(3),
    }).drop("_cut")


def _epoch_us(t: Column) -> Column:
    """Texts of digits only: seconds, milli-, micro- or nanoseconds by their length."""
    n, k = t.try_cast("decimal(38,0)"), F.length(t)
    value = F.when(k <= 11, n * 1_000_000).when(k <= 14, n * 1_000).when(k <= 17, n).when(k <= 20, F.floor(n / 1_000))
    return F.when(t.rlike(r"^\d{1,20}$"), value.try_cast("bigint"))


def _known(zone: Column) -> Column:
    """The zone if it is a region that exists, in any letter case."""
    z = F.trim(zone)
    return F.when(z.isin(sorted(n for n in available_timezones() if n[0].isupper() and not n.startswith("System") and n not in ("Factory", "localtime"))), z)


def local_to_utc_us(local: Column, zone: Column) -> Column:
    """Microseconds of a local reading: the earlier of two, null if it is skipped."""
    utc = F.convert_timezone(zone, F.lit("UTC"), local)
    return F.when(F.convert_timezone(F.lit("UTC"), zone, utc) == local, us(utc))


_STEPS = ("_t", "_y", "_m", "_d", "_rest", "_hms", "_hour", "_minute", "_second", "_micros", "_east", "_region", "_local")


def with_instant(df: DataFrame, out: str, text: str, tz: str, zone: str, day_order: str) -> DataFrame:
    """``df`` and ``out``: microseconds since 1970 UTC of ``text``, null where it determines no instant.

    A zone in the text goes first, then ``tz``, then ``zone``, then UTC. What the
    text leaves out is zero. A text with a zone that is unknown gives null; an
    unknown or blank ``tz`` or ``zone`` counts as missing. Each step is a
    projection of its own, so that no pattern is evaluated twice.
    """
    df = _with_date(df, text, day_order)
    rest = F.col("_rest")
    df = df.withColumn("_hms", F.when(rest == "", F.array(*[F.lit("")] * 9)).when(rest.rlike(_TIME), F.split(F.regexp_replace(rest, _TIME, _TIME_PARTS), r"\|")))
    g = [F.get(F.col("_hms"), F.lit(k)) for k in range(9)]
    half, hour, known = F.upper(g[4]), _int(g[0], 0), F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    df = df.withColumns({
        "_hour": F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0)),
        "_minute": _int(g[1], 0),
        "_second": _int(g[2], 0),
        "_micros": F.rpad(F.substring(g[3], 1, 6), 6, "0").cast("int"),
        "_east": F.when(g[5] != "", F.when((_int(g[6]) <= 18) & (_int(g[7], 0) < 60), F.when(g[5] == "-", -1).otherwise(1) * (_int(g[6]) * 60 + _int(g[7], 0)))).otherwise(F.try_element_at(known, F.upper(g[8]))),
        "_region": F.when(F.concat(g[5], g[8]) == "", F.coalesce(_known(F.col(tz)), _known(F.col(zone)), F.lit("UTC"))).when(g[8].contains("/"), _known(g[8])),
    })
    ok = F.col("_hms").isNotNull() & F.col("_hour").between(0, 23) & F.col("_minute").between(0, 59) & F.col("_second").between(0, 59) & F.col("_y").between(1, 9999)
    seconds = (F.col("_second") + F.col("_micros") / F.lit(1_000_000)).cast("decimal(16,6)")
    df = df.withColumn("_local", F.when(ok, F.try_make_timestamp_ntz(F.col("_y"), F.col("_m"), F.col("_d"), F.col("_hour"), F.col("_minute"), seconds)))
    instant = F.when(F.col("_east").isNotNull(), us(F.col("_local")) - F.col("_east").cast("bigint") * 60_000_000).otherwise(local_to_utc_us(F.col("_local"), F.col("_region")))
    return df.withColumn(out, F.when(F.col("_t").rlike(r"^\d+$"), _epoch_us(F.col("_t"))).otherwise(instant)).drop(*_STEPS)


def with_day(df: DataFrame, out: str, text: str, day_order: str) -> DataFrame:
    """``df`` and ``out``: microseconds of 00:00 UTC of the calendar date that ``text`` names."""
    df = _with_date(df, text, day_order)
    ok = ((F.col("_rest") == "") | F.col("_rest").rlike(_TIME)) & F.col("_y").between(1, 9999)
    day = F.try_make_timestamp_ntz(F.col("_y"), F.col("_m"), F.col("_d"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    return df.withColumn(out, F.when(ok, us(day))).drop(*_STEPS)


def _feed_settings(feeds: DataFrame) -> DataFrame:
    own = feeds.groupBy(F.col("feed").alias("_feed")).agg(F.max("zone").alias("_zone"), F.max("day_order").alias("_order"))
    return small(own)


def _packed(df: DataFrame, key: str, feeds: DataFrame, *used: str) -> DataFrame:
    """The used columns beside the whole row, so that no other column's name can clash."""
    x = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col("feed").alias("_own"), *[F.col(c).alias(f"_in_{c}") for c in used])
    return x.join(_feed_settings(feeds), F.col("_own") == F.col("_feed"), "left")


def _own() -> Column:
    """Tells apart records without an id, none of which repeats another; null for the others."""
    return F.when(F.col("_key").isNull(), F.monotonically_increasing_id())


def _unpacked(x: DataFrame, names: list[str]) -> DataFrame:
    x = x.select("_row", "_key", _own().alias("_own_id"), F.col("_utc_us").alias("_out")).dropDuplicates(["_key", "_own_id"])
    return x.select(*[F.col(f"_row.`{n}`").alias(n) for n in names if n != "utc_us"], F.col("_out").alias("utc_us"))


def _quotes(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    return with_instant(_packed(raw, "rec_id", feeds, "time", "tz"), "_utc_us", "_in_time", "_in_tz", "_zone", "_order")


def _bars(bars: DataFrame, feeds: DataFrame) -> DataFrame:
    return with_day(_packed(bars, "bar_id", feeds, "date"), "_utc_us", "_in_date", "_order")


def normalise_quotes(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    """``raw`` with ``utc_us``: one row per record (``rec_id``), repeats dropped.

    Null, empty and unusable times give a null ``utc_us``. Records of a feed that
    ``feeds`` doesn't have count as UTC and, for dates that begin with neither
    year nor a month's name, as undetermined. Other columns pass unchanged; one
    named ``utc_us`` is replaced. A record with a null id repeats no other one.
    Repeats are dropped after the parsing: the exchange keeps a later filter on
    ``utc_us`` from being pushed into the cascade and evaluated many times over.
    """
    return _unpacked(_quotes(raw, feeds), raw.columns)


def normalise_bars(bars: DataFrame, feeds: DataFrame) -> DataFrame:
    """``bars`` with ``utc_us`` (00:00 UTC of the date), one row per ``bar_id``; else as above."""
    return _unpacked(_bars(bars, feeds), bars.columns)


def found(raw: DataFrame, bars: DataFrame, feeds: DataFrame) -> DataFrame:
    """``tab``, ``rec_id``, ``utc_us`` of every record whose text determines an instant.

    Only ids and instants go through the exchange that drops repeats.
    """
    parts = []
    for tab, x in (("raw_quotes", _quotes(raw, feeds)), ("daily_bars", _bars(bars, feeds))):
        once = x.select(F.col("_key").cast("bigint").alias("_key"), _own().alias("_own_id"), "_utc_us").groupBy("_key", "_own_id").agg(F.max("_utc_us").alias("utc_us"))
        parts.append(once.filter(F.col("utc_us").isNotNull()).select(F.lit(tab).alias("tab"), F.col("_key").alias("rec_id"), "utc_us"))
    return parts[0].unionByName(parts[1])
