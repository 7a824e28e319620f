"""As-of, range and alignment joins.

The as-of joins cut both sides into shards of key and time. In a shard the two
sides lie in one ordered sequence, and the last (or next) right row is carried
over it; what holds at a shard's edge comes from a table of one row per shard.
So a key that holds a third of all rows spreads over its shards, and nothing is
compared pairwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import so_far, us
from .rolling import with_index


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], direction: str = "backward", strict: bool = False, shard: str = "1 day", seq: str | None = None, tolerance_us: int | None = None) -> DataFrame:
    """``left`` with ``columns`` and ``right_ts`` of the right row that its time refers to.

    backward: the last row at or before the time; forward: the first at or after
    it; ``strict`` leaves out equal times. Of right rows with equal times the one
    with the largest (backward) or smallest (forward) ``seq`` counts. Left rows
    without match keep nulls; left rows with a null time or key match nothing.
    """
    back = direction == "backward"
    width = F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00' + interval {shard}) - unix_micros(timestamp'1970-01-01 00:00:00')")
    names = list(left.columns)
    value = F.struct(us(F.col(ts)).alias("t"), (F.lit(0) if seq is None else F.col(seq)).alias("s"), F.col(ts).alias("right_ts"), *[F.col(c).alias(f"r_{c}") for c in columns])
    r = right.filter(F.col(ts).isNotNull()).select(*keys, us(F.col(ts)).alias("_t"), value.alias("_r"))
    lt = left.select(*keys, us(F.col(ts)).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_l"))
    both = lt.select(*keys, "_t", F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), "_l", F.lit(True).alias("_is")).unionByName(r.withColumn("_is", F.lit(False)), allowMissingColumns=True)
    both = both.withColumn("_shard", F.floor(F.col("_t") / width))
    # equal times: the right row first if it may match, else the left one
    left_first = strict if back else not strict
    rank = F.when(F.col("_is"), 0 if left_first else 1).otherwise(1 if left_first else 0)
    # forward from the end: a frame that runs from the row to the end would be gone through anew for every row
    order = [c if back else c.desc() for c in (F.col("_t"), rank, F.col("_r.s"))]
    w = Window.partitionBy(*keys, "_shard").orderBy(*order)
    own = both.withColumn("_m", F.last("_r", ignorenulls=True).over(so_far(w))).filter("_is")
    edge = r.groupBy(*keys, F.floor(F.col("_t") / width).alias("_shard")).agg((F.max if back else F.min)("_r").alias("_e"))
    # the nearest shard with right rows before (after) each shard that has left rows
    shards = lt.select(*keys, F.floor(F.col("_t") / width).alias("_shard")).distinct().withColumn("_e", F.lit(None).cast(edge.schema["_e"].dataType)).withColumn("_want", F.lit(True))
    marks = edge.withColumn("_want", F.lit(False)).unionByName(shards)
    ws = Window.partitionBy(*keys).orderBy(F.col("_shard") if back else -F.col("_shard"), F.col("_want").desc()).rowsBetween(Window.unboundedPreceding, -1)
    held = marks.withColumn("_h", F.last("_e", ignorenulls=True).over(ws)).filter("_want").select(*keys, "_shard", "_h")
    x = own.join(held, [*keys, "_shard"], "left").withColumn("_m", F.coalesce("_m", "_h"))
    if tolerance_us is not None:
        x = x.withColumn("_m", F.when(F.abs(F.col("_m.t") - F.col("_t")) <= tolerance_us, F.col("_m")))
    return x.select(*[F.col(f"_l.`{c}`").alias(c) for c in names], *[F.col(f"_m.r_{c}").alias(c if c not in names else f"right_{c}") for c in columns], F.col("_m.right_ts").alias("right_ts"))


def forward_values(df: DataFrame, key: str, ts: str, value: str, period: str, back: bool = False) -> DataFrame:
    """``later`` (or earlier): the value known at the row's time plus (minus) ``period``.

    Null within a period of the key's last (first) time.
    """
    step = F.expr(f"interval {period}")
    span = df.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    probe = df.join(span, key).filter(F.col(ts) >= F.col("_a") + step if back else F.col(ts) <= F.col("_z") - step)
    probe = probe.select(key, F.col(ts).alias("_at"), F.col(value).alias("_now"), (F.col(ts) - step if back else F.col(ts) + step).alias(ts))
    hit = asof_join(probe, df.select(key, ts, F.col(value).alias("_later")), [key], ts, ["_later"])
    return hit.select(key, F.col("_at").alias(ts), F.col("_now").alias(value), F.col("_later").alias("earlier" if back else "later"))


def align(frames: dict[str, DataFrame], on: Sequence[str], column: str) -> DataFrame:
    """Full outer alignment of one column of several frames: one column per frame's name.

    A union and one grouped pivot, however many frames there are.
    """
    parts = [f.select(*on, F.lit(n).alias("_n"), F.col(column).alias("_v")) for n, f in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*on).agg(*[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(n) for n in frames])


def range_join(intervals: DataFrame, points: DataFrame, key: str, start: str, end: str, ts: str, shard_us: int = 86_400_000_000) -> DataFrame:
    """Intervals with the points inside them (both ends included), by shards of time.

    An interval goes to each shard that it touches, a point to its own: an
    equi-join on key and shard with the exact test after it.
    """
    at = lambda c: F.floor(us(F.col(c)) / shard_us)
    a = intervals.filter(F.col(start) <= F.col(end)).withColumn("_shard", F.explode(F.sequence(at(start), at(end))))
    b = points.withColumn("_shard", at(ts))
    return a.join(b, [key, "_shard"]).filter((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))).drop("_shard")


def combine_portfolios(*logs: DataFrame) -> DataFrame:
    """One portfolio of several: positions, PnL, values and commissions add up, prices average."""
    x = logs[0]
    for y in logs[1:]:
        x = x.unionByName(y)
    return x.groupBy("symbol", "ts").agg(F.sum("pos").alias("pos"), F.sum("pnl").alias("pnl"), F.avg("price").alias("price"), F.sum("value").alias("value"), F.sum("commissions").alias("commissions"))


def near_points(df: DataFrame, points: DataFrame, key: str, ts: str, before: int, after: int, inside: bool = True) -> DataFrame:
    """Rows at most ``before`` rows ahead of and ``after`` rows behind a marked one (or all others).

    Rows are numbered by shards of time; each mark gives the numbers around it.
    """
    x = with_index(df, [key], [ts])
    marks = x.select(key, ts, "_i").join(points.select(key, ts).distinct(), [key, ts], "left_semi")
    near = marks.select(F.col(key).alias("_key"), F.explode(F.sequence(F.col("_i") - before, F.col("_i") + after)).alias("_j")).distinct()
    return x.join(near, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_i") == F.col("_j")), "left_semi" if inside else "left_anti").drop("_i")


def flat_prices(b: DataFrame, freq: str, session: tuple[str, str] | None = None) -> DataFrame:
    """A price series from bars: the open at the start, the close a second before the end.

    With a ``session`` (offsets of its start and end in the day) daily bars get these times.
    """
    first, last = (F.expr(f"interval {session[0]}"), F.expr(f"interval {session[1]}")) if session else (F.expr("interval 0 seconds"), F.expr(f"interval {freq} - interval 1 second"))
    points = F.array(F.struct((F.col("ts") + first).alias("ts"), F.col("open").alias("price")), F.struct((F.col("ts") + last).alias("ts"), F.col("close").alias("price")))
    return b.select("symbol", F.inline(points))


def density(df: DataFrame, ts: str, period: str) -> DataFrame:
    """Mean number of rows per symbol and non-empty period."""
    n = df.groupBy("symbol", F.date_trunc(period, F.col(ts)).alias("_p")).count()
    return n.groupBy("symbol").agg(F.avg("count").alias("density"))


def first_match(df: DataFrame, column: str, rules: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` fits one of the patterns, with the number of the first that fits."""
    hit: Column = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        hit = F.when(F.col(column).rlike(rule), k).otherwise(hit)
    return df.withColumn("rule", hit).filter(F.col("rule").isNotNull())
