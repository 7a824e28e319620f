"""Window expressions over ordered rows of a symbol: frames, ranks, regressions, runs.

Each takes a window ``w`` (partition and order); expressions over one ``w`` share
one exchange and one sort. Frames are null until they are full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import full, so_far, trailing, us

#: The stretch of time of a shard.
SHARD_US = 86_400_000_000


def rolling_sum(x: Column, w, n: int) -> Column:
    """Sum of n rows where nulls add nothing; null on the first n - 1 rows."""
    return F.when(F.row_number().over(w) >= n, F.sum(F.coalesce(x, F.lit(0.0))).over(trailing(w, n)))


def sma(x: Column, w, n: int) -> Column:
    return full(x, w, n, F.avg(x).over(trailing(w, n)))


def wma(x: Column, w, n: int, weights: Sequence[float] | None = None) -> Column:
    """Mean weighted linearly (the newest row most) or by ``weights`` from old to new."""
    weights = list(weights or range(1, n + 1))
    total = float(sum(weights))
    s = sum((F.lag(x, n - 1 - k).over(w) * F.lit(v / total) for k, v in enumerate(weights)), F.lit(0.0))
    return s


def stdev(x: Column, w, n: int) -> Column:
    return full(x, w, n, F.stddev_pop(x).over(trailing(w, n)))


def vwap(price: Column, volume: Column, w, n: int) -> Column:
    total = F.sum(volume).over(trailing(w, n))
    return F.when(total > 0, F.sum(price * volume).over(trailing(w, n)) / total)


def percentiles(x: Column, w, n: int, levels: Sequence[float]) -> Column:
    """Exact percentiles of the frame by linear interpolation, as an array."""
    return full(x, w, n, F.percentile(x, F.array(*map(F.lit, levels))).over(trailing(w, n)))


def percent_rank(x: Column, w, n: int) -> Column:
    """How many of the n - 1 rows before are below the row, in hundredths of n."""
    held = F.collect_list(x).over(w.rowsBetween(-(n - 1), -1))
    return F.when(F.row_number().over(w) >= n, F.size(F.filter(held, lambda v: v < x)) * 100.0 / n)


def rank_bucket(x: Column, w, n: int, levels: Sequence[float] = (0.25, 0.5, 0.75)) -> Column:
    """How many of the percentiles of the n rows before lie at or below the row."""
    past = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(past) == n, F.size(F.filter(F.percentile(x, F.array(*map(F.lit, levels))).over(past), lambda v: v <= x)))


def with_slope(df: DataFrame, x: str, w, n: int, past: bool = False, out: str = "slope") -> DataFrame:
    """Slope and r2 of n rows on their numbers; ``past`` leaves out the row itself."""
    frame = w.rowsBetween(-n, -1) if past else trailing(w, n)
    i = df.withColumn("_i", F.row_number().over(w).cast("double"))
    ok = F.count(x).over(frame) == n
    return i.withColumns({out: F.when(ok, F.regr_slope(x, "_i").over(frame)), f"{out}_r2": F.when(ok, F.regr_r2(x, "_i").over(frame))}).drop("_i")


def correlation(x: Column, y: Column, w, n: int) -> Column:
    """Correlation of the frame, from its moments; null where either side is constant."""
    f = trailing(w, n)
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    a, b = F.when(both == 1, x), F.when(both == 1, y)
    value = F.covar_pop(a, b).over(f) / F.nullif(F.stddev_pop(a).over(f) * F.stddev_pop(b).over(f), F.lit(0.0))
    return F.when(F.count(both).over(f) == n, value)


def true_range(w) -> Column:
    prev = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def stochastic(w, n: int) -> Column:
    lo, hi = F.min("low").over(trailing(w, n)), F.max("high").over(trailing(w, n))
    return F.when((F.row_number().over(w) >= n) & (hi > lo), 100 * (F.col("close") - lo) / (hi - lo))


def with_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: Column, out: str = "run") -> DataFrame:
    """Numbers the runs of equal ``state`` (null equals null) of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_st", state)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col("_st").eqNullSafe(F.lag("_st").over(w))).cast("int"))
    return x.withColumn("_new", new).withColumn(out, F.sum("_new").over(so_far(w))).drop("_st", "_new")


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str) -> DataFrame:
    """Signed length of the current streak of rises or falls; 0 without a change."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_sg", F.coalesce(F.signum(F.col(x) - F.lag(x).over(w)), F.lit(0.0)))
    r = with_runs(d, keys, order, F.col("_sg"), "_run")
    n = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order))
    return r.withColumn("streak", (F.col("_sg") * n).cast("int")).drop("_sg", "_run")


def periods(df: DataFrame, keys: Sequence[str], ts: str, condition: Column) -> DataFrame:
    """Start, end and rows of each run in which the condition holds."""
    r = with_runs(df, keys, [ts], F.coalesce(condition, F.lit(False)), "_run").filter(condition)
    return r.groupBy(*keys, "_run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("rows")).drop("_run")


def fractals(df: DataFrame, w, n: int) -> DataFrame:
    """Highs above (lows below) the n bars on both sides, shown n bars later, when they are known."""
    beside = [k for k in range(-n, n + 1) if k]
    up = F.col("high") > F.greatest(*[F.lag("high", k).over(w) for k in beside])
    dn = F.col("low") < F.least(*[F.lag("low", k).over(w) for k in beside])
    whole = F.lag("high", n).over(w).isNotNull() & F.lead("high", n).over(w).isNotNull()
    x = df.withColumns({"_u": F.when(whole & up, F.col("high")), "_d": F.when(whole & dn, F.col("low"))})
    return x.withColumns({"fractal_up": F.lag("_u", n).over(w), "fractal_down": F.lag("_d", n).over(w)}).drop("_u", "_d")


def crossed_up(x: Column, level: Column, w) -> Column:
    return (x > level) & (F.lag(x).over(w) <= F.lag(level).over(w))


def crossed_down(x: Column, level: Column, w) -> Column:
    return (x < level) & (F.lag(x).over(w) >= F.lag(level).over(w))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], shard_us: int = SHARD_US) -> DataFrame:
    """``_prev``: the columns of the key's row before (null on its first row), by shards of time.

    ``order``: the time and what orders equal times. A key's rows spread over its
    shards; what stands before a shard comes from a table of one row per shard.
    Rows without time come first; null keys are one key.
    """
    key, shard = F.struct(*keys) if keys else F.struct(F.lit(0)), F.coalesce(F.floor(us(F.col(order[0])) / shard_us), F.lit(-(1 << 60)))
    x = df.withColumns({"_wp_k": key, "_wp_sh": shard})
    w, value = Window.partitionBy("_wp_k", "_wp_sh").orderBy(*order), F.struct(*columns)
    edge = x.groupBy("_wp_k", "_wp_sh").agg(F.max_by(value, F.struct(*order)).alias("_wp_last"))
    edge = edge.select("_wp_k", "_wp_sh", F.lag("_wp_last").over(Window.partitionBy("_wp_k").orderBy("_wp_sh")).alias("_wp_edge"))
    x = x.withColumns({"_wp_in": F.lag(value).over(w), "_wp_n": F.row_number().over(w)}).join(edge, ["_wp_k", "_wp_sh"], "left")
    return x.withColumn("_prev", F.when(F.col("_wp_n") == 1, F.col("_wp_edge")).otherwise(F.col("_wp_in"))).drop("_wp_k", "_wp_sh", "_wp_in", "_wp_n", "_wp_edge")


def with_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "_i", shard_us: int = SHARD_US) -> DataFrame:
    """The number of each row in its key's order, from 1 on, by shards of time as above."""
    key, shard = F.struct(*keys), F.coalesce(F.floor(us(F.col(order[0])) / shard_us), F.lit(-(1 << 60)))
    x = df.withColumns({"_wi_k": key, "_wi_sh": shard})
    n = x.groupBy("_wi_k", "_wi_sh").agg(F.count(F.lit(1)).alias("_wi_c"))
    n = n.select("_wi_k", "_wi_sh", (F.sum("_wi_c").over(so_far(Window.partitionBy("_wi_k").orderBy("_wi_sh"))) - F.col("_wi_c")).alias("_wi_before"))
    x = x.withColumn("_wi_n", F.row_number().over(Window.partitionBy("_wi_k", "_wi_sh").orderBy(*order))).join(n, ["_wi_k", "_wi_sh"], "left")
    return x.withColumn(out, F.col("_wi_n") + F.col("_wi_before")).drop("_wi_k", "_wi_sh", "_wi_n", "_wi_before")


def last_rows(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The n last rows of each key. Spark keeps n rows of a key in each task before it shuffles, so a key's size doesn't matter."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def one_per_time(df: DataFrame, keys: Sequence[str], ts: str, seq: str, keep: str = "first") -> DataFrame:
    """One row per key and time: the first or last by ``seq``."""
    order = F.col(seq) if keep == "first" else F.col(seq).desc()
    w = Window.partitionBy(*keys, ts).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def spread_equal_times(df: DataFrame, keys: Sequence[str], ts: str, seq: str) -> DataFrame:
    """Rows with equal times are moved a microsecond apart, in order of ``seq``."""
    w = Window.partitionBy(*keys, ts).orderBy(seq)
    return df.withColumn(ts, F.col(ts) + F.make_dt_interval(secs=((F.row_number().over(w) - 1) / F.lit(1_000_000)).cast("decimal(18,6)")))


def changes_only(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows in which one of the columns differs from the row before; the first row stays."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
    return with_previous(df, [key], order, columns).filter(F.col("_prev").isNull() | ~same).drop("_prev")
