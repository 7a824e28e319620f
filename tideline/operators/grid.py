"""Irregular readings onto a regular grid, by validity intervals.

Each usable reading holds from its time to the next usable reading's: a step
function. Its intervals are intersected with the cells of the grid; a cell gets
the time-weighted averages, the fraction of it that the steps cover and the
number of readings that fall into it. Work is split by source and UTC day, so a
source that holds a third of the rows spreads over its days; the reading that
holds across midnight comes from a table of one row per source and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import small, us, valid

DAY_US = 86_400_000_000


def regular_grid(quotes: DataFrame, grid: DataFrame, hold_us: int | None = None, whole: bool = False) -> DataFrame:
    """One row per source, day and period from the day's first to its last row.

    ``quotes``: symbol, time, bid, ask and, for the order of equal times,
    quote_id. ``grid``: symbol, grid_sec. Columns: symbol, period_us (start),
    n_rows (usable readings in the period), bid_twa and ask_twa (time-weighted,
    null where nothing holds), coverage (0 to 1), state (``observed``,
    ``filled`` from an earlier reading, ``empty``).

    A reading is usable with bid and ask neither null nor NaN; an infinite price
    counts as present but adds nothing to the average. A reading holds until the
    next usable one, however late that comes, or, where ``hold_us`` is named, for
    at most that long; periods beyond are then ``empty``. With ``whole`` the
    series also has the periods between a day's last row and the next day's
    first one and the days without rows. Repeated rows count once, rows without
    time or with a symbol that ``grid`` lacks or gives no positive length are
    left out. Of readings with equal times the one with the largest quote_id
    holds on.
    """
    g = grid.filter(F.col("grid_sec") > 0).groupBy(F.col("symbol").alias("_s")).agg((F.max("grid_sec").cast("bigint") * 1_000_000).alias("_len"))
    q = quotes.select("symbol", us(F.col("time")).alias("t"), F.col("quote_id").alias("id"), valid(F.col("bid")).alias("bid"), valid(F.col("ask")).alias("ask"), F.col("bid").isNotNull() & ~F.isnan("bid") & F.col("ask").isNotNull() & ~F.isnan("ask"))
    q = q.toDF("symbol", "t", "id", "bid", "ask", "ok").filter(F.col("t").isNotNull())
    q = q.withColumn("day", F.floor(F.col("t") / DAY_US)).join(small(g, grid), F.col("symbol") == F.col("_s")).drop("_s")
    # one exchange, which both uses below share as they need all of its columns; the aggregates and windows cluster by symbol and day too
    q = q.repartition("symbol", "day").distinct()
    base = F.col("day") * DAY_US
    cell = lambda t: F.floor((t - base) / F.col("_len"))
    days = q.groupBy("symbol", "day", "_len").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max(F.when(F.col("ok"), F.struct("t", "id", "bid", "ask"))).alias("last"))
    if whole:
        ordered = Window.partitionBy("symbol").orderBy("day")
        days = days.withColumns({"_next": F.lead("day").over(ordered), "_first": F.row_number().over(ordered) == 1})
        days = days.withColumn("_day", F.explode(F.sequence("day", F.greatest(F.coalesce(F.col("_next") - 1, F.col("day")), F.col("day")))))
        own, at = F.col("_day") == F.col("day"), F.col("_day") * DAY_US
        days = days.select(
            "symbol", F.col("_day").alias("day"), "_len",
            F.when(own & F.col("_first"), F.col("lo")).otherwise(at).alias("lo"), F.when(F.col("_next").isNull(), F.col("hi")).otherwise(at + DAY_US - 1).alias("hi"), F.when(own, F.col("last")).alias("last"),
        )
    before = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("carry", F.last("last", ignorenulls=True).over(before))
    # what holds at the day's start is a step that begins there
    start = days.filter(F.col("carry").isNotNull()).select("symbol", "day", "_len", F.lit(None).cast("bigint").alias("real"), base.alias("t"), F.col("carry.id").alias("id"), F.col("carry.bid").alias("bid"), F.col("carry.ask").alias("ask"), F.col("carry.t").alias("since"))
    steps = q.filter("ok").select("symbol", "day", "_len", F.col("t").alias("real"), "t", "id", "bid", "ask", F.col("t").alias("since")).unionByName(start)
    w = Window.partitionBy("symbol", "day").orderBy("t", F.col("real").asc_nulls_first(), "id")
    end = F.coalesce(F.lead("t").over(w), base + DAY_US)
    steps = steps.withColumn("end", end if hold_us is None else F.least(end, F.col("since") + hold_us))
    steps = steps.withColumn("end", F.greatest("end", "t"))
    last = F.greatest(cell(F.col("t")), cell(F.col("end") - 1))
    pieces = steps.withColumn("cell", F.explode(F.sequence(cell(F.col("t")), last)))
    begin = base + F.col("cell") * F.col("_len")
    held = (F.least("end", begin + F.col("_len"), base + DAY_US) - F.greatest("t", begin)).cast("double")
    inside = F.col("real").isNotNull() & (F.col("cell") == cell(F.col("t")))
    cells = pieces.withColumns({"w": held, "in": inside.cast("bigint")}).groupBy("symbol", "day", "_len", "cell").agg(
        F.sum("in").alias("n"), F.sum("w").alias("w"), *[f(c) for c in ("bid", "ask") for f in (lambda c: F.sum(F.col("w") * F.col(c)).alias(f"sum_{c}"), lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("w"))).alias(f"w_{c}"))]
    )
    wanted = days.select("symbol", "day", "_len", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    out = wanted.join(cells, ["symbol", "day", "_len", "cell"], "left")
    size = F.least(F.col("_len"), F.lit(DAY_US) - F.col("cell") * F.col("_len")).cast("double")
    n, some = F.coalesce("n", F.lit(0)), F.col("w") > 0
    return out.select(
        "symbol",
        begin.alias("period_us"),
        n.alias("n_rows"),
        *[F.when(F.col(f"w_{c}") > 0, F.col(f"sum_{c}") / F.col(f"w_{c}")).alias(f"{c}_twa") for c in ("bid", "ask")],
        F.coalesce(F.col("w") / size, F.lit(0.0)).alias("coverage"),
        F.when(n > 0, "observed").when(some, "filled").otherwise("empty").alias("state"),
    )


def found(quotes: DataFrame, instruments: DataFrame) -> DataFrame:
    """``symbol``, ``period_us`` of the periods without a usable reading."""
    return regular_grid(quotes, instruments).filter(F.col("state") != "observed").select("symbol", "period_us")
