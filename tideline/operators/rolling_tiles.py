"""Rolling totals per entity and day, over days with and without activity.

Values are summed per entity and day first (with map-side combine). The days of
an entity are cut into tiles; each tile also gets the ``halo`` days before it,
so that tiles are independent of one another and a long history of one entity
spreads over many tasks. A batch of tiles becomes one dense numpy block
(tiles x days), which is multiplied by a banded matrix for each period.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a tile.
TILE = 128
#: Tiles multiplied at a time.
BLOCK = 512


def band(days: int, halo: int, window: int) -> np.ndarray:
    """The operator that sums ``window`` days: ``halo + days`` rows, ``days`` columns."""
    source, target = np.arange(halo + days)[:, None], np.arange(days)[None, :] + halo
    return ((source <= target) & (source > target - window)).astype(np.float64)


def _blocks(batches: Iterator[pa.RecordBatch], tile: int, windows: Sequence[int]) -> Iterator[pa.RecordBatch]:
    halo = max(windows) - 1
    bands = {w: band(tile, halo, w) for w in windows}
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            n = part.num_rows
            offsets, values = part.column("_at"), part.column("_v")
            sizes = np.diff(offsets.offsets.to_numpy())
            block = np.zeros((n, halo + tile))
            block[np.repeat(np.arange(n), sizes), offsets.flatten().to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(zero_copy_only=False)
            exact = np.abs(block).sum(axis=1).max(initial=0) < 2**53
            whole = block if exact else np.zeros(block.shape, dtype=np.int64)
            if not exact:
                whole[np.repeat(np.arange(n), sizes), offsets.flatten().to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(zero_copy_only=False)
            lo = part.column("_lo").to_numpy(zero_copy_only=False)
            hi = part.column("_hi").to_numpy(zero_copy_only=False)
            days = np.arange(tile)[None, :]
            keep = (days >= lo[:, None]) & (days <= hi[:, None])
            row, col = np.nonzero(keep)
            out = {"_row": row, "_day": part.column("_tile").to_numpy(zero_copy_only=False)[row] * tile + col}
            for w in windows:
                out[f"total{w}"] = (whole @ bands[w].astype(whole.dtype))[row, col].astype(np.int64)
            taken = part.column("_entity").take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [taken, pa.array(out["_day"], pa.int64()), *(pa.array(out[f"total{w}"], pa.int64()) for w in windows)],
                names=["_entity", "_day", *(f"total{w}" for w in windows)],
            )


def rolling_totals(df: DataFrame, entity: str, ts: str, value: Column, windows: Sequence[int] = (7, 30), tile: int = TILE, key: Sequence[str] = ()) -> DataFrame:
    """``entity``, ``day`` (days since 1970) and ``total<n>`` for each period of n days.

    One row per entity and UTC day from the first to the last day on which the
    entity has a row. ``value`` is a whole number (say, cents); a null adds
    nothing, and so does a day without rows. Rows with a null ``ts`` are left
    out; a null entity is an entity of its own. With ``key``, rows that agree in
    the entity, these columns, day and value count once. An empty table gives no
    rows. Both uses of the rows below need all their columns, so that they share
    one scan and one exchange.
    """
    halo = max(windows) - 1
    if halo >= tile:
        raise ValueError("a tile must be longer than the longest period")
    rows = df.select(F.col(entity).cast("string").alias("_entity"), F.unix_date(F.col(ts).cast("date")).cast("bigint").alias("_day"), value.cast("bigint").alias("_v"), *[F.col(k).alias(f"_key_{k}") for k in key])
    rows = rows.filter(F.col("_day").isNotNull())
    if key:
        names = ["_entity", *[f"_key_{k}" for k in key]]
        rows = rows.repartition(*names).distinct()
    daily = rows.groupBy("_entity", "_day").agg(F.sum("_v").alias("_v"))
    tile_of = lambda d: F.floor(d / F.lit(tile)).cast("bigint")
    # a day's sum goes to its tile and, near the tile's end, to the next one's halo
    places = F.array(
        F.struct(tile_of(F.col("_day")).alias("tile"), (F.pmod(F.col("_day"), F.lit(tile)) + halo).alias("at")),
        F.struct((tile_of(F.col("_day")) + 1).alias("tile"), (F.pmod(F.col("_day"), F.lit(tile)) + halo - tile).alias("at")),
    )
    sparse = daily.select("_entity", "_day", F.coalesce("_v", F.lit(0)).alias("_v"), F.explode(places).alias("_p")).filter(F.col("_p.at") >= 0)
    sparse = sparse.groupBy("_entity", F.col("_p.tile").alias("_tile")).agg(F.collect_list(F.struct(F.col("_p.at").cast("int").alias("at"), "_v")).alias("_s"))
    span = daily.groupBy("_entity").agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    tiles = span.withColumn("_tile", F.explode(F.sequence(tile_of(F.col("_first")), tile_of(F.col("_last")))))
    same = tiles["_entity"].eqNullSafe(sparse["_entity"]) & (tiles["_tile"] == sparse["_tile"])
    grid = tiles.join(sparse, same, "left").select(
        tiles["_entity"],
        tiles["_tile"],
        F.greatest(F.col("_first") - tiles["_tile"] * tile, F.lit(0)).alias("_lo"),
        F.least(F.col("_last") - tiles["_tile"] * tile, F.lit(tile - 1)).alias("_hi"),
        F.coalesce(F.col("_s.at"), F.array().cast("array<int>")).alias("_at"),
        F.coalesce(F.col("_s._v"), F.array().cast("array<bigint>")).alias("_v"),
    )
    schema = "_entity string, _day bigint, " + ", ".join(f"total{w} bigint" for w in windows)
    out = grid.mapInArrow(lambda b: _blocks(b, tile, windows), schema)
    return out.select(F.col("_entity").alias(entity), F.col("_day").alias("day"), *(f"total{w}" for w in windows))


def cents(x: Column) -> Column:
    """Hundredths of a number with two decimals; null, NaN and infinite become null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < 9e15), F.round(x * 100).cast("bigint"))


def pnl_totals(log: DataFrame, windows: Sequence[int] = (7, 30), pnl: str = "etceth_pnl") -> DataFrame:
    """Totals (hundredths) and averages per day of a portfolio log, for each run and day."""
    x = rolling_totals(log, "run", "date", cents(F.col(pnl)), windows, key=("log_id",))
    return x.select("run", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("day"), *[F.col(f"total{w}").alias(f"total{w}_cents") for w in windows], *[F.round(F.col(f"total{w}") / (100.0 * w), 6).alias(f"avg{w}") for w in windows])
