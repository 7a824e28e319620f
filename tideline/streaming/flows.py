"""Incremental operators: bars, smoothers and expirations over a stream.

Event time must be a timestamp with zone here, so times without zone are cast in
UTC. Late rows beyond the watermark are dropped. State is typed columns of numbers,
never pickled objects: partial bars, steps as their numbers, last times.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.incremental import Bar, BarStep, LiveBars, freeze, thaw
from ..session import checkpoint_dir


def events(spark: SparkSession, folder: str, table: str = "events", files: int | None = None) -> DataFrame:
    """A Parquet table of a folder as a stream; ``files``: files of a micro-batch."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet")
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(folder)


def bars(stream: DataFrame, symbol: str, ts: str, value: str, freq: str, late: str, seq: str) -> DataFrame:
    """Tumbling bars; in append mode a bar comes out once the watermark has passed its end."""
    at = F.struct("_t", seq)
    x = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    g = x.groupBy(F.col(symbol).alias("symbol"), F.window("_t", freq).alias("w"))
    return g.agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")).select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    x = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return x.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("rows")).select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "rows")


def stepped(stream: DataFrame, key: str, ts: str, value: str, step: Callable[[], Callable[[float], float]]) -> DataFrame:
    """``key``, ``ts``, ``value``: a step run over each key's values, its state kept between micro-batches as numbers.

    Values are taken in order of time within a micro-batch, and as the
    micro-batches come. For rows that come late, see ``live``.
    """
    kind = stream.schema[key].dataType.simpleString()

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = thaw(step(), list(state.get[0])) if state.exists else step()
        rows = pd.concat(list(frames)).sort_values("_t", kind="stable")
        out = [held(v) for v in rows["_v"]]
        state.update((freeze(held),))
        yield pd.DataFrame({key: keys[0], "ts": rows["_t"].to_numpy(), "value": out})

    x = stream.select(key, F.col(ts).cast("timestamp").alias("_t"), F.col(value).cast("double").alias("_v"))
    return x.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, value double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def live(stream: DataFrame, key: str, ts: str, value: str, seq: str, length_us: int, step: Callable[[], BarStep], late: str, idle_us: int | None = None) -> DataFrame:
    """``key``, ``ts`` (start) and a step's figures of each bar, once the watermark has passed its end.

    Ticks wait in the state until the watermark has passed them, so they are
    taken in order of time and ``seq`` however they arrive; later ones are dropped.
    The state is the waiting ticks, the open bar and the step's numbers. With
    ``idle_us`` a key's state ends when no tick came for so long after its last.
    """
    kind, names = stream.schema[key].dataType.simpleString(), step().names

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, bar, numbers, last = ([], [], [], -(1 << 62)) if not state.exists else ([list(w) for w in zip(*state.get[:3], strict=True)], list(state.get[3]), list(state.get[4]), state.get[5])
        for f in frames:
            if f.empty:  # a time-out comes with no rows
                continue
            us = f["_t"].astype("datetime64[us, UTC]" if f["_t"].dt.tz is not None else "datetime64[us]").astype("int64")
            waiting += [list(w) for w in zip(us.tolist(), f["_s"].tolist(), f["_v"].tolist(), strict=True) if w[2] == w[2]]
        mark = state.getCurrentWatermarkMs() * 1000
        bars = LiveBars(length_us, thaw(step(), numbers) if numbers else step(), Bar(int(bar[0]), *bar[1:]) if bar else None)
        waiting.sort()
        ready = [w for w in waiting if w[0] <= mark]
        waiting, done = waiting[len(ready) :], []
        for us, _, v in ready:
            done += bars.tick(us, v)
            last = us
        done += bars.closed(mark)
        b = bars.bar
        if not waiting and b is None and idle_us is not None and mark - last > idle_us:
            state.remove()
        else:
            state.update(([w[0] for w in waiting], [int(w[1]) for w in waiting], [float(w[2]) for w in waiting], [float(v) for v in b] if b else [], freeze(bars.step), int(last)))
            due = min([w[0] for w in waiting[:1]] + ([b.us + length_us] if b else []), default=last + idle_us if idle_us is not None else None)
            if due is not None:
                state.setTimeoutTimestamp(max(due // 1000, mark // 1000 + 1))
        if done:
            figures = list(zip(*(v for _, v in done), strict=True))
            yield pd.DataFrame({key: keys[0], "ts": pd.to_datetime([d.us for d, _ in done], unit="us"), **{n: pd.Series(v, dtype=float) for n, v in zip(names, figures, strict=True)}})

    x = stream.select(key, F.col(ts).cast("timestamp").alias("_t"), F.col(seq).cast("bigint").alias("_s"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull()).withWatermark("_t", late)
    out = f"{key} {kind}, ts timestamp, " + ", ".join(f"`{n}` double" for n in names)
    return x.groupBy(key).applyInPandasWithState(run, out, "t array<bigint>, s array<bigint>, v array<double>, bar array<double>, step array<double>, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def expirations(stream: DataFrame, key: str, ts: str, after_ms: int, late: str) -> DataFrame:
    """``key``, ``ts``: the last time of each key once nothing came for ``after_ms`` of event time."""
    kind = stream.schema[key].dataType.simpleString()

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "ts": pd.to_datetime([last], unit="ms")})
            return
        newest = max(int(f["_t"].max().timestamp() * 1000) for f in frames)
        newest = max(newest, state.get[0]) if state.exists else newest
        state.update((newest,))
        state.setTimeoutTimestamp(newest + after_ms)

    x = stream.select(key, F.col(ts).cast("timestamp").alias("_t")).withWatermark("_t", late)
    return x.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def drained(out: DataFrame) -> DataFrame:
    """Run a stream over all that is there, into a Parquet table of the shared folder, and read it."""
    spark = out.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/tideline-stream-{uuid.uuid4().hex}"
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(out.schema).parquet(f"{base}/out")
