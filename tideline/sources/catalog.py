"""Sources and sinks: a catalog of named readers, CSV and Parquet stores, exports.

A source gives rows in long format with ``symbol`` and ``ts``. Ranges include
both ends and are filters on the raw columns, so they reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..frames import require_columns
from ..operators.rolling import changes_only, last_rows, one_per_time

Reader = Callable[..., DataFrame]


class Catalog:
    """Names of sources, each with a reader and its options.

    ``kinds`` are readers by type: ``csv``, ``parquet``, ``jdbc``, ``memory`` and
    whatever ``register`` adds.
    """

    def __init__(self, spark: SparkSession, config: dict[str, dict[str, Any]] | None = None):
        self.spark, self.config, self.kinds = spark, dict(config or {}), {"csv": self._csv, "parquet": self._parquet, "jdbc": self._jdbc, "memory": self._memory}

    def register(self, kind: str, reader: Reader) -> None:
        self.kinds[kind] = reader

    def add(self, name: str, kind: str, **options: Any) -> None:
        self.config[name] = {"type": kind, **options}

    def names(self, pattern: str = ".*") -> list[str]:
        return sorted(n for n in self.config if re.search(pattern, n, re.I))

    def open(self, name: str) -> DataFrame:
        if name not in self.config:
            raise KeyError(f"no source {name}; there are {self.names()}")
        options = dict(self.config[name])
        kind = options.pop("type")
        if kind not in self.kinds:
            raise KeyError(f"no reader for {kind}; there are {sorted(self.kinds)}")
        x = self.kinds[kind](**options)
        return x.toDF(*[c.lower() for c in x.columns])

    def load(self, name: str, symbols: Sequence[str] = (), start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows of the symbols (in any letter case; none: all) between start and end."""
        x = self.open(name)
        require_columns(x, "symbol", "ts")
        if symbols:
            x = x.filter(F.upper("symbol").isin([s.upper() for s in symbols]))
        return between(x, start, end)

    def symbols(self, name: str, pattern: str = ".*") -> DataFrame:
        return self.open(name).select("symbol").distinct().filter(F.col("symbol").rlike(f"(?i){pattern}"))

    def last(self, name: str, symbols: Sequence[str], n: int) -> DataFrame:
        """The n last rows of each symbol."""
        return last_rows(self.load(name, symbols), "symbol", ["ts"], n)

    def ranges(self, name: str) -> DataFrame:
        return ranges(self.open(name))

    # readers

    def _csv(self, path: str, schema: str | StructType, header: bool = True, delimiter: str = ",", time: str = "time", time_format: str | None = None, symbol: str | None = None, **options: Any) -> DataFrame:
        """One file or a folder of files; without a column ``symbol`` a file's name is its rows' symbol."""
        x = self.spark.read.schema(schema).options(header=header, delimiter=delimiter, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options).csv(path)
        x = x.toDF(*[c.lower() for c in x.columns])
        at = F.col(time.lower())
        if x.schema[time.lower()].dataType.typeName() == "string":
            at = F.try_to_timestamp(at, F.lit(time_format)) if time_format else F.try_to_timestamp(at)
        name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)?(?:\.gz)?$", 1) if symbol is None else F.col(symbol)
        return x.withColumns({"ts": at.cast("timestamp_ntz"), "symbol": F.upper(name)})

    def _parquet(self, path: str, symbol: str = "symbol", time: str = "ts") -> DataFrame:
        x = self.spark.read.parquet(path)
        return x.withColumnsRenamed({symbol: "symbol", time: "ts"})

    def _jdbc(self, url: str, table: str, time: str = "ts", start: str | None = None, end: str | None = None, days: int = 1, symbol: str = "symbol", **properties: str) -> DataFrame:
        """A database table, one partition for each stretch of days."""
        if start is None or end is None:
            x = self.spark.read.jdbc(url, table, properties=properties)
        else:
            x = self.spark.read.jdbc(url, table, predicates=stretches(time, start, end, days), properties=properties)
        return x.withColumnsRenamed({symbol: "symbol", time: "ts"})

    def _memory(self, frame: Any, symbol: str = "symbol", time: str = "ts") -> DataFrame:
        x = frame if isinstance(frame, DataFrame) else self.spark.createDataFrame(frame)
        return x.withColumnsRenamed({symbol: "symbol", time: "ts"})


def stretches(time: str, start: str, end: str, days: int) -> list[str]:
    """SQL conditions that cut a range of days into parts."""
    a, z = datetime.fromisoformat(start), datetime.fromisoformat(end)
    out = []
    while a <= z:
        b = min(a + timedelta(days=days), z + timedelta(days=1))
        out.append(f"{time} >= '{a:%Y-%m-%d}' and {time} < '{b:%Y-%m-%d}'")
        a = b
    return out


def between(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows between two times, both included; ``now`` as the end sets no bound."""
    for bound, op in ((start, ">="), (end, "<=")):
        if bound and bound != "now":
            lit = F.lit(bound).cast(df.schema[ts].dataType)
            df = df.filter(F.col(ts) >= lit if op == ">=" else F.col(ts) <= lit)
    return df


def ranges(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("rows"))


def adjusted(bars: DataFrame, close: str = "adj_close") -> DataFrame:
    """Open, high and low moved in proportion to an adjusted close, which becomes the close."""
    k = F.col(close) / F.nullif("close", F.lit(0.0))
    return bars.withColumns({"open": F.col("open") * k, "high": F.col("high") * k, "low": F.col("low") * k, "close": F.col(close)}).drop(close)


def append_new(df: DataFrame, path: str, spark: SparkSession) -> None:
    """Append the rows after each symbol's last stored time, partitioned by day.

    Of what is stored only the columns symbol and ts are read. A day's rows are
    written by several tasks, by the symbols' hash.
    """
    try:
        held = ranges(spark.read.parquet(path).select("symbol", "ts")).select("symbol", F.col("end").alias("_end"))
        df = df.join(held, "symbol", "left").filter(F.col("_end").isNull() | (F.col("ts") > F.col("_end"))).drop("_end")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.withColumn("day", F.to_date("ts")).repartition("day", F.pmod(F.xxhash64("symbol"), F.lit(16))).sortWithinPartitions("day", "symbol", "ts").write.mode("append").partitionBy("day").parquet(path)


class Store:
    """Named tables under a folder: save, append, load, list, delete, with a filter, order, offset and limit."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[\w\-]+(?:/[\w\-]+)*", name):
            raise ValueError(f"not a table's name: {name!r}")
        return f"{self.folder}/{name}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(self._path(name))

    def append(self, name: str, df: DataFrame) -> None:
        self.save(name, df, "append")

    def load(self, name: str, where: str | None = None, order: Sequence[Any] = (), offset: int = 0, limit: int | None = None) -> DataFrame:
        x = self.spark.read.parquet(self._path(name))
        x = x.filter(where) if where else x
        x = x.orderBy(*order) if order else x
        x = x.offset(offset) if offset else x
        return x if limit is None else x.limit(limit)

    def count(self, name: str, where: str | None = None) -> int:
        return self.load(name, where).count()

    def list(self, pattern: str = ".*") -> list[str]:
        fs, p = self._fs(self.folder)
        return sorted(s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else []) if re.search(pattern, s.getPath().getName()))

    def delete(self, name: str, where: str | None = None) -> None:
        """The table, or the rows that meet a condition."""
        fs, p = self._fs(self._path(name))
        if where is None:
            fs.delete(p, True)
            return
        new, old = (self._fs(f"{self._path(name)}-{part}")[1] for part in ("new", "old"))
        self.load(name).filter(f"not coalesce({where}, false)").write.mode("overwrite").parquet(f"{self._path(name)}-new")
        fs.delete(old, True)  # the table is there whole under one of its names at any time
        fs.rename(p, old)
        fs.rename(new, p)
        fs.delete(old, True)


def quote_changes(quotes: DataFrame) -> DataFrame:
    """Quotes for a simulator: one per time (the first), and only where bid or ask changed."""
    q = one_per_time(quotes.filter("time is not null"), ["symbol"], "time", "quote_id")
    return changes_only(q, "symbol", ["time"], ["bid", "ask"]).select("symbol", "time", "quote_id", "bid", "ask", "bidvol", "askvol")


def export_csv(df: DataFrame, path: str, by: Sequence[str] = ("symbol",), compress: bool = True) -> None:
    """CSV files in a folder per symbol, sorted by time."""
    x = df.repartition(*by).sortWithinPartitions(*by, "ts" if "ts" in df.columns else df.columns[0])
    x.write.mode("overwrite").partitionBy(*by).options(header=True, compression="gzip" if compress else "none").csv(path)


def wide_to_long(df: DataFrame, symbols: Sequence[str], fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``<symbol>_<field>`` as rows with a symbol; a missing column gives nulls."""
    rows = [F.struct(F.lit(s).alias("symbol"), *[(F.col(f"{s}_{f}") if f"{s}_{f}" in df.columns else F.lit(None).cast("double")).alias(f) for f in fields]) for s in symbols]
    return df.select(*keep, F.inline(F.array(*rows)))


def long_to_wide(df: DataFrame, symbols: Sequence[str], fields: Sequence[str], on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(*[F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{s}_{f}") for s in symbols for f in fields])


def latest(df: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(seq).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
