"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import pin_utc, ship

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The Parquet tables of a folder, read by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = ship(pin_utc(spark)), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register a function of ``Tables``; ``sql`` runs on the same tables in DuckDB."""

        def keep(f: Callable[[Tables], DataFrame]):
            if name in self.queries:
                raise ValueError(f"{name} is there already")
            self.queries[name] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.sql[name] = sql
            return f

        return keep
