"""Parameter sweeps: grids, run ids, run tables, selection and blending."""

from __future__ import annotations

import hashlib
import json
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import small


def grid(parameters: dict[str, Any], condition: str | None = None) -> list[dict[str, Any]]:
    """All combinations of the listed values that meet a condition.

    The condition is a comparison of parameters and numbers (joined by ``and``),
    read here and never evaluated as code.
    """
    values = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in parameters.items()}
    out = [dict(zip(values, c, strict=True)) for c in product(*values.values())]
    return [p for p in out if condition is None or all(_holds(part, p) for part in condition.split(" and "))]


_OPS = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


def _holds(text: str, p: dict[str, Any]) -> bool:
    for op, f in _OPS.items():
        if op in text:
            a, b = (s.strip() for s in text.split(op, 1))
            return f(p[a] if a in p else float(a), p[b] if b in p else float(b))
    raise ValueError(f"no comparison in {text!r}")


def run_id(p: dict[str, Any], length: int = 10) -> str:
    """A short name that the parameters determine."""
    return hashlib.sha256(json.dumps(p, sort_keys=True, default=str).encode()).hexdigest()[:length]


def report(runs: DataFrame) -> DataFrame:
    """``run`` with total gain, fees, executions, losing symbols and the gain per execution."""
    g = runs.groupBy("run").agg(F.sum(F.col("gain") - F.col("fees")).alias("gain"), F.sum("fees").alias("fees"), F.sum("executions").alias("executions"), F.count_if(F.col("gain") - F.col("fees") < 0).alias("losing"))
    return g.withColumn("per_execution", F.when(F.col("executions") > 0, F.col("gain") / F.col("executions")))


def best(runs: DataFrame, criterion: str, order: str, n: int = 1, within: str | None = None) -> DataFrame:
    """The n best runs that meet a SQL criterion, of all or of each group."""
    x = runs.filter(F.expr(criterion))
    if within is None:
        return x.orderBy(F.col(order).desc(), "run").limit(n)
    w = Window.partitionBy(within).orderBy(F.col(order).desc(), "run")
    return x.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def varying(parameters: DataFrame) -> DataFrame:
    """Rows (run, name, value) of the parameters that differ between runs."""
    n = parameters.groupBy("name").agg(F.countDistinct("value").alias("_n"))
    return parameters.join(n.filter("_n > 1").select("name"), "name", "left_semi")


def blend(equities: DataFrame, weights: DataFrame) -> DataFrame:
    """The weighted sum of the models' PnL at each time."""
    return equities.join(small(weights), "run").groupBy("ts").agg(F.sum(F.col("pnl") * F.col("weight")).alias("pnl"))


def search(parameters: list[dict[str, Any]], build, score, folds: DataFrame) -> DataFrame:
    """``run``, ``fold``, ``part``, ``score`` of each parameter set on each fold, as one plan.

    ``build(p)`` gives signals, ``folds`` symbol, ts, fold and part; ``score(signals)``
    gives figures grouped by the columns run, fold, part that the signals carry.
    """
    every = None
    for p in parameters:
        s = build(p).withColumn("run", F.lit(run_id(p)))
        every = s if every is None else every.unionByName(s)
    return score(every.join(folds.select("symbol", "ts", "fold", "part"), ["symbol", "ts"]))


def walk_forward_choice(scores: DataFrame) -> DataFrame:
    """For each fold the run that scored best in training, with its score out of sample."""
    w = Window.partitionBy("fold").orderBy(F.col("train").desc_nulls_last(), "run")
    wide = scores.groupBy("run", "fold").agg(F.max(F.when(F.col("part") == "train", F.col("score"))).alias("train"), F.max(F.when(F.col("part") == "test", F.col("score"))).alias("test"))
    return wide.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
