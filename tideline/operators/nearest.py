"""Matching records by nearest time, with a learned index.

Both tables are cut into shards of one entity and one stretch of time, the
shorter, the denser the entity's rows lie. Shard edges overlap: a candidate
within the entity's tolerance of an edge also goes to the neighbouring shard, so
every shard has all that its probes can need. In a partition the shards lie one
after the other, sorted; a bounded number of rows at a time becomes one sorted
array of keys, over which a piecewise-linear index is fitted: each piece
predicts the position of a key with an error of at most ``ERROR``. A probe's
neighbours are then exact after a search within that error. Of a shard that is
longer than this number of rows, only the last candidate and the probes after
it that a later one may still be nearest to are kept for the next rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import small, us

#: The error in positions that a piece of the index may have.
ERROR = 8
#: Keys of a piece before it is split.
PIECE = 256
#: Rows gathered before they are matched, and aimed at in a shard.
ROWS = 200_000
#: The longest stretch of time of a shard, unless the tolerance asks for a longer one.
SHARD_US = 6 * 3_600_000_000


class LearnedIndex:
    """Piecewise-linear map from sorted, distinct whole keys to their positions."""

    def __init__(self, keys: np.ndarray, error: int = ERROR, piece: int = PIECE):
        self.keys, self.error = keys, error
        if not len(keys):
            return
        starts = np.arange(0, len(keys), piece)
        while True:  # halve the pieces whose line misses a position by more than the error
            ends = np.append(starts[1:], len(keys))
            x0, n = keys[starts], ends - starts
            reach = np.maximum(keys[ends - 1] - x0, 1)
            slope = (n - 1) / reach
            own = np.repeat(np.arange(len(starts)), n)
            miss = np.abs(starts[own] + slope[own] * (keys - x0[own]) - np.arange(len(keys)))
            bad = np.maximum.reduceat(miss, starts) > error
            if not bad.any():
                break
            starts = np.union1d(starts, starts[bad] + n[bad] // 2)
        self.starts, self.ends, self.slope, self.first = starts, ends, slope, x0

    def left(self, probes: np.ndarray) -> np.ndarray:
        """Position of the last key that is at most the probe; -1 if there is none."""
        if not len(self.keys):
            return np.full(len(probes), -1)
        own = np.searchsorted(self.first, probes, side="right") - 1
        below, own = own < 0, np.maximum(own, 0)
        guess = self.starts[own] + np.rint(self.slope[own] * (probes - self.first[own])).astype(np.int64)
        lo = np.clip(guess - self.error - 1, self.starts[own], self.ends[own] - 1)
        hi = np.clip(guess + self.error + 2, lo + 1, self.ends[own])
        # a probe past its piece's last key; the line says nothing there
        lo = np.where(probes >= self.keys[self.ends[own] - 1], self.ends[own] - 1, lo)
        hi = np.where(probes >= self.keys[self.ends[own] - 1], self.ends[own], hi)
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            right = self.keys[np.minimum(mid, len(self.keys) - 1)] <= probes
            lo, hi = np.where(right & (hi - lo > 1), mid, lo), np.where(right | (hi - lo <= 1), hi, mid)
        return np.where(below, -1, lo)


def _match(shard: np.ndarray, side: np.ndarray, t: np.ndarray, ident: np.ndarray, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of probes and of their nearest candidates, of rows sorted by shard, time, side and id."""
    which = np.cumsum(np.r_[True, shard[1:] != shard[:-1]]) - 1
    t0 = t - t.min()
    span = int(t0.max()) + 1 + 2 * (int(tol.max()) + 1)
    if span * (int(which[-1]) + 1) >= 2**62:  # keys of distant times would not fit: shard by shard
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        if len(edges) > 2:
            parts = [_match(*(v[x:y] for v in (shard, side, t, ident, tol))) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    key = which * span + t0
    candidate = side == 0
    ck, ci = key[candidate], ident[candidate]
    fresh = np.r_[True, ck[1:] != ck[:-1]] if len(ck) else np.zeros(0, bool)  # of equal times the smallest id
    ck, ci = ck[fresh], ci[fresh]
    probe = ~candidate
    pk, pi, pt = key[probe], ident[probe], tol[probe]
    once = np.r_[True, (pk[1:] != pk[:-1]) | (pi[1:] != pi[:-1])] if len(pk) else np.zeros(0, bool)
    pk, pi, pt = pk[once], pi[once], pt[once]
    if not len(ck) or not len(pk):
        return pi[:0], ci[:0]
    at = LearnedIndex(ck).left(pk)
    far = np.int64(2**62)
    before = np.where(at >= 0, pk - ck[np.maximum(at, 0)], far)
    after = np.where(at + 1 < len(ck), ck[np.minimum(at + 1, len(ck) - 1)] - pk, far)
    use_before = before <= after
    gap = np.where(use_before, before, after)
    ok = gap <= pt
    return pi[ok], ci[np.where(use_before, at, at + 1)[ok]]


def _undecided(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows whose last shard may go on: which are kept for later, and which are decided now.

    Kept are the last shard's last candidate and the probes behind it that lie
    within their tolerance of the newest time; the candidate serves both.
    """
    shard, side, t, _, tol = rows
    own = shard == shard[-1]
    candidates = np.flatnonzero(own & (side == 0))
    last = candidates[-1] if len(candidates) else int(np.argmax(own)) - 1
    open_ = own & (side == 1) & (np.arange(len(t)) > last) & (t + tol >= t[-1])
    keep = open_.copy()
    if len(candidates):  # with it the ones of its time before it: the smallest id counts
        keep |= own & (side == 0) & (t == t[last])
        same = np.flatnonzero(keep & (side == 0))
        keep[same[1:]] = False
    return keep, ~open_


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gathers sorted rows and matches them, each row being numbered and copied a bounded number of times."""
    kept: tuple[np.ndarray, ...] | None = None
    gathered: list[tuple[np.ndarray, ...]] = []
    size, number, end = 0, 0, None

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal kept, gathered, size
        rows = tuple(np.concatenate(x) for x in zip(*([kept] if kept is not None else []), *gathered, strict=True))
        gathered, size = [], 0
        if not final:
            keep, now = _undecided(rows)
            kept, rows = tuple(v[keep] for v in rows), tuple(v[now] for v in rows)
        if len(rows[0]):
            a, b = _match(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["probe_id", "candidate_id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        entity, shard = batch.column("_entity"), batch.column("_shard").to_numpy()
        code = entity.dictionary_encode().indices.to_numpy()
        new = np.r_[end != (entity[0].as_py(), shard[0]), (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])]
        own = number + np.cumsum(new)
        number, end = int(own[-1]), (entity[-1].as_py(), shard[-1])
        gathered.append((own, *(batch.column(n).to_numpy() for n in ("_side", "_t", "_id", "_tol"))))
        size += batch.num_rows
        if size >= ROWS:
            yield from flush(False)
    if gathered or kept is not None:
        yield from flush(True)


def nearest_in_time(probes: DataFrame, candidates: DataFrame, tolerance: DataFrame, shard_us: int = SHARD_US) -> DataFrame:
    """``probe_id``, ``candidate_id``: for each probe the nearest candidate of its entity.

    ``probes`` and ``candidates``: entity, t (microseconds), id. ``tolerance``:
    entity, tol_us; an entity that it lacks has no matches. Of two equally near
    candidates the earlier is taken, of candidates with one time the smallest
    id. A probe without candidate within the tolerance has no row; rows with a
    null are left out; repeated rows count once; empty tables give no rows.
    """
    own = tolerance.filter(F.col("tol_us") >= 0).groupBy(F.col("entity").cast("string").alias("_e")).agg(F.max("tol_us").cast("bigint").alias("_tol"))
    sides = [df.select(F.col("entity").cast("string").alias("_entity"), F.col("t").cast("bigint").alias("_t"), F.col("id").cast("bigint").alias("_id")).dropna() for df in (candidates, probes)]
    # an entity's shards are as long as some ROWS rows last, and at least twice its tolerance: a candidate then goes to two shards at most
    n = sides[0].select("_entity", "_t").unionByName(sides[1].select("_entity", "_t")).groupBy("_entity").agg(F.count(F.lit(1)).alias("_n"), (F.max("_t") - F.min("_t") + 1).alias("_span"))
    pace = F.least(F.lit(float(shard_us)), F.col("_span") * (float(ROWS) / F.col("_n")))
    own = own.join(n, F.col("_e") == F.col("_entity"), "left").select("_e", "_tol", F.greatest(F.coalesce(pace, F.lit(1.0)).cast("bigint"), 2 * F.col("_tol") + 1).alias("_width"))
    own = small(own, tolerance)

    def side(x: DataFrame, k: int) -> DataFrame:
        x = x.join(own, F.col("_entity") == F.col("_e")).drop("_e")
        at = lambda t: F.floor(t / F.col("_width")).cast("bigint")
        t, tol = F.col("_t"), F.col("_tol")
        shards = F.array(at(t)) if k else F.sequence(at(t - tol), at(t + tol))
        return x.select("_entity", F.explode(shards).alias("_shard"), F.lit(k).cast("int").alias("_side"), "_t", "_id", "_tol")

    both = side(sides[0], 0).unionByName(side(sides[1], 1))
    both = both.repartition("_entity", "_shard").sortWithinPartitions("_entity", "_shard", "_t", "_side", "_id")
    return both.mapInArrow(_matched, "probe_id bigint, candidate_id bigint")


def plain(name: Column) -> Column:
    """A name in upper case without the white space around it."""
    return F.upper(F.regexp_replace(name, r"^[\s ​﻿]+|[\s ​﻿]+$", ""))


def symbol_names(instruments: DataFrame) -> DataFrame:
    """``_name``, ``_symbol``: both spellings of each instrument, in plain form."""
    both = instruments.select("symbol", F.explode(F.array("symbol", "instrument")).alias("n")).dropna()
    return both.groupBy(plain(F.col("n")).alias("_name")).agg(F.min("symbol").alias("_symbol"))


def found(fills: DataFrame, quotes: DataFrame, instruments: DataFrame) -> DataFrame:
    """``fill_id``, ``quote_id`` of the quote nearest in time to each fill."""
    f = fills.select("fill_id", "instrument", "time").withColumn("_n", plain(F.col("instrument"))).join(small(symbol_names(instruments)), F.col("_n") == F.col("_name"))
    probes = f.select(F.col("_symbol").alias("entity"), us(F.col("time")).alias("t"), F.col("fill_id").alias("id"))
    candidates = quotes.select(F.col("symbol").alias("entity"), us(F.col("time")).alias("t"), F.col("quote_id").alias("id"))
    tolerance = instruments.select(F.col("symbol").alias("entity"), (F.col("tol_ms").cast("bigint") * 1000).alias("tol_us"))
    return nearest_in_time(probes, candidates, tolerance).select(F.col("probe_id").alias("fill_id"), F.col("candidate_id").alias("quote_id"))
