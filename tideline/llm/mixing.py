"""Mixing sources to target weights by Pfair scheduling.

A mix is put out in blocks of ``block`` tokens, one for each time slot. A source
of weight w has its k-th block released at slot floor((k - 1) / w) and due by
slot ceil(k / w); in each slot the released block with the earliest deadline
goes. So at any moment each source's blocks deviate from its target by less than
one.

The slots are scheduled in frames. At a frame's edge each source has had its
share of the slots before, rounded down or up so that they add up; with these
counts fixed, every frame still has a schedule within the windows, and the
frames are independent tasks.

Documents are laid out one after the other in each source by passes and, within
a pass, by a hash of their id. Where a document begins follows from sums over
hash ranges, so no source is ever ordered in one task. A document goes to the
block in which it begins, and the block's slot says when. What a source reaches
is what is put out in that way: a source whose documents, repeated as often as
allowed, run out leaves its later blocks empty and falls short.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import small
from ..session import written
from . import bpe

#: Tokens of a block; a source's share deviates by less than one block.
BLOCK = 32_768
#: Slots of a frame.
FRAME = 1024
#: Hash ranges of each source.
RANGES = 4096


def pfair(weights: dict[str, float], counts: dict[str, tuple[int, int]], first: int, slots: int) -> list[tuple[int, str, int]]:
    """(slot, source, block) of the slots from ``first`` on, by earliest deadline first.

    ``counts``: the blocks that a source has had before and after these slots. A
    slot without a released block stays idle.
    """
    release = lambda k, w: math.floor((k - 1) / w + 1e-9)
    due = lambda k, w: math.ceil(k / w - 1e-9)
    waiting = [(release(a + 1, weights[s]), s, a + 1) for s, (a, b) in counts.items() if b > a]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(first, first + slots):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(k, weights[s]), s, k))
        if ready:
            _, s, k = heapq.heappop(ready)
            out.append((slot, s, k))
            if k < counts[s][1]:
                heapq.heappush(waiting, (release(k + 1, weights[s]), s, k + 1))
    return out


def counts_at(weights: dict[str, float], slot: int) -> dict[str, int]:
    """Blocks of each source before a slot: its share of the slots, the largest remainders rounded up so
    that all slots are taken but for the weight that is missing to one."""
    exact = {s: w * slot for s, w in weights.items()}
    out = {s: math.floor(x + 1e-9) for s, x in exact.items()}
    spare = math.floor(sum(exact.values()) + 1e-6) - sum(out.values())
    for s in sorted(weights, key=lambda s: (out[s] - exact[s], s))[: max(0, spare)]:
        out[s] += 1 if exact[s] > out[s] + 1e-9 else 0
    return out


def _frames(batches: Iterator[pa.RecordBatch], frame: int) -> Iterator[pa.RecordBatch]:
    """Rows (mix, names, weights, wanted, slots, number) as one row per scheduled block."""
    for batch in batches:
        for r in batch.to_pylist():
            weights = dict(zip(r["names"], r["weights"], strict=True))
            wanted = dict(zip(r["names"], r["wanted"], strict=True))
            first = r["number"] * frame
            size = min(frame, r["slots"] - first)
            rows: list[tuple[int, str, int]] = []
            if size > 0:
                a, b = counts_at(weights, first), counts_at(weights, first + size)
                rows = pfair(weights, {s: (min(a[s], wanted[s]), min(b[s], wanted[s])) for s in weights}, first, size)
            else:  # behind the last slot: blocks that rounding left over, at most one or so of a source
                done = counts_at(weights, r["slots"])
                rest = sorted((k / weights[s], s, k) for s in weights for k in range(min(done[s], wanted[s]) + 1, wanted[s] + 1))
                rows = [(r["slots"] + i, s, k) for i, (_, s, k) in enumerate(rest)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["mix"]] * len(rows), pa.string()), pa.array([s for _, s, _ in rows], pa.string()), pa.array([k for *_, k in rows], pa.int64()), pa.array([x for x, *_ in rows], pa.int64())],
                names=["mix", "source", "block", "slot"],
            )


def sizes(docs: DataFrame, targets: DataFrame, folder: str = bpe.FOLDER) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` of the documents whose source some mix lists."""
    listed = small(targets.select(F.col("source").alias("_s")).dropna().distinct(), targets)
    return bpe.count_tokens(docs.join(listed, F.col("source") == F.col("_s"), "left_semi"), "doc_id", "source", folder=folder)


def demands(n: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix``, ``source``, ``target_share``, ``max_repeat``, ``source_tokens``, ``mix_tokens``, ``demand``.

    ``n``: source, n_tokens. A mix's size is the tokens of all documents of its
    listed sources, each once. Listed twice, a source counts once, with the
    largest share and repeat. A null or negative share counts as 0, a null
    repeat as 1. At most one row per row of ``targets``.
    """
    total = n.groupBy(F.col("source").alias("_s")).agg(F.sum("n_tokens").alias("tokens"))
    own = targets.filter(F.col("mix").isNotNull() & F.col("source").isNotNull()).groupBy("mix", "source").agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeat"), F.lit(1)).cast("bigint").alias("max_repeat"))
    x = own.join(total, F.col("source") == F.col("_s"), "left").withColumn("source_tokens", F.coalesce("tokens", F.lit(0))).drop("_s", "tokens")
    x = x.withColumn("mix_tokens", F.sum("source_tokens").over(Window.partitionBy("mix")))
    return x.withColumn("demand", F.col("target_share") * F.col("mix_tokens"))


def _wanted(block: int) -> Column:
    return F.ceil(F.col("demand") / block).cast("bigint")


def schedule(d: DataFrame, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """``mix``, ``source``, ``block`` (from 1 on), ``slot``: when each block that a source is due goes.

    ``d``: rows of ``demands``. Weights that add up to more than one can't be met
    within the mix's size: there are more slots then, shared in proportion. A
    source of weight 0 has no blocks. One task per so many frames.
    """
    x = d.filter((F.col("target_share") > 0) & (F.col("mix_tokens") > 0)).withColumn("_k", _wanted(block))
    x = x.groupBy("mix").agg(F.sort_array(F.collect_list(F.struct("source", "target_share", "_k"))).alias("_s"), F.max("mix_tokens").alias("_n"), F.sum("target_share").alias("_w"))
    over = F.greatest(F.col("_w"), F.lit(1.0))
    x = x.select("mix", F.col("_s.source").alias("names"), F.transform("_s.target_share", lambda w: w / over).alias("weights"), F.col("_s._k").alias("wanted"), F.ceil(F.col("_n") * over / block).cast("bigint").alias("slots"))
    # the last frame holds what rounding leaves over
    x = x.withColumn("number", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("slots") / frame).cast("bigint"))))
    return x.repartition("mix", "number").mapInArrow(lambda b: _frames(b, frame), "mix string, source string, block bigint, slot bigint")


def place(n: DataFrame, targets: DataFrame, d: DataFrame | None = None, block: int = BLOCK, frame: int = FRAME, ranges: int = RANGES) -> DataFrame:
    """``mix``, ``slot``, ``at``, ``source``, ``doc_id``, ``pass``, ``n_tokens``: where each use of a document goes.

    ``n``: doc_id (a whole number), source, n_tokens; used several times, so
    give a table, not a plan that counts tokens. Uses are in order of ``slot``
    and ``at`` (tokens between the block's and the document's beginning). A use
    belongs to the block in which it begins; uses that begin beyond the source's
    demand are not made, those of documents without tokens or without id
    neither. ``d``: the demands, if they are at hand.
    """
    d = demands(n, targets) if d is None else d
    bits = 32
    h = F.pmod(F.pmod(F.col("doc_id"), F.lit(1 << 31)) * F.lit(2_654_435_761), F.lit(1 << bits))
    x = n.filter((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "source", "n_tokens", h.alias("_h"))
    x = x.withColumn("_r", F.floor(F.col("_h") * ranges / (1 << bits)))
    sums = x.groupBy("source", "_r").agg(F.sum("n_tokens").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("source").orderBy("_r")) - F.col("_sum")).drop("_sum")
    w = Window.partitionBy("source", "_r").orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_in", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(sums, ["source", "_r"])
    x = x.select("doc_id", "source", "n_tokens", (F.col("_before") + F.col("_in")).alias("_at"))
    p = d.filter((F.col("demand") > 0) & (F.col("source_tokens") > 0)).select("mix", "source", "max_repeat", "source_tokens", "demand", _wanted(block).alias("_k"))
    x = x.join(small(p, targets), "source").filter(F.col("_at") < F.col("demand"))
    uses = F.least(F.col("max_repeat"), F.ceil((F.col("demand") - F.col("_at")) / F.col("source_tokens")).cast("bigint"))
    x = x.filter(uses > 0).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("bigint"), uses)))
    begin = F.col("_at") + (F.col("pass") - 1) * F.col("source_tokens")
    x = x.withColumn("_begin", begin).filter(F.col("_begin") < F.col("demand"))
    x = x.withColumn("block", F.least(F.floor(F.col("_begin") / block) + 1, F.col("_k")))
    x = x.withColumn("at", F.col("_begin") - (F.col("block") - 1) * block)
    return x.join(schedule(d, block, frame), ["mix", "source", "block"]).select("mix", "slot", "at", "source", "doc_id", "pass", "n_tokens")


def report(n: DataFrame, targets: DataFrame, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """What each source of each mix reaches, from what ``place`` puts out.

    ``mix``, ``source``, ``target_share``; ``actual_share`` (of the mix's size)
    and ``output_share`` (of what is put out); ``tokens`` and ``uses`` put out;
    ``missed_blocks``: blocks due that have nothing to hold; ``short``: the share
    stays below the target. A source without documents is short if it has a
    target.
    """
    d = demands(n, targets)
    out = place(n, targets, d, block, frame).groupBy(F.col("mix").alias("_m"), F.col("source").alias("_s")).agg(F.sum("n_tokens").alias("_t"), F.count(F.lit(1)).alias("_u"))
    x = d.join(out, (F.col("mix") == F.col("_m")) & (F.col("source") == F.col("_s")), "left").withColumns({"tokens": F.coalesce("_t", F.lit(0)), "uses": F.coalesce("_u", F.lit(0))})
    short = (F.col("target_share") > 0) & ((F.col("source_tokens") == 0) | (F.col("tokens") < F.col("demand")))
    missed = F.greatest(_wanted(block) - F.ceil(F.col("tokens") / block), F.lit(0)).cast("bigint")
    return x.select(
        "mix", "source", "target_share",
        F.when(F.col("mix_tokens") > 0, F.col("tokens") / F.col("mix_tokens")).otherwise(0.0).alias("actual_share"),
        (F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("mix")), F.lit(0))).alias("output_share"),
        "tokens", "uses", missed.alias("missed_blocks"), short.alias("short"),
    )


def found(docs: DataFrame, targets: DataFrame, folder: str = bpe.FOLDER) -> DataFrame:
    """``mix``, ``source`` of the sources that stay below their target in what is put out."""
    return report(written(sizes(docs, targets, folder)), targets).filter("short").select("mix", "source")
