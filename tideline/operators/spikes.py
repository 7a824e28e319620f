"""Implausible readings relative to what is normal for their source.

A source is a table and a symbol; its readings are cut into stretches of time,
the shorter, the denser they lie, so that no task holds a whole source. Two
passes over the readings, each sorted by stretch and time and taken a bounded
number of rows at a time; a stretch with more rows is taken in pieces.

1. The survey puts the moves from one reading to the next into quantile
   sketches (counts of logarithmic bins with a fixed relative error, merged by
   adding) by source and hour of the day, the moves by the time they took into
   sketches by source, the lengths of runs of equal readings into a histogram,
   and notes the readings and runs at the edges of each stretch. The result is a
   small table; from it come each source's fences, its longest usual run and the
   runs that go on over an edge. An hour's fence is the source's, drawn towards
   that of the hour's own moves by their number.
2. The flagging gives each stretch the few readings beside it and its source's
   limits, and looks at every reading once.

Flags: ``value`` (zero, negative, infinite), ``jump`` (beyond twice the expanded
interquartile fence of the source's moves from the readings on both sides, back
after at most ``LONGEST`` readings), ``stuck`` (no change over a run that is
several times as long as the source's runs otherwise get) and ``rate`` (a single
reading beyond the fence itself, there and back faster than the source's fence
of moves by time).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import small, us
from ..session import written
from .nearest import plain, symbol_names
from .timestamps import normalise_bars

#: How many readings an excursion may last.
LONGEST = 4
#: How many readings on one side are looked at: beside an end of the source as many more as the other side lacks.
ASIDE = 2 * LONGEST - 1
#: How many readings beside a stretch its flags depend on: the rate also looks at the jumps next to a reading.
NEAR = ASIDE + 1
#: Interquartile ranges above the upper quartile up to which moves are regular.
FENCE = 3.0
#: How many times as far as regular moves go a reading must stand off.
FACTOR = 2.0
#: The series has come back if the readings on both sides differ by less than this part of the excursion.
BACK = 0.5
#: A run is stuck from so many times the 90th percentile of the source's runs on, and from so many readings.
RUN_FACTOR, RUN_LEAST = 3.0, 8
#: Relative error of the sketches.
ERROR = 0.01
#: Moves of an hour with which its fence lies half-way between the source's and that of its own moves.
HOUR_WEIGHT = 500.0
_BIN = float(np.log((1 + ERROR) / (1 - ERROR)))
#: Rows gathered before they are worked on, and aimed at in a stretch.
ROWS = 200_000

_KEY = ("tab", "symbol")
_DAY, _HOUR = 86_400_000_000, 3_600_000_000


def _paced(x: DataFrame, longest: int, instruments: DataFrame) -> DataFrame:
    """``x`` with the width ``w`` of its symbol's stretches: as long as some ROWS rows last, ``longest`` at most.

    The paces are one row per instrument; other symbols have the longest stretches.
    """
    n = x.groupBy(F.col("symbol").alias("_sym")).agg(F.count(F.lit(1)).alias("_n"), (F.max("t") - F.min("t") + 1).alias("_span"))
    pace = F.greatest(F.least(F.lit(float(longest)), F.col("_span") * (float(ROWS) / F.col("_n"))), F.lit(1.0)).cast("bigint")
    own = n.join(instruments.select(F.col("symbol").alias("_sym")).distinct(), "_sym", "left_semi").select("_sym", pace.alias("_w"))
    return x.join(small(own, instruments), F.col("symbol") == F.col("_sym"), "left").withColumn("w", F.coalesce("_w", F.lit(longest))).drop("_sym", "_w")


def readings(quotes: DataFrame, fills: DataFrame, bars: DataFrame, instruments: DataFrame, feeds: DataFrame) -> DataFrame:
    """``tab`` (place in ``TABS``), ``symbol``, ``stretch``, ``t``, ``id``, ``x`` of all readings that aren't missing."""
    q = quotes.select(F.lit(0).alias("tab"), "symbol", us(F.col("time")).alias("t"), F.col("quote_id").alias("id"), F.col("ask").alias("x"))
    f = fills.select("fill_id", "instrument", "time", "price").withColumn("_n", plain(F.col("instrument"))).join(small(symbol_names(instruments), instruments), F.col("_n") == F.col("_name"))
    f = f.select(F.lit(1).alias("tab"), F.col("_symbol").alias("symbol"), us(F.col("time")).alias("t"), F.col("fill_id").alias("id"), F.col("price").alias("x"))
    # a stock has one bar a day: a stretch of 4,000 days is never long
    b = normalise_bars(bars.select("bar_id", "feed", "symbol", "date", "close"), feeds)
    b = b.select(F.lit(2).alias("tab"), "symbol", F.col("utc_us").alias("t"), F.col("bar_id").alias("id"), F.col("close").alias("x"), F.lit(4000 * _DAY).alias("w"))
    all_ = _paced(q, _DAY, instruments).unionByName(_paced(f, 16 * _DAY, instruments)).unionByName(b)
    all_ = all_.filter(F.col("x").isNotNull() & ~F.isnan("x") & F.col("t").isNotNull() & F.col("symbol").isNotNull() & F.col("id").isNotNull())
    return all_.withColumn("stretch", F.floor(F.col("t") / F.col("w"))).drop("w")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table | None, np.ndarray, bool, bool]]:
    """Sorted rows as tables, with the number of each row's stretch: many whole stretches, or a piece of
    one long stretch and whether it goes on from the piece before and into the next one. The last
    piece may have no rows (and no table). Each row is numbered once and copied a bounded number of times."""
    kept: list[tuple[pa.RecordBatch, np.ndarray]] = []
    rows, number, end, long = 0, -1, None, -1

    def numbered(batch: pa.RecordBatch) -> np.ndarray:
        nonlocal number, end
        new = np.zeros(batch.num_rows, bool)
        for name in (*_KEY, "stretch"):
            col = batch.column(name)
            code = col.dictionary_encode().indices.to_numpy() if name == "symbol" else col.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        first, last = ([batch.column(n)[k].as_py() for n in (*_KEY, "stretch")] for k in (0, batch.num_rows - 1))
        new[0], end = first != end, last
        own = number + np.cumsum(new)
        number = int(own[-1])
        return own

    def taken(final: bool) -> Iterator[tuple[pa.Table | None, np.ndarray, bool, bool]]:
        nonlocal kept, rows, long
        table, own = pa.Table.from_batches([b for b, _ in kept]), np.concatenate([o for _, o in kept])
        n, a = len(own), 0
        if long >= 0:  # the next piece of the long stretch
            a = int(np.searchsorted(own, long, side="right"))
            more = a == n and not final
            yield table.slice(0, a) if a else None, own[:a], True, more
            long = long if more else -1
        b = n if final else int(np.searchsorted(own, own[-1]))
        if a < n and b > a:
            yield table.slice(a, b - a), own[a:b], False, False
        elif a < n and n - a >= ROWS:
            long, b = int(own[-1]), n
            yield table.slice(a), own[a:], False, True
        b = max(a, b)
        kept, rows, at = [], n - b, b
        for batch in table.slice(b).to_batches():
            kept.append((batch, own[at : at + batch.num_rows]))
            at += batch.num_rows

    for batch in batches:
        if batch.num_rows:
            kept.append((batch, numbered(batch)))
            rows += batch.num_rows
        if rows >= ROWS:
            yield from taken(False)
    if rows:
        yield from taken(True)
    elif long >= 0:
        yield None, np.zeros(0, np.int64), True, False


def _fresh(own: np.ndarray, t: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """False for a row that repeats the one before."""
    return np.r_[True, (own[1:] != own[:-1]) | (t[1:] != t[:-1]) | (ident[1:] != ident[:-1])][: len(t)]


_SURVEY = "kind int, tab int, symbol string, stretch bigint, p int, k int, a bigint, n bigint, x double"
_BY = ["kind", "tab", "symbol", "stretch", "p", "k", "a"]


def _bin(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log(x) / _BIN).astype(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds: 0 moves (k hour, a bin), 1 runs inside a piece (a length), 2 run at an edge of piece p
    (k 1 first, 2 last, 3 both; a length), 3 reading near an edge (a time, n id), 4 moves by time (a bin)."""
    p, before = 0, None
    for table, own, on, _ in _chunks(batches):
        p, before = (p + 1, before) if on else (0, None)
        if table is None:
            continue
        get = lambda n, table=table: table.column(n).to_numpy()
        keep = _fresh(own, get("t"), get("id"))
        if before is not None:  # the reading before the piece
            keep &= ~((get("t") == before[0]) & (get("id") == before[1]))
        own, t, ident, x = own[keep], get("t")[keep], get("id")[keep], get("x")[keep]
        row, n = np.flatnonzero(keep), len(own)
        if not n:
            continue
        first = np.r_[True, own[1:] != own[:-1]]
        start = np.flatnonzero(first)
        end = np.append(start[1:], n)
        place = np.arange(n) - np.repeat(start, end - start)
        left = np.repeat(end, end - start) - np.arange(n) - 1
        out = []
        log = np.log(x)
        move, took = np.abs(np.diff(log, prepend=log[:1])), np.diff(t, prepend=t[:1])
        some = ~first & (move > 0)
        if before is not None:
            move[0], took[0] = abs(log[0] - np.log(before[2])), t[0] - before[0]
            some[0] = move[0] > 0
        before = (t[-1], ident[-1], x[-1])
        hour = (t[some] % _DAY) // _HOUR
        out.append((0, row[some], hour, _bin(move[some]), np.ones(int(some.sum()), np.int64), None))
        out.append((4, row[some], None, _bin(move[some] / np.maximum(took[some], 1)), np.ones(int(some.sum()), np.int64), None))
        run = np.flatnonzero(first | (np.diff(x, prepend=x[:1]) != 0))
        length = np.diff(np.append(run, n))
        head, tail = first[run], left[run + length - 1] == 0
        inner = ~head & ~tail
        out.append((1, row[run[inner]], None, length[inner], np.ones(int(inner.sum()), np.int64), None))
        edge = head | tail
        out.append((2, row[run[edge]], head[edge] + 2 * tail[edge], length[edge], None, x[run[edge]]))
        near = (place < NEAR) | (left < NEAR)
        out.append((3, row[near], None, t[near], ident[near], x[near]))
        for kind, at, k, a, m, v in out:
            size, at = len(at), pa.array(at)
            full = lambda z, size=size: np.zeros(size, np.int64) if z is None else z
            edged = kind in (2, 3)
            part = pa.table({
                "kind": pa.array(np.full(size, kind), pa.int32()),
                "tab": table.column("tab").take(at),
                "symbol": table.column("symbol").take(at),
                "stretch": table.column("stretch").take(at) if edged else pa.array(np.zeros(size, np.int64)),
                "p": pa.array(np.full(size, p if edged else 0), pa.int32()),
                "k": pa.array(full(k), pa.int32()),
                "a": pa.array(full(a), pa.int64()),
                "n": pa.array(full(m), pa.int64()),
                "x": pa.array(np.zeros(size) if v is None else v, pa.float64()),
            })
            if not edged:
                part = part.group_by(_BY).aggregate([("n", "sum")]).rename_columns([*_BY, "n"])
                part = part.append_column("x", pa.array(np.zeros(part.num_rows)))
            yield from part.select([*_BY, "n", "x"]).combine_chunks().to_batches()


def _quartiles(bins: DataFrame, by: list[str]) -> DataFrame:
    """``reach`` and ``n`` of sketches: the expanded fence of the moves that they count."""
    up = Window.partitionBy(*by).orderBy("a")
    c = bins.groupBy(*by, "a").agg(F.sum("n").alias("n"))
    c = c.withColumns({"below": F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy(*by))})
    middle = F.exp((F.col("a") - 0.5) * _BIN)  # of a bin, within the relative error of all its values
    at = lambda p: F.min(F.when(F.col("below") >= p * F.col("all"), middle))
    q = c.groupBy(*by).agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("all").alias("n"))
    return q.select(*by, "n", (F.col("q3") + FENCE * (F.col("q3") - F.col("q1"))).alias("reach"))


_HEADER = ("tab", "symbol", "stretch", "kind", "t", "id", "x", "e", "h")


def _context(s: DataFrame) -> DataFrame:
    """Rows that go before and beside the readings of each stretch, from the survey.

    kind 0: the source's limits (h fences of the 24 hours, x that of moves by
    time, t run limit, id length of the run that the stretch's first run is part
    of, e that of the last one times two, plus one if the first run goes on from
    an earlier stretch). kind 2, e 1: a reading beside the stretch. (Of the rows
    of the readings themselves kind -1 are values that can't be, kind 2 the others.)
    """
    source = Window.partitionBy(*_KEY)
    # runs over edges: the last run of a piece and the first one of the next
    chain = source.orderBy("stretch", "p", "k")
    new = (F.col("x") != F.lag("x").over(chain)) | ((F.col("stretch") == F.lag("stretch").over(chain)) & (F.col("p") == F.lag("p").over(chain)))
    edge = s.filter("kind = 2").withColumn("_new", F.coalesce(new.cast("int"), F.lit(1)))
    edge = edge.withColumn("_chain", F.sum("_new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("total", F.sum("a").over(Window.partitionBy(*_KEY, "_chain")))
    lengths = s.filter("kind = 1").select(*_KEY, "a", "n").unionByName(edge.filter("_new = 1").select(*_KEY, F.col("total").alias("a"), F.lit(1).cast("bigint").alias("n")))
    lengths = lengths.groupBy(*_KEY, "a").agg(F.sum("n").alias("n"))
    up = source.orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    lengths = lengths.withColumns({"below": F.sum("n").over(up), "all": F.sum("n").over(source)})
    limit = lengths.filter(F.col("below") >= 0.9 * F.col("all")).groupBy(*_KEY).agg(F.greatest(F.ceil(F.min("a") * RUN_FACTOR + 1), F.lit(RUN_LEAST)).alias("limit"))
    heads, tails = (F.col("k") % 2 == 1) & (F.col("p") == 0), F.col("k") >= 2
    ends = edge.groupBy(*_KEY, "stretch").agg(
        F.max(F.when(heads, F.col("total"))).alias("head"), F.max_by(F.when(tails, F.col("total")), F.when(tails, F.col("p"))).alias("tail"), F.max(F.when(heads, 1 - F.col("_new"))).alias("goes_on")
    )
    # moves over edges belong to the sketches too
    order = source.orderBy("stretch", "a", "n")
    near = s.filter("kind = 3").withColumns({"_s": F.lag("stretch").over(order), "_m": F.abs(F.log("x") - F.log(F.lag("x").over(order))), "_took": F.greatest(F.col("a") - F.lag("a").over(order), F.lit(1))})
    over = near.filter((F.col("_s") != F.col("stretch")) & (F.col("_m") > 0)).select(*_KEY, F.floor(F.pmod(F.col("a"), F.lit(_DAY)) / _HOUR).cast("int").alias("k"), F.col("_m"), "_took")
    over = over.select(*_KEY, F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), "k", F.ceil(F.log("_m") / _BIN).alias("a"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit(4).alias("kind"), F.lit(0).alias("k"), F.ceil(F.log(F.col("_m") / F.col("_took")) / _BIN).alias("a"), F.lit(1).cast("bigint").alias("n")),
    )))
    bins = s.filter("kind in (0, 4)").select(*_KEY, "kind", "k", "a", "n").unionByName(over.select(*_KEY, "kind", "k", "a", "n")).groupBy(*_KEY, "kind", "k", "a").agg(F.sum("n").alias("n"))
    both = _quartiles(bins, [*_KEY, "kind"])
    reach = both.groupBy(*_KEY).agg(F.max(F.when(F.col("kind") == 0, F.col("reach"))).alias("reach"), F.max(F.when(F.col("kind") == 4, F.col("reach"))).alias("fast"))
    hourly = _quartiles(bins.filter("kind = 0"), [*_KEY, "k"]).groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("n", "reach")))).alias("_h"))
    own = lambda k: F.try_element_at(F.col("_h"), k)
    drawn = lambda k: F.when(own(k).isNull(), F.col("reach")).otherwise(F.col("reach") + own(k)["n"] / (own(k)["n"] + HOUR_WEIGHT) * (own(k)["reach"] - F.col("reach")))
    reach = reach.join(hourly, list(_KEY)).select(*_KEY, "fast", F.array(*[drawn(F.lit(k)) for k in range(24)]).alias("h"))
    limits = ends.join(limit, list(_KEY)).join(reach, list(_KEY), "left")
    zero = F.lit(0).cast("bigint")
    a = limits.select(*_KEY, "stretch", F.lit(0).alias("kind"), F.col("limit").cast("bigint").alias("t"), F.col("head").alias("id"), F.coalesce("fast", F.lit(float("inf"))).alias("x"), (F.col("tail") * 2 + F.col("goes_on")).alias("e"), "h")
    # each reading near an edge also goes to the stretches of the readings up to NEAR places away
    beside = F.array_distinct(F.array_compact(F.array(*[f("stretch", j).over(order) for f in (F.lag, F.lead) for j in range(1, NEAR + 1)])))
    c = s.filter("kind = 3").withColumn("_beside", beside).withColumn("_to", F.explode("_beside")).filter(F.col("_to") != F.col("stretch"))
    c = c.select(*_KEY, F.col("_to").alias("stretch"), F.lit(2).alias("kind"), F.col("a").alias("t"), F.col("n").alias("id"), "x", (zero + 1).alias("e"), F.lit(None).cast("array<double>").alias("h"))
    return a.unionByName(c).select(*_HEADER)


def _jumps(own: np.ndarray, log: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which readings lie in an excursion of at most ``LONGEST`` readings."""
    n, k = len(log), LONGEST
    move = np.abs(np.diff(log, prepend=np.nan))
    move[np.r_[True, own[1:] != own[:-1]]] = 0
    padded = np.r_[np.zeros(k), move, np.zeros(k)]
    rough = np.max([padded[k + j : k + j + n] for j in range(1 - k, k + 1)], axis=0)
    at = np.flatnonzero(rough >= FACTOR * reach)
    if not len(at):
        return np.zeros(n, bool)
    v = {}
    for j in range(-ASIDE, ASIDE + 1):
        to = np.clip(at + j, 0, n - 1)
        v[j] = np.where((at + j >= 0) & (at + j < n) & (own[to] == own[at]), log[to], np.nan)
    far, hit = FACTOR * reach[at], np.zeros(len(at), bool)
    with np.errstate(invalid="ignore"):
        for p in range(k):
            for q in range(k - p):
                lo, hi = v[-p - 1], v[q + 1]
                off = np.min([np.minimum(np.abs(v[j] - lo), np.abs(v[j] - hi)) for j in range(-p, q + 1)], axis=0)
                hit |= (off >= far) & (np.abs(lo - hi) < BACK * off)
    # between two spikes a regular reading also stands off; the middle of its surroundings tells
    at, far = at[hit], far[hit]
    v = {j: v[j][hit] for j in v if j}
    before, after = (sum(~np.isnan(v[side * j]) for j in range(1, k + 1)) for side in (-1, 1))
    around = np.stack([np.where(abs(j) <= 2 * k - (after if j < 0 else before), v[j], np.nan) for j in v])
    middle = np.nanmedian(around, axis=0) if len(at) else np.zeros(0)
    out = np.zeros(n, bool)
    out[at[np.abs(log[at] - middle) >= reach[at]]] = True
    return out


def _rates(own: np.ndarray, log: np.ndarray, t: np.ndarray, reach: np.ndarray, fast: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """Which readings stand beyond the fence, having gone there and back faster than moves by time go;
    jumps and the readings next to them are left out."""
    n = len(log)
    step, same = np.diff(log), own[1:] == own[:-1]
    pace = np.abs(step) / np.maximum(np.diff(t), 1)
    out = np.zeros(n, bool)
    if n > 2:
        go, back = step[:-1], step[1:]
        far = np.minimum(np.abs(go), np.abs(back)) >= reach[1:-1]
        out[1:-1] = ~(jump[:-2] | jump[1:-1] | jump[2:]) & same[:-1] & same[1:] & far & (go * back < 0) & (np.minimum(pace[:-1], pace[1:]) >= fast[1:-1])
    return out


def _given(table: pa.Table, rows: np.ndarray, flag: str) -> Iterator[pa.RecordBatch]:
    if len(rows):
        i = pa.array(rows)
        yield from _named(table.column("tab").take(i), table.column("id").take(i), flag)


def _named(tab, ident, flag: str) -> Iterator[pa.RecordBatch]:
    yield from pa.table({"tab": tab, "rec_id": ident, "flag": pa.array([flag] * len(ident))}).combine_chunks().to_batches()


class _Long:
    """The flags of one stretch that comes in pieces: what is kept are the last readings, the source's
    limits and, of a run that may still become a stuck one, the ids."""

    def __init__(self) -> None:
        self.tab, self.begun, self.off = 0, 0, None
        self.t, self.id, self.x, self.real = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        self.hours, self.fast, self.limit, self.head, self.tail, self.goes_on = np.full(24, np.inf), np.inf, 2**60, 0, 0, False
        self.value, self.count, self.first, self.ids = np.nan, 0, True, []

    def piece(self, table: pa.Table | None, more: bool) -> Iterator[pa.RecordBatch]:
        n0 = len(self.x)
        if table is not None:
            get = lambda n: table.column(n).to_numpy()
            kind, t, ident, x, e = get("kind"), get("t"), get("id"), get("x"), get("e")
            self.tab = int(get("tab")[0])
            off = np.flatnonzero(kind < 0)
            if len(off):
                fresh = _fresh(np.zeros(len(off)), t[off], ident[off])
                fresh[0] = (t[off[0]], ident[off[0]]) != self.off
                self.off = (t[off[-1]], ident[off[-1]])
                yield from _given(table, off[fresh], "value")
            for i in np.flatnonzero(kind == 0):
                h = table.column("h")[int(i)].as_py()
                self.hours = np.array(h) if h is not None else self.hours
                self.fast, self.limit, self.head, self.tail, self.goes_on = x[i], t[i], ident[i], e[i] // 2, e[i] % 2 == 1
            rows = kind == 2
            self.t, self.id, self.x, self.real = np.r_[self.t, t[rows]], np.r_[self.id, ident[rows]], np.r_[self.x, x[rows]], np.r_[self.real, e[rows] == 0]
            keep = _fresh(np.zeros(len(self.t)), self.t, self.id)
            self.t, self.id, self.x, self.real = self.t[keep], self.id[keep], self.x[keep], self.real[keep]
        n, own = len(self.x), np.zeros(len(self.x), np.int64)
        log, reach = np.log(self.x), self.hours[(self.t % _DAY) // _HOUR]
        decided = max(self.begun, n - NEAR) if more else n
        now = self.real & (np.arange(n) >= self.begun) & (np.arange(n) < decided)
        jump = _jumps(own, log, reach) if n else np.zeros(0, bool)
        rate = _rates(own, log, self.t, reach, np.full(n, self.fast), jump)
        for flag, hit in (("jump", jump), ("rate", rate)):
            yield from self._out(self.id[hit & now], flag)
        yield from self._runs(self.x[n0:][self.real[n0:]], self.id[n0:][self.real[n0:]])
        if not more:
            yield from self._close(True)
        start = max(0, n - 2 * NEAR)
        self.begun = decided - start
        self.t, self.id, self.x, self.real = self.t[start:], self.id[start:], self.x[start:], self.real[start:]

    def _out(self, ids: np.ndarray, flag: str) -> Iterator[pa.RecordBatch]:
        if len(ids):
            yield from _named(pa.array(np.full(len(ids), self.tab), pa.int32()), pa.array(ids, pa.int64()), flag)

    def _runs(self, x: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(x, prepend=self.value) != 0)
        edges = np.unique(np.r_[0, edges, len(x)]) if len(x) else np.zeros(0, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if x[a] != self.value and self.count:
                yield from self._close(False)
                self.first = False
            self.value = x[a]
            self.count += b - a
            self.ids.append(ids[a:b])
            if self.count >= self.limit and not self.first:  # stuck for sure: nothing more is kept of it
                yield from self._emit(False)

    def _emit(self, goes_on: bool) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(self.ids)
        begins = self.count == len(ids) and not goes_on  # the run's first reading is no case
        self.ids = [np.zeros(0, np.int64)]
        yield from self._out(ids[1:] if begins else ids, "stuck")

    def _close(self, last: bool) -> Iterator[pa.RecordBatch]:
        total = self.head if self.first else self.tail if last else self.count
        if self.count and total >= self.limit:
            yield from self._emit(self.first and self.goes_on)
        self.count, self.ids = 0, []


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    long = None
    for table, own, on, more in _chunks(batches):
        if on or more:
            long = long if on else _Long()
            yield from long.piece(table, more)
            continue
        own = own - own[0]
        get = lambda n, table=table: table.column(n).to_numpy()
        kind, t, ident, x, e = get("kind"), get("t"), get("id"), get("x"), get("e")
        yield from _given(table, np.flatnonzero((kind < 0) & _fresh(own, t, ident)), "value")
        groups = int(own[-1]) + 1
        reach, fast, limit, head, tail, goes_on = np.full((groups, 24), np.inf), np.full(groups, np.inf), np.full(groups, 2**60), np.zeros(groups, np.int64), np.zeros(groups, np.int64), np.zeros(groups, bool)
        h = kind == 0
        fences = table.column("h").filter(pa.array(h)).combine_chunks()
        fences = pa.concat_arrays(fences.chunks) if isinstance(fences, pa.ChunkedArray) else fences
        reach[own[h][np.asarray(fences.is_valid())]] = fences.flatten().to_numpy(zero_copy_only=False).reshape(-1, 24)
        fast[own[h]], limit[own[h]], head[own[h]], tail[own[h]], goes_on[own[h]] = x[h], t[h], ident[h], e[h] // 2, e[h] % 2 == 1
        rows = kind == 2
        at, own, t, ident, x, real = np.flatnonzero(rows), own[rows], t[rows], ident[rows], x[rows], e[rows] == 0
        if not len(at):
            continue
        keep = _fresh(own, t, ident)
        at, own, t, ident, x, real = at[keep], own[keep], t[keep], ident[keep], x[keep], real[keep]
        log, far = np.log(x), reach[own, (t % _DAY) // _HOUR]
        jump = _jumps(own, log, far)
        jump, rate = jump & real, _rates(own, log, t, far, fast[own], jump) & real
        # runs, over the readings of the stretch itself
        r_at, r_own, r_x = at[real], own[real], x[real]
        n = len(r_at)
        first = np.r_[True, r_own[1:] != r_own[:-1]][:n]
        start = np.flatnonzero(first | (np.diff(r_x, prepend=r_x[:1]) != 0))
        length = np.diff(np.append(start, n))
        total, group = length.copy(), r_own[start]
        ends = np.r_[group[1:] != group[:-1], True][: len(group)]
        total[ends] = tail[group[ends]]
        total[first[start]] = head[group[first[start]]]
        stands = total >= limit[group]
        begins = np.zeros(n, bool)
        begins[start[~(first[start] & goes_on[group])]] = True
        stuck = np.repeat(stands, length) & ~begins
        for rows_, flag in ((at[jump], "jump"), (at[rate], "rate"), (r_at[stuck], "stuck")):
            yield from _given(table, rows_, flag)


TABS = ("quotes", "fills", "daily_bars")


def implausible(r: DataFrame) -> DataFrame:
    """``tab``, ``rec_id``, ``flag`` of the readings of ``readings()`` that can't be right.

    Rows that agree in tab, symbol, time and id count once. Readings with equal
    times are taken by id. Zero, negative and infinite readings are flagged and
    left out of the order. A source with fewer than two different readings has no
    jumps. The first and the last readings of a source, which have nothing on one
    side, are no jumps. A reading that is a jump isn't flagged for its rate too.
    Empty tables give no rows. The survey's table is written to the shared folder.
    """
    good = (F.col("x") > 0) & (F.col("x") != float("inf"))
    part = r.select("tab", "symbol", "stretch", "t", F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"))
    together = lambda df, *order: df.repartition(*_KEY, "stretch").sortWithinPartitions(*_KEY, "stretch", *order, "t", "id")
    s = written(together(part.filter(good)).mapInArrow(_survey, _SURVEY))
    data = part.select("tab", "symbol", "stretch", F.when(good, 2).otherwise(-1).alias("kind"), "t", "id", "x", F.lit(0).cast("bigint").alias("e"), F.lit(None).cast("array<double>").alias("h"))
    flagged = together(data.unionByName(_context(s)), "kind").mapInArrow(_flags, "tab int, rec_id bigint, flag string")
    return flagged.withColumn("tab", F.element_at(F.array(*map(F.lit, TABS)), F.col("tab") + 1))


def found(quotes: DataFrame, fills: DataFrame, bars: DataFrame, instruments: DataFrame, feeds: DataFrame) -> DataFrame:
    """``tab``, ``rec_id`` of the readings that can't be right: values, jumps and stuck ones."""
    return implausible(readings(quotes, fills, bars, instruments, feeds)).filter("flag <> 'rate'").select("tab", F.col("rec_id").cast("bigint").alias("rec_id")).distinct()
