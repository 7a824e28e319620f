"""Ordered simulation of positions: ticks from bars, signals, trackers with orders and stops.

One symbol of one run is a fold over its ticks and signals in order of time. The
relational parts (ticks from bars, the levels that trackers need, portfolio
figures from executions) are DataFrame expressions around it.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_join

NAN = float("nan")


def bar_ticks(bars: DataFrame, freq_seconds: int, half_spread: float = 0.0, by_colour: bool = False) -> DataFrame:
    """Four ticks of each bar: open, low, high, close at 0, 40, 60 and 80 % of its length.

    With ``by_colour`` falling bars go to the high first. Only open and close are
    ``real``: signals execute at them; the others serve stops and takes.
    """
    falls = (F.col("close") < F.col("open")) if by_colour else F.lit(False)
    second, third = F.when(falls, F.col("high")).otherwise(F.col("low")), F.when(falls, F.col("low")).otherwise(F.col("high"))
    at = lambda part: F.col("ts") + F.make_dt_interval(secs=F.lit(freq_seconds * part).cast("decimal(18,6)"))
    ticks = [F.struct(at(w).alias("ts"), F.lit(k).alias("leg"), p.alias("p"), F.lit(real).alias("real")) for k, (w, p, real) in enumerate([(0.0, F.col("open"), True), (0.4, second, False), (0.6, third, False), (0.8, F.col("close"), True)])]
    return bars.select("symbol", F.inline(F.array(*ticks))).select("symbol", "ts", "leg", (F.col("p") - half_spread).alias("bid"), (F.col("p") + half_spread).alias("ask"), "real")


class Tick(NamedTuple):
    us: int
    bid: float
    ask: float
    real: bool
    levels: dict[str, float]


class Book:
    """A position at average cost, with its executions.

    Buys go at the ask and sells at the bid unless a price is given. ``pnl`` is
    what the position is worth at its exit side, less cost, plus what was realised.
    """

    def __init__(self, fee: float = 0.0):
        self.fee, self.quantity, self.average, self.realised, self.fees = fee, 0.0, 0.0, 0.0, 0.0
        self.traded_us = 0
        self.rows: list[tuple] = []

    def trade(self, tick: Tick, target: float, comment: str = "", price: float | None = None, us: int | None = None) -> float:
        """Brings the position to ``target``; the PnL realised by it."""
        d = target - self.quantity
        if not d:
            return 0.0
        p = price if price is not None else tick.ask if d > 0 else tick.bid
        before = self.realised
        closing = -max(min(d, 0.0), -self.quantity) if self.quantity > 0 else max(min(d, -self.quantity), 0.0) if self.quantity < 0 else 0.0
        if closing:  # how much of the position is given up, without sign
            side = 1.0 if self.quantity > 0 else -1.0
            self.realised += closing * side * (p - self.average)
            self.quantity -= closing * side
            d += closing * side
        if d:
            self.average = (self.average * abs(self.quantity) + p * abs(d)) / (abs(self.quantity) + abs(d))
            self.quantity += d
        self.quantity = target
        cost = self.fee * abs(p * (target - (self.rows[-1][2] if self.rows else 0.0)))
        self.fees += cost
        self.traded_us = tick.us if us is None else us
        self.rows.append((self.traded_us, p, target, cost, comment, self.realised))
        return self.realised - before

    def pnl(self, bid: float, ask: float) -> float:
        return self.realised + self.quantity * ((bid if self.quantity > 0 else ask) - self.average)


class Tracker:
    """What turns signals into positions. One copy serves one symbol of one run."""

    def signal(self, book: Book, tick: Tick, target: float) -> float | None:
        """The position wanted for a signal, or None to leave it."""
        return target

    def guard(self, book: Book, tick: Tick) -> None:
        """Called on every tick, before ``tick``."""

    def tick(self, book: Book, tick: Tick) -> None:
        """Called on real ticks."""

    def info(self, book: Book, tick: Tick, text: str) -> None:
        """Called for signals that are texts."""


@dataclass
class TakeStop(Tracker):
    """Leaves at a take or a stop; a take fills at its price, a stop at the market unless ``exact``.

    Takes are met by the exit side of the quote and stops by the entry side; the
    take goes first within a tick.
    """

    size: float = 1.0
    take_points: float | None = None
    stop_points: float | None = None
    exact: bool = False
    percent: bool = False
    take: float | None = None
    stop: float | None = None
    takes: int = 0
    stops: int = 0

    def signal(self, book, tick, target):
        self.take = self.stop = None
        if target:
            side, mid = (1 if target > 0 else -1), (tick.bid + tick.ask) / 2
            unit = mid / 100 if self.percent else 1.0
            self.take = mid + side * self.take_points * unit if self.take_points else None
            self.stop = mid - side * self.stop_points * unit if self.stop_points else None
        return target * self.size

    def guard(self, book, tick):
        q = book.quantity
        if q and self.take is not None and (tick.bid >= self.take if q > 0 else tick.ask <= self.take):
            self.takes += 1
            self.leave(book, tick, self.take, "take")
        q = book.quantity
        if q and self.stop is not None and (tick.ask <= self.stop if q > 0 else tick.bid >= self.stop):
            self.stops += 1
            self.leave(book, tick, self.stop if self.exact else tick.ask if q > 0 else tick.bid, "stop")

    def leave(self, book, tick, price, why):
        book.trade(tick, 0.0, why, price)
        self.take = self.stop = None


@dataclass
class PartialTakes(TakeStop):
    """Several takes, each closing a part of what is left; ``whole`` keeps whole sizes by cutting."""

    ladder: Sequence[tuple[float, float]] = ()
    whole: bool = True
    open_takes: dict[float, float] = field(default_factory=dict)

    def signal(self, book, tick, target):
        out = super().signal(book, tick, target)
        self.take, side = None, 1 if target > 0 else -1
        mid = (tick.bid + tick.ask) / 2
        self.open_takes = {mid + side * d: f for d, f in self.ladder} if target else {}
        return out

    def guard(self, book, tick):
        q = book.quantity
        for price in sorted(self.open_takes, reverse=q < 0):
            q = book.quantity
            if q and (tick.bid >= price if q > 0 else tick.ask <= price):
                left = q * (1 - self.open_takes.pop(price))
                left = float(int(left)) if self.whole else left
                self.takes += 1
                book.trade(tick, left, "take" if not left else "part take", price)
                if not left:
                    self.open_takes, self.stop = {}, None
        super().guard(book, tick)
        if not book.quantity:
            self.open_takes = {}


@dataclass
class Order:
    price: float
    quantity: float
    stop: float | None = None
    takes: dict[float, float] = field(default_factory=dict)
    kind: str = "stop"


@dataclass
class Triggered(PartialTakes):
    """Pending stop or limit entries that fire when the price crosses them between two ticks."""

    entry: float = 0.0
    kind: str = "stop"
    orders: list[Order] = field(default_factory=list)
    last: Tick | None = None

    def signal(self, book, tick, target):
        self.orders = []
        if not target:
            self.open_takes, self.stop = {}, None
            return 0.0
        side = 1 if target > 0 else -1
        price = (tick.ask if side > 0 else tick.bid) + side * self.entry * (1 if self.kind == "stop" else -1)
        stop = price - side * self.stop_points if self.stop_points else None
        self.orders.append(Order(price, target * self.size, stop, {price + side * d: f for d, f in self.ladder}, self.kind))
        return None

    def fires(self, o: Order, tick: Tick) -> bool:
        if self.last is None:
            return False
        if (o.kind == "stop") == (o.quantity > 0):
            a, b = (self.last.ask, tick.ask) if o.quantity > 0 else (self.last.bid, tick.bid)
            return a < o.price <= b
        a, b = (self.last.ask, tick.ask) if o.quantity > 0 else (self.last.bid, tick.bid)
        return a > o.price >= b

    def guard(self, book, tick):
        for o in [o for o in self.orders if self.fires(o, tick)]:
            self.orders.remove(o)
            book.trade(tick, o.quantity, f"{o.kind} order", o.price)
            self.stop, self.open_takes = o.stop, dict(o.takes)
        self.last = tick
        super().guard(book, tick)


@dataclass
class SignalBar(Triggered):
    """A stop entry beyond the signal bar (levels ``bar_high``, ``bar_low``), stopped at its other end;
    with ``improve`` the entry follows a better bar."""

    tick_size: float = 0.0
    improve: bool = False

    def _place(self, tick, side, size):
        hi, lo = tick.levels.get("bar_high", NAN), tick.levels.get("bar_low", NAN)
        if hi == hi and lo == lo:
            price = hi + self.tick_size if side > 0 else lo - self.tick_size
            self.orders = [Order(price, size, lo - self.tick_size if side > 0 else hi + self.tick_size)]

    def signal(self, book, tick, target):
        self.orders = []
        if not target:
            self.stop = None
            return 0.0
        self._place(tick, 1 if target > 0 else -1, target * self.size)
        return None

    def tick(self, book, tick):
        if self.improve and self.orders:
            o = self.orders[0]
            hi, lo = tick.levels.get("bar_high", NAN), tick.levels.get("bar_low", NAN)
            if o.quantity > 0 and hi + self.tick_size < o.price or o.quantity < 0 and lo - self.tick_size > o.price:
                self._place(tick, 1 if o.quantity > 0 else -1, o.quantity)


@dataclass
class Expiring(Tracker):
    """Closes a position a given time after the last trade."""

    after_us: int = 0
    size: float = 1.0
    expired: int = 0

    def signal(self, book, tick, target):
        return target * self.size

    def tick(self, book, tick):
        if book.quantity and tick.us - book.traded_us >= self.after_us:
            self.expired += 1
            book.trade(tick, 0.0, "expired")


@dataclass
class AtrStop(TakeStop):
    """Take and stop at multiples of the level ``atr``."""

    take_multiple: float | None = None
    stop_multiple: float | None = None

    def signal(self, book, tick, target):
        a = tick.levels.get("atr", NAN)
        if target and a != a:
            return None
        self.take_points = self.take_multiple * a if self.take_multiple and target else None
        self.stop_points = self.stop_multiple * a if self.stop_multiple and target else None
        return super().signal(book, tick, target)


@dataclass
class Trailing(TakeStop):
    """A stop that follows the levels ``long_stop`` and ``short_stop`` and never loosens.

    With ``sided`` a signal against the level ``side`` is passed over.
    """

    sided: bool = False

    def signal(self, book, tick, target):
        side = tick.levels.get("side", 0.0)
        if target and (book.quantity or self.sided and side * target < 0):
            return None
        level = tick.levels.get("long_stop" if target > 0 else "short_stop", NAN)
        self.stop = level if target and level == level else None
        return target * self.size if not target or self.stop is not None else None

    def tick(self, book, tick):
        q = book.quantity
        level = tick.levels.get("long_stop" if q > 0 else "short_stop", NAN)
        if q and level == level:
            self.stop = level if self.stop is None else max(self.stop, level) if q > 0 else min(self.stop, level)


@dataclass
class Pyramid(TakeStop):
    """Adds to a position each ``next_multiple`` of the level ``atr`` in its favour, the stop behind the average."""

    stop_multiple: float = 3.0
    next_multiple: float = 3.0
    factor: float = 0.5
    first_add: int = 3
    most: int = 3
    flat_at_most: bool = False
    step: int = 0
    level: float = NAN

    def signal(self, book, tick, target):
        a = tick.levels.get("atr", NAN)
        if not target:
            self.stop = None
            return 0.0
        if book.quantity or a != a:
            return None
        side = 1 if target > 0 else -1
        price = tick.ask if side > 0 else tick.bid
        self.step, self.stop, self.level = 1, price - side * self.stop_multiple * a, price + side * self.next_multiple * a
        return side * self.size

    def tick(self, book, tick):
        q, a = book.quantity, tick.levels.get("atr", NAN)
        if not q or a != a or self.level != self.level:
            return
        side = 1 if q > 0 else -1
        price = tick.bid if side > 0 else tick.ask
        if (price - self.level) * side < 0:
            return
        self.step += 1
        add = round(self.size * self.factor ** (self.step - self.first_add + 1)) if self.step >= self.first_add else 0
        if self.step > self.most or (self.step >= self.first_add and not add):
            self.level = NAN
            if self.flat_at_most:
                self.leave(book, tick, None, "last step")
            return
        if add:
            book.trade(tick, q + side * add, f"step {self.step}")
            self.stop = book.average - side * self.stop_multiple * a
        else:
            self.stop = book.average
        self.level += side * self.next_multiple * a


@dataclass
class Turtle(Pyramid):
    """Units of one size; leaves beyond the levels ``exit_low`` and ``exit_high``."""

    factor: float = 1.0
    first_add: int = 2
    most: int = 4

    def tick(self, book, tick):
        q = book.quantity
        lo, hi = tick.levels.get("exit_low", NAN), tick.levels.get("exit_high", NAN)
        if q > 0 and tick.bid < lo or q < 0 and tick.ask > hi:
            self.leave(book, tick, None, "exit")
        else:
            super().tick(book, tick)


@dataclass
class Dispatch(Tracker):
    """One tracker at a time, chosen by texts among the signals."""

    trackers: dict[str, Tracker] = field(default_factory=dict)
    active: str | None = None
    flat: bool = False

    def info(self, book, tick, text):
        if text in self.trackers:
            if self.flat and text != self.active and book.quantity:
                book.trade(tick, 0.0, f"{text} activated")
            self.active = text

    def signal(self, book, tick, target):
        return self.trackers[self.active].signal(book, tick, target) if self.active else target

    def guard(self, book, tick):
        if self.active:
            self.trackers[self.active].guard(book, tick)

    def tick(self, book, tick):
        if self.active:
            self.trackers[self.active].tick(book, tick)


@dataclass
class Pipeline(Tracker):
    """Trackers in a row: each may change a signal or stop it."""

    parts: Sequence[Tracker] = ()

    def signal(self, book, tick, target):
        for p in self.parts:
            if target is None:
                break
            target = p.signal(book, tick, target)
        return target

    def guard(self, book, tick):
        for p in self.parts:
            p.guard(book, tick)

    def tick(self, book, tick):
        for p in self.parts:
            p.tick(book, tick)


class Run:
    """One tracker with its book over ordered signals and ticks.

    A signal executes at the last real tick before it (``next_tick``: at the
    first one at or after it). A missing target changes nothing; a target equal
    to the position neither. Signals without a tick before them do nothing.
    """

    def __init__(self, tracker: Tracker, fee: float, next_tick: bool = False):
        self.book, self.tracker, self.next_tick, self.last, self.waiting = Book(fee), copy.deepcopy(tracker), next_tick, None, []
        self.given, self.position = 0, 0.0

    def signal(self, us: int, target: float, text: str | None) -> None:
        if self.next_tick:
            self.waiting.append((us, target, text))
        elif self.last is not None:
            self._execute(self.last, us, target, text)

    def tick(self, tick: Tick) -> None:
        if self.waiting and tick.real:
            for w in self.waiting:
                self._execute(tick, *w)
            self.waiting = []
        self.tracker.guard(self.book, tick)
        if tick.real:
            self.tracker.tick(self.book, tick)
            self.last = tick

    def _execute(self, tick: Tick, us: int, target: float, text: str | None) -> None:
        if text:
            self.tracker.info(self.book, tick._replace(us=us), text)  # what it trades, it trades at the text's time
        elif target == target:
            want = self.tracker.signal(self.book, tick, target)
            if want is not None and want == want and want != self.book.quantity:
                self.book.trade(tick, want, "signal", us=us)

    def taken(self) -> list[tuple]:
        """(us, seq, price, position, quantity, fee, comment, realised) of the executions since the last call."""
        rows = self.book.rows[1 if self.given else 0 :]
        out = []
        for us, price, position, fee, comment, realised in rows:
            out.append((us, self.given, price, position, position - self.position, fee, comment, realised))
            self.given, self.position = self.given + 1, position
        self.book.rows = self.book.rows[-1:]
        return out


def fold(rows: pd.DataFrame, tracker: Tracker, fee: float, levels: Sequence[str], next_tick: bool = False) -> list[tuple]:
    """Executions of one symbol's ordered rows: kind 1 ticks, the others signals."""
    run, columns = Run(tracker, fee, next_tick), [rows[c].to_numpy() for c in levels]
    for i, (us, kind, bid, ask, real, target, text) in enumerate(zip(rows["_us"], rows["_kind"], rows.bid, rows.ask, rows.real, rows.target, rows["info"], strict=True)):
        if kind < 1:
            run.signal(us, target, text)
        else:
            run.tick(Tick(us, bid, ask, bool(real), {n: c[i] for n, c in zip(levels, columns, strict=True)}))
    return run.book.rows


#: Order of rows with one time: the runs, texts, targets, ticks.
START, TEXT, TARGET, TICK = -2, -1, 0, 1
#: Groups into which the runs of a symbol are cut; its ticks go once to each.
GROUPS = 8
_OUT = (("us", pa.int64()), ("seq", pa.int32()), ("price", pa.float64()), ("position", pa.float64()), ("quantity", pa.float64()), ("fee", pa.float64()), ("comment", pa.string()), ("realised", pa.float64()))


def _streamed(batches: Iterator[pa.RecordBatch], tracker: Tracker, fee: float, names: Sequence[str], next_tick: bool, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of symbol and group, a batch at a time: all runs of a group go over its ticks once.

    What is held is one batch, and a tracker and a book per run of the group.
    """
    group, runs = None, {}
    for batch in batches:
        get = {n: batch.column(n).to_pylist() for n in ("_symbol", "_g", "_us", "_kind", "real", "info", *(f"_key_{k}" for k in keys))}
        numbers = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("bid", "ask", "target", *names)}
        owners, rows = [], []

        def give(of: dict) -> None:
            for key, run in of.items():
                for r in run.taken():
                    owners.append(key)
                    rows.append(r)

        for i in range(batch.num_rows):
            own, kind = (get["_symbol"][i], get["_g"][i]), get["_kind"][i]
            if own != group:
                give(runs)
                group, runs = own, {}
            if kind == TICK:
                tick = Tick(get["_us"][i], numbers["bid"][i], numbers["ask"][i], bool(get["real"][i]), {n: numbers[n][i] for n in names})
                for run in runs.values():
                    run.tick(tick)
            else:
                key = tuple(get[f"_key_{k}"][i] for k in keys)
                if kind == START:
                    runs[key] = Run(tracker, fee, next_tick)
                else:
                    runs[key].signal(get["_us"][i], numbers["target"][i], get["info"][i])
        give(runs)
        if rows:
            columns = [pa.array([o[j] for o in owners], batch.column(f"_key_{k}").type) for j, k in enumerate(keys)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(_OUT))], names=[*keys, *(n for n, _ in _OUT)])


def simulate(signals: DataFrame, ticks: DataFrame, tracker: Tracker, fee: float = 0.0, levels: DataFrame | None = None, names: Sequence[str] = (), keys: Sequence[str] = ("symbol",), next_tick: bool = False, groups: int = GROUPS) -> DataFrame:
    """Executions (keys, ts, seq, price, position, quantity, fee, comment, realised).

    ``signals``: keys (symbol among them), ts, target and maybe info; ``ticks``:
    symbol, ts, bid, ask, real; ``levels``: symbol, ts and the columns ``names``
    that the tracker reads, known from their time on. Of signals with one time
    texts go first, then lower targets. With more keys than the symbol each of
    their values is a run; a symbol's runs are cut into ``groups`` and its ticks
    go once to each group, in order, however many runs there are. Rows without
    time or symbol are left out.
    """
    t = asof_join(ticks, levels, ["symbol"], "ts", list(names)).drop("right_ts") if levels is not None else ticks
    info = F.col("info").cast("string") if "info" in signals.columns else F.lit(None).cast("string")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    others = [k for k in keys if k != "symbol"]
    group = F.pmod(F.xxhash64(*others), F.lit(groups)).cast("int") if others else F.lit(0)
    own = [F.col(k).alias(f"_key_{k}") for k in keys]
    s = signals.filter(F.col("ts").isNotNull() & F.col("symbol").isNotNull())
    starts = s.select(*keys).distinct().select(F.col("symbol").alias("_symbol"), group.alias("_g"), F.lit(-(1 << 63)).cast("bigint").alias("_us"), F.lit(START).alias("_kind"), *own)
    given = s.select(F.col("symbol").alias("_symbol"), group.alias("_g"), micros.alias("_us"), F.when(info.isNotNull(), TEXT).otherwise(TARGET).alias("_kind"), *own, F.col("target").cast("double").alias("target"), info.alias("info"))
    t = t.filter(F.col("ts").isNotNull()).select(F.col("symbol").alias("_symbol"), micros.alias("_us"), F.lit(TICK).alias("_kind"), *([F.col("leg")] if "leg" in t.columns else []), F.col("bid").cast("double").alias("bid"), F.col("ask").cast("double").alias("ask"), "real", *[F.col(n).cast("double").alias(n) for n in names])
    t = t.join(starts.select("_symbol", "_g").distinct(), "_symbol") if others else t.withColumn("_g", F.lit(0))
    x = starts.unionByName(given, allowMissingColumns=True).unionByName(t, allowMissingColumns=True)
    order = ["_symbol", "_g", "_us", "_kind", *(["leg"] if "leg" in x.columns else []), *[f"_key_{k}" for k in keys], "target", "info"]
    schema = ", ".join(f"`{k}` {signals.schema[k].dataType.simpleString()}" for k in keys)
    e = x.repartition("_symbol", "_g").sortWithinPartitions(*order).mapInArrow(lambda b: _streamed(b, tracker, fee, names, next_tick, keys), f"{schema}, us bigint, seq int, price double, position double, quantity double, fee double, comment string, realised double")
    return e.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")


def portfolio_log(executions: DataFrame, marks: DataFrame) -> DataFrame:
    """What each symbol holds at each mark: ``symbol``, ``ts``, ``pos``, ``price``, ``value``, ``pnl``, ``commissions`` (so far).

    ``executions``: of ``simulate``; ``marks``: symbol, ts, bid, ask. Longs are
    worth the bid, shorts the ask; the PnL is what was realised and what the
    position would give. An execution at a mark's time counts.
    """
    from .portfolio import linear_pnl

    fees = executions.groupBy("symbol", "ts").agg(F.sum("fee").alias("fee"))
    fees = fees.withColumn("commissions", F.sum("fee").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    x = linear_pnl(executions, marks)
    x = asof_join(x, fees, ["symbol"], "ts", ["commissions"]).drop("right_ts")
    price = F.when(F.col("pos") != 0, F.col("value") / F.nullif(F.col("pos"), F.lit(0.0)))
    return x.select("symbol", "ts", "pos", price.alias("price"), "value", "pnl", F.coalesce("commissions", F.lit(0.0)).alias("commissions"))


def convert_cross(amounts: DataFrame, rates: DataFrame, column: str, home: str) -> DataFrame:
    """``column`` in the currency ``home``, by the rate last known at each row's time.

    ``amounts``: ts, currency and the column; ``rates``: base, quote, ts, rate (how
    many of the quote one of the base is). Of an amount's own pair with ``home``
    that way round or the other, whichever is newer counts, the former if both
    are equally new; without either, none (null). An amount in ``home`` stays.
    """
    direct = rates.filter(F.col("quote") == home).select(F.col("base").alias("currency"), "ts", F.col("rate").alias("_k"), F.lit(1).alias("_way"))
    inverse = rates.filter(F.col("base") == home).select(F.col("quote").alias("currency"), "ts", (1 / F.nullif(F.col("rate"), F.lit(0.0))).alias("_k"), F.lit(0).alias("_way"))
    x = asof_join(amounts, direct.unionByName(inverse).filter(F.col("_k").isNotNull()), ["currency"], "ts", ["_k"], seq="_way").drop("right_ts")
    return x.withColumn(f"{column}_converted", F.when(F.col("currency") == home, F.col(column)).otherwise(F.col(column) * F.col("_k"))).drop("_k")


def convert(amounts: DataFrame, rates: DataFrame, column: str, invert: bool = False) -> DataFrame:
    """``column`` by the rate of another pair last known at each row's time (``invert``: divided)."""
    x = asof_join(amounts, rates.select("symbol", "ts", "rate"), ["symbol"], "ts", ["rate"]).drop("right_ts")
    return x.withColumn(f"{column}_converted", F.col(column) / F.nullif("rate", F.lit(0.0)) if invert else F.col(column) * F.col("rate"))


def inverse_pnl(executions: DataFrame, mark: DataFrame) -> DataFrame:
    """PnL of inverse contracts in the base currency: the sum of quantity by price, less the value at the mark."""
    a = executions.groupBy("symbol").agg(F.sum("quantity").alias("q"), F.sum(F.col("quantity") / F.col("price")).alias("c"))
    return a.join(mark, "symbol").select("symbol", "q", (F.col("c") - F.col("q") / F.col("price")).alias("pnl"))
