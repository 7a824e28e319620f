"""Indicators of bars as steps: each takes the next bar and gives its figures.

A step keeps what it needs of the bars before. The bar that is still open is
asked for with ``peek``, which leaves the step as it was: every new tick may
change the open bar and is peeked at, and the bar is committed once it is closed.
``freeze`` and ``thaw`` turn a step's state into plain numbers and back, so that a
stream keeps it in typed columns.
"""

from __future__ import annotations

import copy
import math
from collections import deque
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np

from .smoothers import NAN, STEPS


class Bar(NamedTuple):
    """``us``: the start, in microseconds since 1970 UTC."""

    us: int
    open: float
    high: float
    low: float
    close: float
    volume: float = 0.0


class BarStep:
    """Subclasses name their figures and define ``__call__``."""

    names: tuple[str, ...] = ("value",)

    def __call__(self, bar: Bar) -> tuple[float, ...]:
        raise NotImplementedError


def peek(step: Callable, x):
    """What the step would give for ``x``, without taking it."""
    return copy.deepcopy(step)(x)


class Smooth(BarStep):
    """A smoother of the closes."""

    def __init__(self, kind: str, n: int):
        self.step = STEPS[kind](n)

    def __call__(self, bar):
        return (self.step(bar.close),)


class Atr(BarStep):
    """Smoothed true range; a gap to the close before counts."""

    names = ("atr",)

    def __init__(self, n: int, kind: str = "sma"):
        self.step, self.close = STEPS[kind](n), NAN

    def __call__(self, bar):
        span = max([bar.high - bar.low, *([abs(bar.high - self.close), abs(bar.low - self.close)] if self.close == self.close else [])])
        self.close = bar.close
        return (self.step(span),)


class MinMax(BarStep):
    """Lowest low and highest high of n bars, missing before there are so many."""

    names = ("low", "high")

    def __init__(self, n: int):
        self.lows, self.highs = deque(maxlen=n), deque(maxlen=n)

    def __call__(self, bar):
        self.lows.append(bar.low)
        self.highs.append(bar.high)
        return (min(self.lows), max(self.highs)) if len(self.lows) == self.lows.maxlen else (NAN, NAN)


class WilliamsR(MinMax):
    """How far the close lies under the highest high of n bars, in percent of their range, negative."""

    names = ("williams",)

    def __call__(self, bar):
        low, high = super().__call__(bar)
        return ((high - bar.close) / (high - low) * -100 if high > low else NAN,)


class DayRange(BarStep):
    """Lowest low and highest high since the UTC day began."""

    names = ("day_low", "day_high")

    def __init__(self):
        self.day, self.low, self.high = -(1 << 40), NAN, NAN

    def __call__(self, bar):
        day = bar.us // 86_400_000_000
        fresh = day != self.day
        self.day, self.low, self.high = day, bar.low if fresh else min(self.low, bar.low), bar.high if fresh else max(self.high, bar.high)
        return self.low, self.high


class Deviation(BarStep):
    """Root mean square (of n - 1) of the distances of n closes from the mean that each had."""

    names = ("mean", "deviation")

    def __init__(self, n: int, kind: str = "sma"):
        self.mean, self.squares = STEPS[kind](n), deque(maxlen=n)

    def __call__(self, bar):
        m = self.mean(bar.close)
        if m == m:
            self.squares.append((bar.close - m) ** 2)
        n = self.squares.maxlen
        return m, math.sqrt(math.fsum(self.squares) / (n - 1)) if len(self.squares) == n else NAN


class Bollinger(BarStep):
    names = ("lower", "upper")

    def __init__(self, n: int, width: float = 2.0, kind: str = "sma"):
        self.own, self.width = Deviation(n, kind), width

    def __call__(self, bar):
        m, s = self.own(bar)
        return m - self.width * s, m + self.width * s


class BollingerAtr(BarStep):
    names = ("lower_atr", "upper_atr")

    def __init__(self, n: int, atr: int, width: float = 2.0, kind: str = "sma"):
        self.mean, self.atr, self.width = STEPS[kind](n), Atr(atr), width

    def __call__(self, bar):
        m, (a,) = self.mean(bar.close), self.atr(bar)
        return m - self.width * a, m + self.width * a


class Macd(BarStep):
    """The smoothed difference of a fast and a slow mean."""

    names = ("macd",)

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9, kind: str = "ema"):
        self.fast, self.slow, self.signal = (STEPS[kind](n) for n in (fast, slow, signal))

    def __call__(self, bar):
        return (self.signal(self.fast(bar.close) - self.slow(bar.close)),)


class Percentiles(BarStep):
    """Percentiles of n closes, interpolated."""

    def __init__(self, n: int, levels: Sequence[float]):
        self.levels, self.kept = tuple(levels), deque(maxlen=n)

    @property
    def names(self):
        return tuple(f"p{q:g}" for q in self.levels)

    def __call__(self, bar):
        self.kept.append(bar.close)
        full = len(self.kept) == self.kept.maxlen
        return tuple(float(v) for v in np.percentile(self.kept, self.levels)) if full else (NAN,) * len(self.levels)


class Denoised(BarStep):
    """Squared move from the open n bars before, with its sign, by the path of the bars' own moves."""

    names = ("trend",)

    def __init__(self, n: int):
        self.opens, self.moves = deque(maxlen=n), deque(maxlen=n + 1)

    def __call__(self, bar):
        self.moves.append(abs(bar.close - bar.open))
        out = NAN
        if len(self.opens) == self.opens.maxlen:
            d = bar.close - self.opens[0]
            path = max(math.fsum(self.moves), abs(d))
            out = abs(d) * d / path if path else NAN
        self.opens.append(bar.open)
        return (out,)


class DeltaRank(BarStep):
    """How many percentiles of the differences before, fast less slow denoised trend, the newest one
    reaches, with the slow trend's sign."""

    names = ("rank",)

    def __init__(self, fast: int, slow: int, n: int, levels: Sequence[float] = tuple(range(10, 101, 10))):
        self.fast, self.slow, self.levels, self.kept = Denoised(fast), Denoised(slow), tuple(levels), deque(maxlen=n - 1)

    def __call__(self, bar):
        (f,), (s,) = self.fast(bar), self.slow(bar)
        out, d = NAN, f - s
        if d == d:
            if len(self.kept) == self.kept.maxlen:
                out = float((np.percentile(self.kept, self.levels) <= d).sum()) * float(np.sign(s))
            self.kept.append(d)
        return (out,)


class Several(BarStep):
    """Steps side by side."""

    def __init__(self, *steps: BarStep):
        self.steps = list(steps)

    @property
    def names(self):
        return tuple(n for s in self.steps for n in s.names)

    def __call__(self, bar):
        return tuple(v for s in self.steps for v in s(bar))


def freeze(x) -> list[float]:
    """The state of a step as numbers, in order of its attributes' names."""
    if x is None:
        return [0.0]
    if isinstance(x, bool | int | float | np.number):
        return [1.0, float(x)]
    if isinstance(x, list | tuple | deque):
        return [2.0, float(len(x)), *(v for e in x for v in freeze(e))]
    if isinstance(x, str):
        return []
    return [v for _, e in sorted(vars(x).items()) for v in freeze(e)]


def thaw(x, numbers: list[float]):
    """A step made like the one that was frozen, brought to its state."""

    def read(x, at: int):
        if isinstance(x, str):
            return x, at
        if not (x is None or isinstance(x, bool | int | float | np.number | list | tuple | deque)):
            for name in sorted(vars(x)):
                value, at = read(getattr(x, name), at)
                setattr(x, name, value)
            return x, at
        kind = numbers[at]
        if kind == 0:
            return None, at + 1
        if kind == 1:
            value = numbers[at + 1]
            return type(x)(value) if isinstance(x, bool | int) else value, at + 2
        size, at, out = int(numbers[at + 1]), at + 2, []
        held = list(x)
        for k in range(size):
            value, at = read(held[k] if k < len(held) and not isinstance(x, deque) else 0.0, at)
            out.append(value)
        return (deque(out, maxlen=x.maxlen) if isinstance(x, deque) else type(x)(out)), at

    return read(x, 0)[0]


class LiveBars:
    """Ticks to bars of one length, each given to a step when it is closed."""

    def __init__(self, length_us: int, step: BarStep, bar: Bar | None = None):
        self.length, self.step, self.bar = length_us, step, bar

    def tick(self, us: int, price: float, volume: float = 1.0) -> list[tuple[Bar, tuple[float, ...]]]:
        """The bars that this tick closes (the one before it, if there is one)."""
        start = us // self.length * self.length
        out = self.closed(start)
        b = self.bar
        self.bar = Bar(start, price, price, price, price, volume) if b is None or out else Bar(b.us, b.open, max(b.high, price), min(b.low, price), price, b.volume + volume)
        return out

    def closed(self, us: int) -> list[tuple[Bar, tuple[float, ...]]]:
        """The open bar, if it ends at or before a time."""
        if self.bar is None or self.bar.us + self.length > us:
            return []
        bar, self.bar = self.bar, None
        return [(bar, self.step(bar))]

    def open_value(self) -> tuple[float, ...] | None:
        """What the step would give if the open bar ended now."""
        return None if self.bar is None else peek(self.step, self.bar)
