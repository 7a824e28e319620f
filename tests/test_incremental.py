"""Indicators as steps, and streams that keep them."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tideline.operators import incremental as N
from tideline.operators import smoothers
from tideline.streaming import flows

H = 3_600_000_000


def bars(n=90, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        o, c, a, b = rng.uniform(40, 60, 4)
        out.append(N.Bar(k * H, float(o), float(max(o, c) + a / 50), float(min(o, c) - b / 50), float(c), 1.0))
    return out


MAKE = [lambda: N.Atr(5), lambda: N.Atr(5, "kama"), lambda: N.MinMax(4), lambda: N.DayRange(), lambda: N.Bollinger(6, 2.0), lambda: N.BollingerAtr(6, 4, 1.5), lambda: N.Macd(3, 6, 4), lambda: N.Percentiles(7, (10, 50, 90)), lambda: N.WilliamsR(5), lambda: N.Denoised(6), lambda: N.DeltaRank(3, 6, 8), lambda: N.Smooth("tema", 3), lambda: N.Several(N.Atr(3), N.Smooth("zlema", 4))]


@pytest.mark.parametrize("make", MAKE)
def test_steps_go_on_from_their_numbers_and_peeking_takes_nothing(make):
    whole, s, x = make(), make(), bars()
    for k, b in enumerate(x):
        want = whole(b)
        np.testing.assert_array_equal(N.peek(s, b), want)
        np.testing.assert_array_equal(s(b), want)
        if k in (0, 3, 40):
            numbers = N.freeze(s)
            assert all(isinstance(v, float) for v in numbers)
            s = N.thaw(make(), numbers)
    assert not np.isnan(want).any() and len(want) == len(make().names)


@pytest.mark.parametrize("make", [lambda: smoothers.Kama(4), lambda: smoothers.Jma(5), lambda: smoothers.Holt(4, 0.2), lambda: smoothers.Laguerre(), lambda: smoothers.Hma(6), lambda: smoothers.Pwma(0.9, 0.5, 5), lambda: smoothers.PwmaOutlier(0.9, 0.5, 5), lambda: smoothers.Kalman(0.1, 1.0), lambda: smoothers.McGinley(4)])
def test_smoothers_as_numbers(make):
    x, whole, s = np.random.default_rng(1).normal(50, 5, 60), make(), make()
    for k, v in enumerate(x):
        np.testing.assert_array_equal(whole(v), s(v))
        if k % 7 == 0:
            s = N.thaw(make(), N.freeze(s))


def test_the_open_bar():
    """Every tick changes the open bar's figures; only closed bars stay in the step."""
    rng, ticks = np.random.default_rng(4), []
    live, closed = N.LiveBars(H, N.Atr(3)), []
    for k in range(200):
        us, p = int(k * H // 7 + rng.integers(0, 1000)), float(rng.uniform(10, 20))
        closed += live.tick(us, p)
        ticks.append((us, p))
        step = N.Atr(3)
        for start in sorted({t // H for t, _ in ticks}):
            own = [v for t, v in ticks if t // H == start]
            want = step(N.Bar(start * H, own[0], max(own), min(own), own[-1], len(own)))
        np.testing.assert_allclose(live.open_value(), want, rtol=1e-12)
    assert [b.us for b, _ in closed] == [k * H for k in range(len(closed))] and live.closed(10**18) and live.open_value() is None


def test_a_stream_out_of_order(spark, tmp_path):
    """Rows that come in any order within the watermark's delay give the bars and figures of the ordered rows."""
    rng, t0 = np.random.default_rng(8), datetime(2024, 1, 1)
    rows = sorted((t0 + timedelta(seconds=int(s)), k, "ab"[k % 2], float(v)) for k, (s, v) in enumerate(zip(rng.integers(0, 3 * 86_400, 900), rng.uniform(1, 9, 900), strict=True)))
    late = [r[0] + timedelta(seconds=int(d)) for r, d in zip(rows, rng.integers(0, 500, 900), strict=True)]  # when each arrives
    arrived = [rows[k] for k in np.argsort(np.array(late, dtype="datetime64[us]"), kind="stable")]
    for part in range(6):
        x = pd.DataFrame(arrived[part * 150 : (part + 1) * 150], columns=["ts", "event_id", "event_type", "value"])
        path = tmp_path / f"events{'' if not part else part}.parquet"
        x.assign(ts=x.ts.astype("datetime64[us]")).to_parquet(path, index=False)
        import os

        os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))
    make = lambda: N.Several(N.Atr(4), N.MinMax(3))
    for idle in (None, 40 * H):
        out = flows.drained(flows.live(flows.events(spark, str(tmp_path), files=1), "event_type", "ts", "value", "event_id", H, make, "10 minutes", idle_us=idle)).collect()
        mark = max(r[0] for r in rows) - timedelta(minutes=10)
        want = {}
        for s in "ab":
            live, done = N.LiveBars(H, make()), []
            for ts, _, _, v in [r for r in rows if r[2] == s and r[0] <= mark]:
                done += live.tick((ts - datetime(1970, 1, 1)) // timedelta(microseconds=1), v)
            done += live.closed((mark - datetime(1970, 1, 1)) // timedelta(microseconds=1))
            want |= {(s, datetime(1970, 1, 1) + timedelta(microseconds=b.us)): v for b, v in done}
        got = {(r.event_type, r.ts): tuple(r[n] for n in make().names) for r in out}
        assert set(got) == set(want) and len(out) == len(want)
        for k, v in want.items():
            np.testing.assert_allclose([np.nan if x is None else x for x in got[k]], v)
