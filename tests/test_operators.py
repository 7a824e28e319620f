"""Values worked out by hand, by a formula or by a second implementation for the operators over bars and positions.

Where a comment says so, values are fixed: published or established results that have to come out.
"""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.frames import by_symbol
from tideline.operators import indicators, joins, portfolio, resample, rolling, segments, signals, simulate, smoothers, stats

T0 = datetime(2020, 1, 1)
nan = float("nan")


def series(spark, values, name="x", symbol="s", step=3600):
    rows = [(symbol, T0 + timedelta(seconds=step * k), float(v) if v is not None else None) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, f"symbol string, ts timestamp_ntz, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


# smoothers ---------------------------------------------------------------------------------------------------------


def test_ema_dema_tema():
    # fixed values
    x = [1, 5, 10, 4, 3]
    np.testing.assert_allclose(smoothers.smoothed(x, "ema", 3), [nan, nan, 5.33333333, 4.66666667, 3.83333333])
    np.testing.assert_allclose(smoothers.smoothed(x, lambda: smoothers.Ema(3, seeded=False, least=3)), [nan, nan, 6.5, 5.25, 4.125])
    np.testing.assert_allclose(smoothers.smoothed([nan, nan, *x], "ema", 3)[-3:], [5.33333333, 4.66666667, 3.83333333])
    y = [1.0, 5, 10, 4, 3, 4, 5, 11, 10, 8, 8, 18, 21, 1, 5]
    np.testing.assert_allclose(smoothers.smoothed(y, "dema", 3)[4:], [3.05555556, 3.56944444, 4.55555556, 9.41319444, 10.27430556, 8.92100694, 8.35243056, 15.62217882, 20.28407118, 6.62852648, 4.80750868], rtol=1e-6)
    np.testing.assert_allclose(smoothers.smoothed(y, "tema", 3)[6:], [4.7037037, 10.2806713, 10.5708912, 8.6087963, 8.02010995, 16.64492911, 21.15341073, 4.24893302, 3.71395761], rtol=1e-6)


def test_kama():
    # fixed values
    up_down = [1.0, 2, 3, 4, 5, 6, 7, 8, 9, 8, 7, 6, 5, 4, 3, 2, 1]
    want = [5.44444444, 6.13580247, 6.96433471, 7.86907484, 7.89281303, 7.86227426, 7.79857496, 7.29116216, 5.82842342, 4.57134635, 3.42852575, 2.34918097]
    got = smoothers.smoothed(up_down, lambda: smoothers.Kama(5, 2, 30))
    assert np.isnan(got[:5]).all()
    np.testing.assert_allclose(got[5:], want, rtol=1e-6)


def test_kalman_regression_joint():
    """The textbook update against least squares with a prior, without process noise."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 2)) + 3
    y = x @ [1.5, -0.5] + rng.normal(0, 0.1, 30)
    step = smoothers.KalmanRegression([0.0, 0.0], 0.0, joint=True)
    step.p = np.eye(2) * 4.0
    for row, v in zip(x, y, strict=True):
        step.observe(row, v, 0.5)
    np.testing.assert_allclose(step.b, np.linalg.solve(x.T @ x / 0.5 + np.eye(2) / 4.0, x.T @ y / 0.5), rtol=1e-8)


def test_kalman_regression():
    # fixed values: the error variances and coefficients
    x = np.arange(1.0, 6)
    b, e, q = smoothers.kalman_regression(x, x, 1, 1)
    np.testing.assert_allclose(b, [[1, 0]] * 5, atol=1e-9)
    np.testing.assert_allclose(q, [1.0, 10.0, 24.6, 40.31504065, 57.2563352], rtol=1e-6)
    b, _, _ = smoothers.kalman_regression(np.array([[2, 2], [3, 3], [4, 4], [5, 5]]), np.array([2.0, 3, 4, 5]), 1, 1, intercept=False)
    np.testing.assert_allclose(b[:, 0], [1.0, 0.51351351, 0.50013808, 0.50000078], rtol=1e-6)


@pytest.mark.parametrize("step", [lambda: smoothers.Ema(4), lambda: smoothers.Kama(4), lambda: smoothers.Jma(5), lambda: smoothers.Holt(4, 0.2), lambda: smoothers.Laguerre(), lambda: smoothers.Hma(6), lambda: smoothers.Tema(3), lambda: smoothers.Zlema(3), lambda: smoothers.Pwma(0.9, 0.5, 5)])
def test_a_step_goes_on_from_its_state(step):
    import pickle

    x = np.random.default_rng(1).normal(50, 5, 60)
    whole, s, out = smoothers.smoothed(x, step), step(), []
    for part in (x[:7], x[7:8], x[8:40], x[40:]):
        out += [s(v) for v in part]
        s = pickle.loads(pickle.dumps(s))
    np.testing.assert_array_equal(whole, out)


# frames ------------------------------------------------------------------------------------------------------------


def test_denoised_trend(spark):
    def bars(d):
        o = np.arange(10.0, 17)
        return series(spark, o, "open").join(series(spark, o + d, "close"), ["symbol", "ts"])

    assert column(indicators.with_denoised_trend(bars(0.5), 6), "trend")[-1] == pytest.approx(6.5)
    assert column(indicators.with_denoised_trend(bars(0.5), 6, of_bars=False), "trend")[-1] == pytest.approx(6.0)
    assert column(indicators.with_denoised_trend(bars(1.5), 6), "trend")[-1] < 7.5


def test_streaks_and_periods(spark):
    x = series(spark, [1, 2, 3, 3, 2, 1, 0, 5])
    assert column(rolling.streaks(x, ["symbol"], ["ts"], "x"), "streak") == [0, 1, 2, 0, -1, -2, -3, 1]
    p = rolling.periods(x, ["symbol"], "ts", F.col("x") >= 2).orderBy("start").collect()
    assert [r.rows for r in p] == [4, 1]


def test_null_and_rank_frames(spark):
    x = series(spark, [1, None, 3, 4, 2])
    assert column(x.withColumn("m", rolling.sma(F.col("x"), by_symbol(), 2)), "m") == [None, None, None, 3.5, 3.0]
    assert column(x.withColumn("s", rolling.rolling_sum(F.col("x"), by_symbol(), 2)), "s") == [None, 1.0, 3.0, 7.0, 6.0]
    assert column(x.withColumn("p", rolling.percent_rank(F.col("x"), by_symbol(), 3)), "p")[-1] == 0.0


def test_halflife(spark):
    assert column(indicators.halflife(series(spark, [1, 0, 2, 3, 2, 1, -1, -2, 0, 1]), "x").withColumn("ts", F.lit(1)), "halflife") == [2]


def test_asof_over_shards_and_ties(spark):
    rng = np.random.default_rng(4)
    left = [("k", T0 + timedelta(hours=int(h)), int(i)) for i, h in enumerate(rng.integers(0, 400, 60))] + [("k", None, 99), (None, T0, 98)]
    right = [("k", T0 + timedelta(hours=int(h)), float(i), int(i)) for i, h in enumerate(rng.integers(50, 300, 40))]
    L, R = spark.createDataFrame(left, "k string, ts timestamp_ntz, _t int"), spark.createDataFrame(right, "k string, ts timestamp_ntz, v double, seq int")
    for direction, strict in (("backward", False), ("backward", True), ("forward", False), ("forward", True)):
        got = {r["_t"]: r.v for r in joins.asof_join(L, R, ["k"], "ts", ["v"], direction, strict, seq="seq").collect()}
        for k, ts, i in left:
            if direction == "backward":
                near = [(u, s, v) for _, u, v, s in right if k and ts and (u < ts or u == ts and not strict)]
                want = max(near)[2] if near else None
            else:
                near = [(u, s, v) for _, u, v, s in right if k and ts and (u > ts or u == ts and not strict)]
                want = min(near)[2] if near else None
            assert got[i] == want
    assert joins.asof_join(L.limit(0), R, ["k"], "ts", ["v"]).count() == 0
    assert joins.asof_join(L, R.limit(0), ["k"], "ts", ["v"]).filter("v is null").count() == len(left)


def test_resampling_composes(spark):
    x = series(spark, np.random.default_rng(5).normal(size=500), "v", step=700).withColumn("seq", F.monotonically_increasing_id())
    once = resample.bars(x, "symbol", "ts", F.col("v"), "4 hours", "seq")
    twice = resample.rebar(resample.bars(x, "symbol", "ts", F.col("v"), "1 hour", "seq"), "4 hours")
    a, b = (d.select("ts", "open", "high", "low", "close", "volume").orderBy("ts").collect() for d in (once, twice))
    assert a == b


# portfolio ---------------------------------------------------------------------------------------------------------

# fixed values: the returns and their figures
RETURNS = [None, 0.01, 0.10, -0.04, 0.02, 0.03, 0.02, 0.01, -0.10]


def test_figures_of_returns(spark):
    r = F.col("x")
    f = series(spark, RETURNS).agg(portfolio.cagr(r).alias("cagr"), portfolio.sharpe(r).alias("sharpe"), portfolio.sortino(r).alias("sortino")).first()
    assert f.cagr == pytest.approx(1.913593, abs=1e-3)
    assert f.sharpe == pytest.approx(1.7238613961706866) and f.sortino == pytest.approx(2.605531251673693)
    up = series(spark, [None, 0.01, 0.1]).agg(portfolio.sortino(r).alias("s")).first().s
    assert up == math.inf
    assert series(spark, [0, 0, 0]).agg(portfolio.sortino(r).alias("s"), portfolio.sharpe(r).alias("h")).first()[:] == (None, None)


def test_compounding(spark):
    x = series(spark, [0.0, 0.01] * 4 + [0.0], "r", step=86_400).withColumn("ts", F.col("ts") + F.expr("interval 29 days"))
    assert [round(r.ret, 8) for r in resample.compound(x, "year").collect()] == [0.04060401]
    assert [round(r.ret, 6) for r in resample.compound(x, "month").orderBy("period").collect()] == [0.01, 0.030301]


@pytest.mark.parametrize(("x", "mdd", "start", "peak", "end"), [([1, 2, 3, 1], 2, 2, 3, 3), ([1, 2, 3, 1, 8, 11], 2, 2, 3, 4), ([1, 2, 3, 4], 0, 0, 0, 0), ([10, 9, 5, 4], 6, 0, 3, 3)])
def test_max_drawdown(spark, x, mdd, start, peak, end):
    r = portfolio.max_drawdown(series(spark, x), "x").first()
    at = lambda k: T0 + timedelta(hours=k)
    assert (r.mdd, r.start, r.peak, r.recovered) == (mdd, at(start), at(peak), at(end))


def _book(steps, half=0.0):
    b, out = simulate.Book(), []
    for q, p in steps:
        t = simulate.Tick(0, p - half, p + half, True, {})
        b.trade(t, q)
        out.append(b.pnl(t.bid, t.ask))
    return out


def test_positions():
    """By hand: 3 bought at 20, turned to 2 sold at 25, closed at 22; then with a half spread of 1."""
    steps = [(3, 20.0), (-2, 25.0), (0, 22.0), (0, 30.0)]
    assert _book(steps) == [0, 15, 21, 21]
    assert _book(steps, 1.0) == [-6, 5, 11, 11]


def test_positions_equal_the_cash_flow():
    rng = np.random.default_rng(21)
    steps = [(float(q), float(p)) for q, p in zip(rng.integers(-6, 7, 80), rng.uniform(10, 90, 80), strict=True)]
    for half in (0.0, 0.5):
        cash, pos, want = 0.0, 0.0, []
        for q, p in steps:
            cash -= (q - pos) * (p + half * np.sign(q - pos))
            pos = q
            want.append(cash + pos * (p - half * np.sign(pos)))
        np.testing.assert_allclose(_book(steps, half), want, atol=1e-9)


def test_linear_pnl_equals_the_book(spark):
    rng = np.random.default_rng(8)
    for seed in range(3):
        pos, p = np.round(rng.integers(-5, 6, 60)).astype(float), np.round(50 + np.cumsum(rng.normal(size=60)), 2)
        half, steps = 0.25, []
        b = simulate.Book()
        for k in range(60):
            t = simulate.Tick(k, p[k] - half, p[k] + half, True, {})
            b.trade(t, pos[k])
            steps.append(b.pnl(t.bid, t.ask))
        dq = np.diff(pos, prepend=0)
        rows = [("s", T0 + timedelta(hours=k), dq[k], p[k] + half * np.sign(dq[k]), p[k] - half, p[k] + half) for k in range(60)]
        df = spark.createDataFrame([tuple(map(lambda v: float(v) if isinstance(v, np.floating) else v, r)) for r in rows], "symbol string, ts timestamp_ntz, quantity double, price double, bid double, ask double")
        got = column(portfolio.linear_pnl(df, df.select("symbol", "ts", "bid", "ask")), "pnl")
        np.testing.assert_allclose(got, steps, atol=1e-9)


def test_trades_turn_and_stay_open(spark):
    rows = [("s", T0 + timedelta(hours=k), q, p) for k, (q, p) in enumerate([(2.0, 10.0), (-3.0, 12.0), (1.0, 11.0), (4.0, 20.0)])]
    t = portfolio.trades(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, quantity double, price double")).orderBy("trade").collect()
    assert [(r.direction, r.quantity, r.pnl) for r in t] == [(1, 2.0, 4.0), (-1, 1.0, 1.0), (1, 4.0, None)]


def test_trades_of_one_time_keep_their_pnl(spark):
    made = lambda rows: [(r.direction, r.quantity, r.pnl) for r in portfolio.trades(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq int, quantity double, price double")).orderBy("trade").collect()]
    assert made([("s", T0, 2, -5.0, 12.0), ("s", T0, 1, 5.0, 10.0)]) == [(1, 5.0, 10.0)]
    assert made([("s", T0, 1, 2.0, 10.0), ("s", T0, 2, -2.0, 11.0), ("s", T0, 3, 2.0, 12.0), ("s", T0, 4, None, 1.0), ("s", T0, 5, 3.0, None)]) == [(1, 2.0, 2.0), (1, 2.0, None)]
    assert made([]) == []


def test_a_total_loss_is_for_good(spark):
    x = series(spark, [0.1, -1.0, 0.5, None], "r")
    assert portfolio.max_drawdown_pct(x).first().mdd_pct == -1.0
    g = portfolio.growth(series(spark, [1.0, 1.0, -12.0, 3.0], "pnl"), 10.0)
    assert column(g, "growth") == [pytest.approx(1 + 1 / 11), 0.0]  # no equity, no return


# simulator ---------------------------------------------------------------------------------------------------------

BARS = [(50, 58, 47, 55), (56, 61, 52, 60), (59, 60, 41, 44), (35, 37, 28, 31), (26, 29, 25, 27)]


def _ticks(by_colour=False):
    out = []
    for k, (o, h, l, c) in enumerate(BARS):
        two = (h, l) if by_colour and c < o else (l, h)
        out += [(300 * k + d, p, r) for d, p, r in zip((0, 120, 180, 240), (o, *two, c), (True, False, False, True), strict=True)]
    return out


def _run(tracker, sigs, levels=()):
    rows = [(int(s * 1e6), 1, p, p, r, nan, None) for s, p, r in _ticks()] + [(int(s * 1e6), 0, nan, nan, False, t, None) for s, t in sigs]
    p = pd.DataFrame(sorted(rows, key=lambda r: r[:2]), columns=["_us", "_kind", "bid", "ask", "real", "target", "info"])
    return [(q, price, why) for _, price, q, _, why, _ in simulate.fold(p, tracker, 0.0, levels)]


def test_ticks_of_bars(spark):
    b = spark.createDataFrame([("s", T0 + timedelta(seconds=300 * k), *map(float, x)) for k, x in enumerate(BARS)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double")
    for colour in (False, True):
        assert column(simulate.bar_ticks(b, 300, by_colour=colour), "bid") == [float(p) for _, p, _ in _ticks(colour)]


def test_take_goes_before_stop_and_fills_at_its_price():
    assert _run(simulate.TakeStop(size=10, take_points=8), [(1, 1.0), (1320, 0.0)]) == [(10, 50, "signal"), (0, 58, "take")]
    assert _run(simulate.TakeStop(size=10, stop_points=2.5), [(1, 1.0)]) == [(10, 50, "signal"), (0, 47, "stop")]
    assert _run(simulate.TakeStop(size=10, stop_points=2.5, exact=True), [(1, 1.0)]) == [(10, 50, "signal"), (0, 47.5, "stop")]
    assert _run(simulate.TakeStop(size=10, take_points=20), [(1, -1.0)]) == [(-10, 50, "signal"), (0, 30, "take")]


def test_a_signal_takes_the_tick_before_it():
    assert _run(simulate.Tracker(), [(240, 1.0), (300, nan), (301, 1.0), (540, -1.0)]) == [(1, 50, "signal"), (-1, 56, "signal")]
    assert _run(simulate.Tracker(), [(0, 1.0)]) == []


def test_partial_takes():
    got = _run(simulate.PartialTakes(size=9, ladder=((3, 1 / 3), (5, 1 / 2), (8, 1.0))), [(1, 1.0)])
    assert got == [(9, 50, "signal"), (6, 53, "part take"), (3, 55, "part take"), (0, 58, "take")]


def test_pending_orders():
    stop = simulate.Triggered(size=10, entry=4, stop_points=20, ladder=((6, 1.0),))
    assert _run(stop, [(1, 1.0)]) == [(10, 54, "stop order"), (0, 60, "take")]
    limit = simulate.Triggered(size=10, entry=2, kind="limit", stop_points=40, ladder=((12, 1.0),))
    assert _run(limit, [(1, 1.0)]) == [(10, 48, "limit order"), (0, 60, "take")]
    assert _run(stop, [(1, 1.0), (60, 0.0)]) == []


def test_expiration_dispatch_and_pipeline():
    assert _run(simulate.Expiring(after_us=500_000_000, size=5), [(1, 1.0)]) == [(5, 50, "signal"), (0, 60, "expired")]
    both = simulate.Pipeline(parts=(simulate.TakeStop(size=3, take_points=4.5), simulate.Expiring(after_us=10**12)))
    assert _run(both, [(1, 1.0)]) == [(3, 50, "signal"), (0, 54.5, "take")]


# statistics --------------------------------------------------------------------------------------------------------


def test_warping():
    # fixed values: the distances and bounds of these three curves
    x = np.linspace(0, 50, 100)
    a, b, c = 3.1 * np.sin(x / 1.5) + 3.5, 2.2 * np.sin(x / 3.5 + 2.4) + 3.2, 0.04 * x + 3.0
    assert stats.warp_distance(a, b) == pytest.approx(17.9297184686) and stats.warp_distance(a, c) == pytest.approx(21.5494948244)
    assert stats.warp_distance(a, b, 10) == pytest.approx(18.5965518384) and stats.warp_distance(a, c, 10) == pytest.approx(22.4724828468)
    assert stats.keogh_bound(a, b, 20) == pytest.approx(6.25389235159) and stats.keogh_bound(a, c, 20) == pytest.approx(19.9595478694)
    assert stats.nearest_series([("b", b), ("c", c)], a, 10) == "b"


def test_allocation():
    """Against what defines the weights: no nearby ones have more return per risk, or less variance at the same mean."""
    rng = np.random.default_rng(9)
    x = rng.normal(0.05, 1.0, (40, 4)) @ rng.normal(size=(4, 4)) + [0.3, 0.2, 0.4, 0.1]
    mean, cov = x.mean(axis=0), np.cov(x.T)
    w = stats.tangency(x, 0.01)
    ratio = lambda v: (v @ mean - 0.01 * v.sum()) / math.sqrt(v @ cov @ v)
    assert w.sum() == pytest.approx(1) and all(abs(ratio(w)) >= abs(ratio(w + 1e-3 * rng.normal(size=4))) - 1e-9 for _ in range(200))
    for target in (None, 0.0, 0.7):
        v = stats.least_variance(x, target)
        fixed = np.stack([np.ones(4)] + ([mean] if target is not None else []))
        np.testing.assert_allclose(fixed @ v, [1.0] + ([target] if target is not None else []), atol=1e-9)
        free = np.eye(4) - np.linalg.pinv(fixed) @ fixed
        assert all(v @ cov @ v <= (u := v + free @ rng.normal(size=4)) @ cov @ u + 1e-9 for _ in range(200))
    np.testing.assert_allclose(stats.simplex([0.8, 0.6, -0.3]), [0.6, 0.4, 0])
    # two assets, by hand: mean prices 32/3 and 28/3 to the last ones 12 and 8, and the step that earns 1.05
    prices, before = np.array([[10.0, 10, 12], [10, 10, 8]]), np.array([0.5, 0.5])
    ahead = np.array([32 / 36, 28 / 24])
    d = ahead - ahead.mean()
    want = before + (1.05 - before @ ahead) / (d @ d) * d
    np.testing.assert_allclose(stats.reversion_step(prices, before, 1.05), want)
    np.testing.assert_allclose(stats.reversion_step(prices, before, 1.05, np.ones((2, 3)) * [[1], [7]]), want)
    np.testing.assert_allclose(want @ ahead, 1.05)


def test_spectrum_rebuilds_and_continues():
    x = np.sin(np.linspace(0, 20, 200)) + 2
    pc, s, v = stats.spectrum(x, 20)
    np.testing.assert_allclose(stats.rebuild(pc, v, range(20)), x, atol=1e-9)
    ahead = stats.forecast(x, 20, [0, 1, 2], 3)
    np.testing.assert_allclose(ahead[-3:], np.sin(20 + np.arange(1, 4) * 20 / 199) + 2, atol=0.1)


def test_johansen_finds_one_relation():
    rng = np.random.default_rng(12)
    walk = np.cumsum(rng.normal(size=(600, 2)), axis=0)
    x = np.column_stack([walk, walk @ [0.5, -1.0] + rng.normal(size=600)])
    j = stats.johansen(x, 2)
    assert j["trace"][0] > j["trace_critical"][0, 2] and j["trace"][1] < j["trace_critical"][1, 2]
    w = j["vectors"][:, 0] / j["vectors"][2, 0]
    np.testing.assert_allclose(w, [-0.5, 1.0, 1.0], atol=0.1)


def test_hurst_of_a_walk_and_unit_root():
    rng = np.random.default_rng(2)
    walk = np.cumsum(rng.normal(size=2000))
    assert stats.hurst_rescaled(np.diff(walk))[0] == pytest.approx(0.5, abs=0.12)
    assert stats.dickey_fuller(walk)[0] > stats.dickey_fuller(walk)[1] and stats.dickey_fuller(np.diff(walk))[0] < -10


# segments and signals ----------------------------------------------------------------------------------------------


def test_turning_points():
    assert segments.turning_points(np.array([1, 2, 5, 3, 1, 4, 6, 2.0]), 2.5).tolist() == [0, 2, 4, 6, 7]
    assert segments.turning_points(np.array([]), 1).tolist() == [] and segments.turning_points(np.array([3.0, 3, 3]), 1).tolist() == []


def test_band_positions():
    z = np.array([0, 3, 1, 0.1, -3, -1, 0.5, nan, 3, 0])
    given = lambda **k: [v for v in segments.band_positions(z, 2, 0, **k) if v == v]
    assert given() == [-1, 0, 1, 0, -1] and given(back=False) == [-1, 1, 0, -1, 0]


def test_signal_algebra(spark):
    s = lambda rows, c="target double": spark.createDataFrame([("s", T0 + timedelta(hours=k), v) for k, v in rows], f"symbol string, ts timestamp_ntz, {c}")
    a, b, clock = s([(1, 1.0), (5, -1.0)]), s([(2, 1.0), (4, 1.0), (6, 1.0), (7, -1.0)]), s([(k, 0.0) for k in range(9)])
    at = lambda df: [((r.ts - T0).seconds // 3600, r.target) for r in df.orderBy("ts").collect()]
    assert at(signals.imply(a, b, clock)) == [(2, 1.0), (4, 1.0), (7, -1.0)]
    assert at(signals.imply(a, b, clock, memory=1)) == [(2, 1.0)]
    on = s([(0, True), (4, False), (6, True)], "on boolean")
    assert at(signals.where_on(b, on)) == [(2, 1.0), (6, 1.0), (7, -1.0)]
    assert at(signals.both(a, s([(1, -1.0), (2, 1.0)]))) == [(1, -1.0), (2, 1.0), (5, -1.0)]


# shards of time ----------------------------------------------------------------------------------------------------


def test_rows_before_and_numbers_over_shards(spark):
    rng = np.random.default_rng(17)
    rows = [(s, T0 + timedelta(minutes=int(m)), k, float(k % 7)) for k, (s, m) in enumerate(zip(rng.choice(["a", "b", ""], 300).tolist(), rng.integers(0, 9000, 300), strict=True))]
    rows = [(s or None, t, k, v) for s, t, k, v in rows] + [("a", None, 900, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq int, v double").withColumn("_n", F.lit(1))
    want, number = {}, {}
    for s in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or T0, r[2]))
        for i, r in enumerate(own):
            want[r[2]], number[r[2]] = own[i - 1][3] if i else None, i + 1
    for shard in (3_600_000_000, 86_400_000_000, 10**15):
        got = rolling.with_previous(df, ["symbol"], ["ts", "seq"], ["v"], shard).collect()
        assert {r.seq: r["_prev"].v if r["_prev"] else None for r in got} == want and len(got) == len(rows)
        assert {r.seq: r["_i"] for r in rolling.with_index(df, ["symbol"], ["ts", "seq"], shard_us=shard).collect()} == number
    assert rolling.with_previous(df.limit(0), ["symbol"], ["ts"], ["v"]).count() == 0


def test_gaps_over_stretches(spark):
    x = series(spark, [5, None, 7, 8], "close", step=3600 * 50).withColumns({c: F.col("close") for c in ("open", "high", "low")})
    for stretch in (1, 7, 1024):
        got = column(resample.fill_gaps(x, "1 hour", stretch=stretch), "close")
        assert got == [5.0] * 100 + [7.0] * 50 + [8.0]
    assert column(resample.fill_gaps(x, "1 hour", method="null", stretch=7), "close")[49:52] == [None] * 3
    assert resample.fill_gaps(x.limit(0), "1 hour").count() == 0


def test_nearest_of_all_series(spark):
    rng = np.random.default_rng(5)
    x = {f"s{k}": np.cumsum(rng.normal(size=12)).round(3) for k in range(14)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()] + [(None, [1.0]), ("gone", None)], "symbol string, v array<double>")
    want = {k: min((stats.warp_distance(v, y, 4), s) for s, y in x.items() if s != k)[1] for k, v in x.items()}
    for blocks in (1, 3):
        assert {r.symbol: r.nearest for r in stats.nearest_of_all(df, 4, blocks=blocks).collect()} == want


def test_a_shared_folder_or_an_error():
    from tideline import session

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session._temporary(master)
    assert session._temporary("local[4]").startswith("file://") and session._temporary("local")


def test_costs_by_level(spark):
    rates = spark.createDataFrame([("c", "a", 0.0, 0.01, 0.0, False), ("c", "b", 100.0, 0.005, 0.0, False), ("q", "x", None, 1.0, 2.0, True)], "calculator string, level string, least_volume double, taker double, maker double, of_quantity boolean")
    day = lambda d: T0 + timedelta(days=d)
    ex = spark.createDataFrame([(1, day(0), 10.0, 10.0, True), (2, day(1), -2.0, 50.0, True), (3, day(3), 1.0, 10.0, True), (4, day(1), 1.0, 1.0, False), (5, None, 1.0, 1.0, True), (6, day(1), None, 1.0, True)], "seq int, ts timestamp_ntz, quantity double, price double, crossed boolean")
    of = lambda *a, **k: {r.seq: r.cost for r in portfolio.tiered_costs(ex, rates, *a, **k).collect()}
    assert of("c", period="day") == {1: 1.0, 2: 0.5, 3: 0.1, 4: 0.0, 5: None, 6: None}
    assert of("c", "b", period="day")[1] == 0.5 and of("q")[2] == 2.0 and of("q")[4] == 2.0
    with pytest.raises(ValueError, match="no rates"):
        of("nobody")
    assert portfolio.tiered_costs(ex.limit(0), rates, "c").count() == 0
