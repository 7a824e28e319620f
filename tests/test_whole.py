"""Queries over a small table of events against plain loops over all of its rows."""

import statistics
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

T0 = datetime(2024, 1, 1)
SYMBOLS = ["click", "error", "purchase", "signup", "view"]


def write(folder, rows):
    x = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
    x.assign(ts=x.ts.astype("datetime64[us]"), props="{}").to_parquet(folder / "events.parquet", index=False)


def run(spark, folder, name):
    return [r.asDict() for r in entry.queries()[name](spark, str(folder)).collect()]


@pytest.fixture(scope="module")
def rows():
    """Events of 35 users, so of every class by seven and five, over nine days."""
    rng = np.random.default_rng(5)
    out = []
    for k in range(400):
        at = T0 + timedelta(minutes=32 * k + int(rng.integers(0, 30)), seconds=int(rng.integers(0, 60)))
        out.append((k, at, int(rng.integers(0, 35)), SYMBOLS[int(rng.integers(0, 5))], round(float(rng.uniform(1, 200)), 2)))
    return out


@pytest.fixture(scope="module")
def folder(rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("events")
    write(path, rows)
    return path


# executions: every user with a quantity ----------------------------------------------------------------------------


def executions(rows):
    return [{"seq": i, "ts": ts, "symbol": s, "q": u % 5 - 2, "price": v, "crossed": u % 2 == 0} for i, ts, u, s, v in rows if u % 5 != 2]


def by_symbol(ex):
    out = defaultdict(list)
    for e in ex:
        out[e["symbol"]].append(e)
    return out


def looped_trades(ex):
    out = []
    for s, own in by_symbol(ex).items():
        pos, n, now = 0, 0, None
        for e in own:
            q = e["q"]
            shut = min(abs(pos), abs(q)) * (1 if q > 0 else -1) if pos * q < 0 else 0
            if shut:
                pos += shut
                now["pnl"] -= shut * e["price"]
                if pos == 0:
                    now["exit"] = e["ts"]
            if q - shut:
                if pos == 0:
                    n += 1
                    now = {"symbol": s, "trade": n, "entry": e["ts"], "exit": None, "direction": 1 if q > 0 else -1, "quantity": 0, "pnl": 0.0}
                    out.append(now)
                pos += q - shut
                now["quantity"] += abs(q - shut)
                now["pnl"] -= (q - shut) * e["price"]
    return out


def looped_bars(rows):
    out = {}
    for _, ts, _, s, v in sorted(rows, key=lambda r: r[1]):
        b = out.setdefault((s, ts.replace(minute=0, second=0)), {"high": v, "low": v})
        b |= {"high": max(b["high"], v), "low": min(b["low"], v), "close": v}
    return out


def test_trades_of_all_users(spark, rows, folder):
    want = looped_trades(executions(rows))
    got = {(r["symbol"], r["trade"]): r for r in run(spark, folder, "trades_from_executions")}
    assert len(want) > 20 and set(got) == {(w["symbol"], w["trade"]) for w in want}
    for w in want:
        g = got[w["symbol"], w["trade"]]
        assert [g[c] for c in ("entry", "exit", "direction", "quantity")] == [w[c] for c in ("entry", "exit", "direction", "quantity")]
        assert g["pnl"] == (pytest.approx(w["pnl"], abs=1e-5) if w["exit"] else None)


def test_excursions_of_all_users(spark, rows, folder):
    bars, want = looped_bars(rows), {}
    for w in looped_trades(executions(rows)):
        own = [b for (s, ts), b in bars.items() if w["exit"] and s == w["symbol"] and w["entry"] <= ts <= w["exit"]]
        if own:
            high, low = max(b["high"] for b in own), min(b["low"] for b in own)
            want[w["symbol"], w["trade"]] = (high, low, len(own)) if w["direction"] > 0 else (low, high, len(own))
    got = {(r["symbol"], r["trade"]): (r["favourable"], r["adverse"], r["bars"]) for r in run(spark, folder, "trade_excursions")}
    assert want and got == want


def test_trades_by_hour_of_all_users(spark, rows, folder):
    want = defaultdict(list)
    for w in looped_trades(executions(rows)):
        if w["exit"]:
            want[str(w["entry"].hour)].append(w)
            want["Total"].append(w)
    got = {r["hour"]: r for r in run(spark, folder, "trades_by_hour")}
    assert set(got) == set(want)
    for h, x in want.items():
        assert (got[h]["trades"], got[h]["long"]) == (len(x), sum(w["direction"] > 0 for w in x))
        assert got[h]["pnl"] == pytest.approx(sum(w["pnl"] for w in x), abs=1e-5)
        assert got[h]["median"] == pytest.approx(statistics.median(w["pnl"] for w in x), abs=1e-5)


def test_costs_of_all_users(spark, rows, folder):
    rates = {"click": (0.001, 0.0005), "view": (0.0004, 0.0002), "error": (0.002, 0.002)}
    got = {r["seq"]: r["cost"] for r in run(spark, folder, "execution_costs")}
    ex = executions(rows)
    assert set(got) == {e["seq"] for e in ex}
    for e in ex:
        taker, maker = rates.get(e["symbol"], (None, None))
        amount = abs(e["q"] if e["symbol"] == "view" else e["q"] * e["price"])
        assert got[e["seq"]] == (None if taker is None else pytest.approx(amount * (taker if e["crossed"] else maker), abs=1e-8))


def test_volume_of_all_users(spark, rows, folder):
    want = defaultdict(lambda: [0.0, 0.0])
    for e in executions(rows):
        want[e["symbol"], e["ts"].replace(hour=0, minute=0, second=0)][not e["crossed"]] += abs(e["q"] * e["price"])
    got = {(r["symbol"], r["ts"]): [r["market"], r["limit"]] for r in run(spark, folder, "traded_volume")}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-5)


def test_pnl_of_all_users(spark, rows, folder):
    got = {(r["symbol"], r["ts"]): r for r in run(spark, folder, "pnl_identity")}
    bars, ex = looped_bars(rows), by_symbol(executions(rows))
    assert set(got) == set(bars)
    for (s, ts), b in bars.items():
        own = [e for e in ex[s] if e["ts"] <= ts]
        pos = sum(e["q"] for e in own)
        value = pos * (b["close"] - 0.5 if pos > 0 else b["close"] + 0.5)
        assert got[s, ts]["pos"] == pos and got[s, ts]["value"] == pytest.approx(value, abs=1e-5)
        assert got[s, ts]["pnl"] == pytest.approx(value - sum(e["q"] * e["price"] for e in own) if own else 0, abs=1e-5)


def test_sampled_positions_of_all_users(spark, rows, folder):
    want, weeks = {}, defaultdict(int)
    for s, own in by_symbol(executions(rows)).items():
        pos = 0
        for e in own:
            pos += e["q"]
            want[s, e["ts"].replace(minute=0, second=0)] = pos
            weeks[e["ts"].isocalendar()[:2]] += pos != 0
    assert {(r["symbol"], r["ts"].replace(tzinfo=None)): r["pos"] for r in run(spark, folder, "sampled_log")} == want
    assert len(weeks) == 2 and run(spark, folder, "average_trades") == [{"trades": statistics.mean(weeks.values())}]


def test_inverse_contracts_of_all_users(spark, rows, folder):
    last = {s: v for _, _, _, s, v in rows}
    got = {r["symbol"]: r for r in run(spark, folder, "inverse_contracts")}
    ex = by_symbol(executions(rows))
    assert set(got) == set(ex)
    for s, own in ex.items():
        q = sum(e["q"] for e in own)
        assert got[s]["q"] == q and got[s]["pnl"] == pytest.approx(sum(e["q"] / e["price"] for e in own) - q / last[s], abs=1e-5)


# portfolios of all users -------------------------------------------------------------------------------------------


def test_portfolios_of_all_users(spark, rows, folder):
    parts = defaultdict(list)
    for _, ts, u, s, v in rows:
        parts[s, ts.replace(hour=0, minute=0, second=0), u % 7].append(v)
    want = defaultdict(lambda: [0.0, 0.0, []])
    for (s, ts, _), v in parts.items():
        w = want[s, ts]
        w[0] += len(v)
        w[1] += sum(v)
        w[2].append(max(v))
    got = {(r["symbol"], r["ts"]): r for r in run(spark, folder, "combine_portfolios")}
    assert set(got) == set(want) and sum(r["pos"] for r in got.values()) == len(rows)
    for k, (pos, pnl, prices) in want.items():
        assert [got[k][c] for c in ("pos", "pnl", "price", "value", "commissions")] == pytest.approx([pos, pnl, statistics.mean(prices), pnl, pos * 0.1], abs=1e-5)


# whole series ------------------------------------------------------------------------------------------------------


def looped_forecast(x, dim, keep, steps):
    """Ahead by the lag covariance: the last value is that of the last window's projection."""
    x = list(x)
    for _ in range(steps):
        x.append(x[-1])
        for _ in range(1000):
            windows = np.array([x[k : k + dim] for k in range(len(x) - dim + 1)])
            _, v = np.linalg.eigh(windows.T @ windows)
            v = v[:, ::-1][:, keep]
            before, x[-1] = x[-1], float((v @ (v.T @ windows[-1]))[-1])
            if abs(x[-1] - before) < 1e-8 * max(1.0, abs(x[-1])):
                break
    return x[-steps:]


def test_forecast_sees_the_whole_series(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.round(100 + 30 * np.sin(np.arange(160) / 9) + rng.normal(0, 15, 160) * (np.arange(160) < 60), 2)
    write(tmp_path, [(k, T0 + timedelta(hours=k), k, "click", float(v)) for k, v in enumerate(x)])
    [r] = run(spark, tmp_path, "spectrum_forecast")
    whole = looped_forecast(x, 8, [0, 1], 3)
    assert r["ahead"] == pytest.approx(whole, rel=1e-4)
    assert looped_forecast(x[-100:], 8, [0, 1], 3) != pytest.approx(whole, rel=1e-3)


# an entry at every bar ---------------------------------------------------------------------------------------------


def closes(bars):
    out = defaultdict(list)
    for (s, ts), b in bars.items():
        out[s].append((ts, b))
    return out


def test_barriers_label_every_bar(spark, rows, folder):
    want = {}
    for s, own in closes(looped_bars(rows)).items():
        for entry_, b in own:
            p0, later = b["close"], [(ts, x["close"]) for ts, x in own if entry_ < ts <= entry_ + timedelta(hours=12)]
            if not later:
                continue
            hit = next(((ts, 2 if p >= p0 * 1.5 else -2) for ts, p in later if p >= p0 * 1.5 or p <= p0 * 0.6), None)
            last = later[-1]
            want[s, entry_] = (hit[1], hit[0]) if hit else ((last[1] > p0) - (last[1] < p0), last[0])
    got = {(r["symbol"], r["ts"]): (r["label"], r["hit"]) for r in run(spark, folder, "triple_barrier")}
    assert len(want) > 200 and got == want


def test_range_join_enters_at_every_bar(spark, rows, folder):
    want = {}
    for s, own in closes(looped_bars(rows)).items():
        for k, (entry_, _) in enumerate(own, 1):
            held = [b for ts, b in own if entry_ <= ts <= entry_ + timedelta(hours=9)]
            want[s, k] = (len(held), max(b["high"] for b in held), min(b["low"] for b in held))
    got = {(r["symbol"], r["trade"]): (r["n"], r["best"], r["worst"]) for r in run(spark, folder, "range_join_trades")}
    assert got == want


# all five symbols --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def daily(tmp_path_factory):
    """One event a day and symbol over 30 days, and the closes by day and symbol."""
    path = tmp_path_factory.mktemp("daily")
    x = np.round(np.random.default_rng(8).uniform(50, 150, (30, 5)), 2)
    write(path, [(5 * d + k, T0 + timedelta(days=d, hours=k), k, s, float(x[d, k])) for d in range(30) for k, s in enumerate(SYMBOLS)])
    return path, x


@pytest.mark.parametrize("name", ["weights_tangency", "weights_least_variance"])
def test_weights_of_all_symbols(spark, daily, name):
    r = np.diff(daily[1], axis=0) / daily[1][:-1]
    want = {}
    for fold in range(3):
        own = r[5 * fold : 5 * fold + 15]
        w = np.linalg.solve(np.cov(own.T), own.mean(axis=0) - 0.01 if name == "weights_tangency" else np.ones(5))
        want |= {(fold, s): v for s, v in zip(SYMBOLS, w / w.sum(), strict=True)}
    got = {(x["fold"], x["symbol"]): x["weight"] for x in run(spark, daily[0], name)}
    assert set(got) >= set(want) and {s for _, s in got} == set(SYMBOLS)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6)


def test_cointegration_of_all_symbols(spark, daily):
    from tideline.operators import stats

    want = stats.johansen(daily[1], 2)
    [got] = run(spark, daily[0], "johansen")
    for c in ("eigenvalues", "trace", "largest"):
        assert len(got[c]) == 5 and got[c] == pytest.approx(want[c].tolist(), rel=1e-6)


# excursions beside the ends of a source ----------------------------------------------------------------------------


def test_excursions_beside_the_ends(spark):
    from tideline.operators import spikes

    n = 120
    x = 100 * np.exp(np.random.default_rng(4).normal(0, 1e-3, (2, n)))
    x[0, 1:5] *= 1.08
    x[0, n - 5 : n - 1] *= 0.92
    x[1, [0, 5, n - 6, n - 1]] *= 1.08  # the four readings between are right
    for cuts in ([], [1, 2, 6, n - 4]):
        stretch = np.searchsorted(cuts, np.arange(n), side="right") if cuts else np.zeros(n, int)
        data = [(0, f"s{k}", int(stretch[i]), 1000 * i, 1000 * k + i, float(x[k, i])) for k in range(2) for i in range(n)]
        df = spark.createDataFrame(data, "tab int, symbol string, stretch long, t long, id long, x double")
        got = {r.rec_id for r in spikes.implausible(df).filter("flag = 'jump'").collect()}
        assert got == {1, 2, 3, 4, n - 5, n - 4, n - 3, n - 2, 1005, 1000 + n - 6}, cuts[:3]


# as-of joins over a crowded day ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """3,000 events of one symbol in one day and one four days later; many lie at the time of one of the other side."""
    path, rng = tmp_path_factory.mktemp("crowded"), np.random.default_rng(9)
    at = [np.sort(rng.choice(80_000, 1500, replace=False)), np.sort(rng.choice(80_000, 1500, replace=False))]
    at[1][::3] = at[0][::3]
    at[1] = np.append(np.unique(at[1]), 5 * 86_400)
    write(path, [(10_000 * odd + k, T0 + timedelta(seconds=int(s)), odd, "view", float(k)) for odd in (0, 1) for k, s in enumerate(at[odd])])
    return path, at


@pytest.mark.parametrize("name, side", [("asof_forward", "left"), ("asof_forward_strict", "right")])
def test_asof_forward_reads_a_day_once(spark, crowded, name, side):
    folder, (left, right) = crowded
    want = dict(enumerate(np.searchsorted(right, left, side=side).tolist()))
    got = {r["event_id"]: (r["value"], r["right_ts"]) for r in run(spark, folder, name)}
    assert got == {k: (float(j), T0 + timedelta(seconds=int(right[j]))) for k, j in want.items()}
    # a frame to the end of the shard is read anew for each of its rows
    assert "unboundedfollowing" not in entry.queries()[name](spark, str(folder))._jdf.queryExecution().executedPlan().toString().lower()
