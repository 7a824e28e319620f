"""Edge cases of the operators p1 to p5 against brute force on small tables."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import grid, nearest, rolling_tiles, spikes, timestamps

FEEDS = "feed string, zone string, day_order string"


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame([("us", "America/New_York", "mdy"), ("uk", "Europe/London", "dmy"), ("none", None, "ymd"), ("jp", "Asia/Tokyo", "ymd")], FEEDS)


def micros(*a):
    return (datetime(*a) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


CASES = [
    ("us", "2021-06-01 12:00:00", None, micros(2021, 6, 1, 16)),
    ("us", "01/02/2021 3:04:05 PM", None, micros(2021, 1, 2, 20, 4, 5)),
    ("us", "12/31/2021 12:00:00 AM", None, micros(2021, 12, 31, 5)),
    ("uk", "01/02/2021 03:04:05", None, micros(2021, 2, 1, 3, 4, 5)),
    ("uk", "01/02/2021 03:04:05", "Asia/Tokyo", micros(2021, 1, 31, 18, 4, 5)),
    ("uk", "01/02/2021 03:04:05", "Nowhere/City", micros(2021, 2, 1, 3, 4, 5)),
    ("uk", "2021-03-28 01:30:00", None, None),  # skipped
    ("uk", "2021-10-31 01:30:00", None, micros(2021, 10, 31, 0, 30)),  # twice: the earlier
    ("uk", "2021-10-31 01:30:00 GMT", None, micros(2021, 10, 31, 1, 30)),
    ("us", "2021-11-07 01:30:00 EST", None, micros(2021, 11, 7, 6, 30)),
    ("us", "2021-11-07 01:30:00 EDT", None, micros(2021, 11, 7, 5, 30)),
    ("us", "2021-11-07 01:30:00", None, micros(2021, 11, 7, 5, 30)),
    ("jp", "20210102T030405.678+0900", None, micros(2021, 1, 1, 18, 4, 5, 678000)),
    ("none", "2021.01.02D03:04:05.123456789", None, micros(2021, 1, 2, 3, 4, 5, 123456)),
    ("none", "20210102-03:04:05.5", None, micros(2021, 1, 2, 3, 4, 5, 500000)),
    ("none", ' \t"2021-01-02T03:04:05.25Z" ', None, micros(2021, 1, 2, 3, 4, 5, 250000)),
    ("none", "Sat, 02 Jan 2021 03:04:05 -0500", None, micros(2021, 1, 2, 8, 4, 5)),
    ("none", "2-Jan-21 03:04:05", None, micros(2021, 1, 2, 3, 4, 5)),
    ("none", "2021-01-02 03:04", None, micros(2021, 1, 2, 3, 4)),
    ("none", "2021-01-02 03:04:05,007", None, micros(2021, 1, 2, 3, 4, 5, 7000)),
    ("none", "1609556645", None, micros(2021, 1, 2, 3, 4, 5)),
    ("none", "1609556645123456789", None, micros(2021, 1, 2, 3, 4, 5, 123456)),
    ("missing", "2021-01-02 03:04:05", None, micros(2021, 1, 2, 3, 4, 5)),
    ("missing", "01/02/2021 03:04:05", None, None),
    ("us", "13/02/2021 03:04:05", None, None),
    ("none", "2021-02-30 00:00:00", None, None),
    ("none", "2021-01-02 25:00:00", None, None),
    ("none", "2021-01-02 13:00:00 PM", None, None),
    ("none", "2021-01-02 03:04:05 XYZ", None, None),
    ("none", "0000-00-00 00:00:00", None, None),
    ("none", "", None, None),
    ("none", None, None, None),
    ("none", "-", None, None),
    (None, "2021-01-02 03:04:05", None, micros(2021, 1, 2, 3, 4, 5)),
    ("none", "x" * 100_000, None, None),
]


def test_timestamps(spark, feeds):
    rows = [(k, f, t, z, "kept", "clash") for k, (f, t, z, _) in enumerate(CASES)]
    raw = spark.createDataFrame(rows + rows[:3], "rec_id long, feed string, time string, tz string, _t string, utc_us string")
    got = {r.rec_id: r for r in timestamps.normalise_quotes(raw, feeds).collect()}
    assert len(got) == len(CASES)
    for k, (f, t, z, want) in enumerate(CASES):
        assert got[k].utc_us == want, (f, (t or "")[:40], z)
    assert all(r["_t"] == "kept" for r in got.values())


def test_days(spark, feeds):
    cases = [("us", "3/4/2021", (2021, 3, 4)), ("uk", "3/4/2021", (2021, 4, 3)), ("none", "20210304", (2021, 3, 4)), ("none", "2021-03-04T00:00:00", (2021, 3, 4)), ("none", "04 MAR 2021", (2021, 3, 4)), ("none", "Mar 4, 2021", (2021, 3, 4)), ("none", "4-Mar-21", (2021, 3, 4)), ("none", "31-Feb-15", None), ("none", "2016-00-10", None), ("none", "total", None), ("none", None, None)]
    bars = spark.createDataFrame([(k, f, d, 1.0) for k, (f, d, _) in enumerate(cases)], "bar_id long, feed string, date string, close double")
    got = {r.bar_id: r.utc_us for r in timestamps.normalise_bars(bars, feeds).collect()}
    assert [got[k] for k in range(len(cases))] == [micros(*c[2]) if c[2] else None for c in cases]
    raw = spark.createDataFrame([], "rec_id long, feed string, time string, tz string")
    assert timestamps.found(raw, bars, feeds).count() == 7
    assert timestamps.found(raw, bars.limit(0), feeds.limit(0)).count() == 0


def test_rolling_totals(spark):
    rnd, rows = random.Random(3), []
    for run, n, span in (("a", 60, 500), ("b", 5, 3), (None, 8, 40), ("c", 1, 1), ("neg", 30, 200)):
        first = date(1969, 12, 1) if run == "neg" else date(2020, 1, 5)
        for k in range(n):
            d = datetime.combine(first + timedelta(days=rnd.randrange(span)), datetime.min.time()) + timedelta(seconds=rnd.randrange(86_400))
            rows.append((len(rows), run, d, rnd.choice([None, float("nan"), float("inf"), round(rnd.uniform(-9, 9), 2), 0.29])))
    rows.append((len(rows), "a", None, 5.0))
    df = spark.createDataFrame([*rows, *rows[:20]], "log_id long, run string, date timestamp_ntz, etceth_pnl double").withColumn("day", F.lit("clash"))
    want = {}
    for run in {r[1] for r in rows}:
        own = [(r[2].date(), round(r[3] * 100) if r[3] is not None and np.isfinite(r[3]) else 0) for r in rows if r[1] == run and r[2]]
        a, z = min(d for d, _ in own), max(d for d, _ in own)
        for k in range((z - a).days + 1):
            d = a + timedelta(days=k)
            want[run, str(d)] = tuple(sum(c for e, c in own if d - timedelta(days=w) < e <= d) for w in (7, 30))
    got = {(r.run, r.day): (r.total7_cents, r.total30_cents) for r in rolling_tiles.pnl_totals(df).collect()}
    assert got == want
    assert rolling_tiles.pnl_totals(df.limit(0)).count() == 0


def test_whole_numbers_beyond_doubles():
    import pyarrow as pa

    big = 2**53 + 1
    batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([0]), pa.array([0]), pa.array([1]), pa.array([[6, 7]], pa.list_(pa.int32())), pa.array([[big, 1]], pa.list_(pa.int64()))], names=["_entity", "_tile", "_lo", "_hi", "_at", "_v"])
    out = next(rolling_tiles._blocks(iter([batch]), 16, (7,)))
    assert out.column("total7").to_pylist() == [big, big + 1]


def test_grid(spark):
    ins = spark.createDataFrame([("A", 600), ("B", 0), ("C", None), ("A", 600)], "symbol string, grid_sec int")
    t = lambda s: datetime(2020, 1, 1) + timedelta(seconds=s)
    nan = float("nan")
    rows = [
        ("A", 1, t(300), 1.0, 2.0), ("A", 2, t(900), 3.0, 4.0), ("A", 2, t(900), 3.0, 4.0), ("A", 3, t(1300), None, 9.0), ("A", 4, t(1900), nan, 9.0), ("A", 5, t(2500), 5.0, 6.0), ("A", 6, t(86_400 + 700), None, None), ("A", 7, t(86_400 + 1900), 7.0, 8.0),
        ("B", 8, t(0), 1.0, 1.0), ("C", 9, t(0), 1.0, 1.0), (None, 10, t(0), 1.0, 1.0), ("A", 11, None, 1.0, 1.0), ("Z", 12, t(0), 1.0, 1.0),
    ]
    q = spark.createDataFrame(rows, "symbol string, quote_id long, time timestamp_ntz, bid double, ask double").withColumn("day", F.lit(1)).withColumn("cell", F.lit("x"))
    g = {r.period_us // 1_000_000 - micros(2020, 1, 1) // 1_000_000: r for r in grid.regular_grid(q, ins).collect()}
    assert sorted(g) == [0, 600, 1200, 1800, 2400, 87_000, 87_600, 88_200]
    assert [g[k].n_rows for k in sorted(g)] == [1, 1, 0, 0, 1, 0, 0, 1]
    assert g[0].coverage == pytest.approx(0.5) and g[0].bid_twa == 1.0
    assert g[600].bid_twa == pytest.approx((300 * 1 + 300 * 3) / 600) and g[1200].bid_twa == 3.0 and g[1200].state == "filled"
    assert g[2400].ask_twa == pytest.approx((100 * 4 + 500 * 6) / 600)
    assert g[87_000].bid_twa == 5.0  # held across midnight
    assert g[88_200].bid_twa == pytest.approx((100 * 5 + 500 * 7) / 600)
    found = {r.period_us for r in grid.found(q, ins).collect()}
    assert found == {g[k].period_us for k in (1200, 1800, 87_000, 87_600)}
    assert grid.found(q.limit(0), ins).count() == 0 and grid.found(q, ins.limit(0)).count() == 0


def test_nearest(spark):
    rnd = random.Random(7)
    c = [(e, rnd.randrange(3 * nearest.SHARD_US), k) for k, e in enumerate(rnd.choices(["a", "b"], k=400))]
    p = [(e, rnd.randrange(3 * nearest.SHARD_US), k) for k, e in enumerate(rnd.choices(["a", "b", "none", None], k=200))]
    edge = nearest.SHARD_US
    c += [("a", edge - 5, 900), ("a", edge + 5, 901), ("a", edge + 5, 899), ("a", 10, 902), ("a", 20, 903), (None, 15, 904), ("b", None, 905)]
    p += [("a", edge, 900), ("a", 15, 901), ("b", None, 902), ("a", edge + 6, 903), ("a", 15, 901)]
    tol = {"a": 40_000_000, "b": 600_000_000}
    want = {}
    for e, t, k in p:
        near = [(abs(t - u), u, i) for f, u, i in c if f == e and u is not None and t is not None and e in tol and abs(t - u) <= tol[e]]
        if near:
            want[k] = min(near)[2]
    s = "entity string, t long, id long"
    tols = spark.createDataFrame([*tol.items(), ("x", -1), (None, 5)], "entity string, tol_us long")
    got = nearest.nearest_in_time(spark.createDataFrame(p, s), spark.createDataFrame(c + c[:50], s), tols).collect()
    assert {r.probe_id: r.candidate_id for r in got} == want and len(got) == len(want)
    assert nearest.nearest_in_time(spark.createDataFrame([], s), spark.createDataFrame(c, s), tols).count() == 0
    assert nearest.nearest_in_time(spark.createDataFrame(p, s), spark.createDataFrame([], s), tols).count() == 0


@pytest.mark.parametrize("keys", [np.arange(5000), np.sort(np.unique(np.random.default_rng(1).integers(0, 10**15, 4000))), np.cumsum(np.random.default_rng(2).pareto(0.5, 3000).astype(np.int64) + 1), np.array([7]), np.array([], dtype=np.int64)])
def test_learned_index(keys):
    index = nearest.LearnedIndex(keys.astype(np.int64))
    rnd = np.random.default_rng(3)
    hi = int(keys[-1]) if len(keys) else 10
    probes = np.concatenate([rnd.integers(-5, hi + 6, 2000), keys, keys - 1, keys + 1]).astype(np.int64)
    assert (index.left(probes) == np.searchsorted(keys, probes, side="right") - 1).all()
    if len(keys):
        own = np.repeat(np.arange(len(index.starts)), index.ends - index.starts)
        miss = np.abs(index.starts[own] + index.slope[own] * (keys - keys[index.starts[own]]) - np.arange(len(keys)))
        assert miss.max() <= nearest.ERROR


def brute_flags(x):
    """Jumps and stuck readings of one source's positive readings in order."""
    out, n, log = set(), len(x), np.log(x)
    moves = np.abs(np.diff(log))
    moves = moves[moves > 0]
    if len(moves):
        q1, q3 = np.quantile(moves, [0.25, 0.75])
        reach = q3 + spikes.FENCE * (q3 - q1)
        for i in range(n):
            for p in range(4):
                for q in range(4 - p):
                    a, b = i - p - 1, i + q + 1
                    off = min(min(abs(log[j] - log[a]), abs(log[j] - log[b])) for j in range(a + 1, b)) if a >= 0 and b < n else 0
                    if off >= 2 * reach and abs(log[a] - log[b]) < spikes.BACK * off:
                        if abs(log[i] - np.median(np.r_[log[max(0, i - 4) : i], log[i + 1 : i + 5]])) >= reach:
                            out.add((i, "jump"))
    edges = np.flatnonzero(np.r_[True, np.diff(x) != 0, True])
    length = np.diff(edges)
    usual = np.sort(length)[int(np.ceil(0.9 * len(length))) - 1]
    for a, k in zip(edges, length, strict=False):
        if k >= max(spikes.RUN_LEAST, np.ceil(3 * usual + 1)):
            out |= {(j, "stuck") for j in range(a + 1, a + k)}
    return out


def test_spikes_over_edges_of_stretches(spark):
    rng = np.random.default_rng(11)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 1e-3, 900)))
    x[100] *= 1.05
    x[200:204] *= 0.93  # four, over an edge below
    x[300:306] *= 1.06  # six: a level that is left again, no case
    x[400:] *= 1.2  # lasting
    x[500:530] = x[500]  # stuck over two edges
    x[620], x[622] = x[620] * 1.1, x[622] * 1.1  # the reading between is right
    x[898] *= 1.5
    for cuts in ([], [202], [201, 203, 505, 515], list(range(7, 900, 7)), list(range(1, 900))):
        stretch = np.searchsorted(cuts, np.arange(900), side="right") if cuts else np.zeros(900, int)
        rows = [(0, "s", int(stretch[k]), 1000 * k, k, float(v)) for k, v in enumerate(x)]
        df = spark.createDataFrame(rows + rows[::9] + [(0, "s", 0, 5, 2000, -1.0), (0, "s", 0, 6, 2001, 0.0), (1, "s", 0, 6, 2002, float("inf"))], "tab int, symbol string, stretch long, t long, id long, x double")
        got = {(r.tab, r.rec_id, r.flag) for r in spikes.implausible(df).collect()}
        want = {("quotes", i, f) for i, f in brute_flags(x)} | {("quotes", 2000, "value"), ("quotes", 2001, "value"), ("fills", 2002, "value")}
        assert got == want, cuts[:3]
    assert {i for i, f in brute_flags(x) if f == "jump"} == {100, 200, 201, 202, 203, 620, 622, 898}


@pytest.mark.parametrize("rows", [20, 45, 130])
def test_long_stretches_in_pieces(spark, monkeypatch, rows):
    """One stretch taken in pieces gives the flags of the same readings in many stretches."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    n = 700
    x = 100 * np.exp(np.cumsum(rng.normal(0, 1e-3, n)))
    x[30] *= 1.05
    x[90:94] *= 0.93
    x[128:131] = x[127]
    x[200:330] = x[200]  # over many pieces
    x[440] *= 1.006  # beyond the fence and fast
    x[690:] = x[690]
    t = 60_000_000 * np.arange(n, dtype=np.int64)
    t[440:] -= 59_900_000
    t[441:] -= 59_900_000
    data = [(0, "a", 0, int(t[k]), k, float(x[k])) for k in range(n)] + [(0, "b", k // 50, int(t[k]), 10_000 + k, float(x[k])) for k in range(n)]
    data += [(0, s, 0, 5 * k, 20_000 + 100 * i + k, [0.0, -1.0, math.inf][k % 3]) for i, s in enumerate("ab") for k in range(70)]
    df = spark.createDataFrame(data + data[::7] + data[-30:], "tab int, symbol string, stretch long, t long, id long, x double")
    want = {(r.rec_id, r.flag) for r in spikes.implausible(df).collect()}
    assert {(i + 10_000, f) for i, f in want if i < 10_000} == {(i, f) for i, f in want if 10_000 <= i < 20_000}
    assert {f for _, f in want} == {"jump", "stuck", "rate", "value"} and (440, "rate") in want and sum(f == "value" for _, f in want) == 140

    # the two passes by hand, with few rows gathered at a time
    def batches(d):
        names = [c for c in d.columns]
        rows_ = d.sort("tab", "symbol", "stretch", *([c for c in ("kind",) if c in names]), "t", "id").toArrow()
        return iter(rows_.to_batches(max_chunksize=11))

    monkeypatch.setattr(spikes, "ROWS", rows)
    survey = pa.Table.from_batches(list(spikes._survey(batches(df.filter("x > 0 and x <> double('infinity')")))))
    s = spark.createDataFrame(survey.to_pandas().astype({"kind": "int32", "tab": "int32"}), spikes._SURVEY)
    whole = df.selectExpr("tab", "symbol", "stretch", "case when x > 0 and x <> double('infinity') then 2 else -1 end as kind", "t", "id", "x", "cast(0 as bigint) as e", "cast(null as array<double>) as h")
    flags = [r for b in spikes._flags(batches(whole.unionByName(spikes._context(s)))) for r in b.to_pylist()]
    assert {(r["rec_id"], r["flag"]) for r in flags} == want and len(flags) == len(want)


def test_a_dense_shard_takes_time_in_proportion(monkeypatch):
    """Five million rows of one shard: no more than the gathered rows are held, and each is worked on once."""
    import time

    import pyarrow as pa

    def stream(n, shards):
        t = np.arange(n, dtype=np.int64) * 10
        side = (np.arange(n) % 5 == 2).astype(np.int32)
        t = t + side * 3
        for a in range(0, n, 10_000):
            m = min(10_000, n - a)
            yield pa.RecordBatch.from_arrays([pa.array(["x"] * m), pa.array((np.arange(a, a + m) * shards // n).astype(np.int64)), pa.array(side[a : a + m]), pa.array(t[a : a + m]), pa.array(np.arange(a, a + m)), pa.array(np.full(m, 1000, np.int64))], names=["_entity", "_shard", "_side", "_t", "_id", "_tol"])

    most, match = [], nearest._match
    monkeypatch.setattr(nearest, "_match", lambda *a: most.append(len(a[0])) or match(*a))
    took = {}
    for n in (1_000_000, 5_000_000):
        began = time.time()
        got = pa.Table.from_batches(list(nearest._matched(stream(n, 1))))
        took[n] = time.time() - began
        probe, candidate = (got.column(c).to_numpy() for c in ("probe_id", "candidate_id"))
        assert len(probe) == len(set(probe.tolist())) == n // 5 and (candidate == probe - 1).sum() + (candidate == probe + 1).sum() == len(probe)
    assert max(most) <= nearest.ROWS + 10_000 + 200
    assert took[5_000_000] < 9 * took[1_000_000]


def test_shards_cut_anywhere(spark, monkeypatch):
    """Few rows at a time give what all at once give, with ties, repeats and tolerances longer than a shard."""
    import pyarrow as pa

    rnd = random.Random(5)
    c = [("a", rnd.randrange(3000), k) for k in range(600)]
    p = [("a", rnd.randrange(3000), k) for k in range(400)]
    s, tols = "entity string, t long, id long", spark.createDataFrame([("a", 40)], "entity string, tol_us long")
    want = {k: min(near)[2] for _, t, k in p if (near := [(abs(t - u), u, i) for _, u, i in c if abs(t - u) <= 40])}
    for rows in (7, 10_000):  # the widths of the shards depend on it
        monkeypatch.setattr(nearest, "ROWS", rows)
        got = nearest.nearest_in_time(spark.createDataFrame(p + p[::3], s), spark.createDataFrame(c + c[::3], s), tols, shard_us=30).collect()
        assert {r.probe_id: r.candidate_id for r in got} == want and len(got) == len(want)
    # sorted rows of shards of 500 with their overlaps, a few at a time
    rows = [("a", u, k, 0) for _, u, k in c + c[::3]] + [("a", u, k, 1) for _, u, k in p + p[::3]]
    rows = sorted((e, q, side, t, i) for e, t, i, side in rows for q in ({t // 500} if side else {(t - 40) // 500, (t + 40) // 500}))
    rows.sort(key=lambda r: (r[0], r[1], r[3], r[2], r[4]))
    for size in (1, 3, 17, 100):
        monkeypatch.setattr(nearest, "ROWS", size)
        parts = [rows[k : k + 5] for k in range(0, len(rows), 5)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in q]), pa.array([r[1] for r in q], pa.int64()), pa.array([r[2] for r in q], pa.int32()), pa.array([r[3] for r in q], pa.int64()), pa.array([r[4] for r in q], pa.int64()), pa.array([40] * len(q), pa.int64())], names=["_entity", "_shard", "_side", "_t", "_id", "_tol"]) for q in parts]
        got = [(r["probe_id"], r["candidate_id"]) for b in nearest._matched(iter(batches)) for r in b.to_pylist()]
        assert dict(got) == want and len(got) == len(want), size


def test_spikes_of_flat_short_and_empty_sources(spark):
    s = "tab int, symbol string, stretch long, t long, id long, x double"
    rows = [(0, "flat", 0, k, k, 5.0) for k in range(30)] + [(0, "one", 0, 1, 100, 2.0)] + [(1, "two", 0, k, 200 + k, 1.0 + k) for k in range(2)]
    assert {r.flag for r in spikes.implausible(spark.createDataFrame(rows, s)).collect()} <= {"stuck"}
    assert spikes.implausible(spark.createDataFrame([], s)).count() == 0


def test_fills_by_either_spelling(spark):
    ins = spark.createDataFrame([("BTCUSDT", "BTC/USDT", 5000)], "symbol string, instrument string, tol_ms int")
    t = datetime(2020, 1, 1)
    fills = spark.createDataFrame([(1, " btc/usdt\t", t), (2, "BTCusdt", t), (3, None, t), (4, "ETH/USDT", t), (5, "BTCUSDT", None), (1, " btc/usdt\t", t)], "fill_id long, instrument string, time timestamp_ntz").withColumn("_symbol", F.lit("clash"))
    quotes = spark.createDataFrame([(10, "BTCUSDT", t - timedelta(seconds=2)), (11, "BTCUSDT", t + timedelta(seconds=2)), (12, None, t)], "quote_id long, symbol string, time timestamp_ntz")
    assert {(r.fill_id, r.quote_id) for r in nearest.found(fills, quotes, ins).collect()} == {(1, 10), (2, 10)}
