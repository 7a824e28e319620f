import math
import random

import pytest

from tideline.llm import mixing as M


def whole(weights, slots, frame):
    """(slot, source, block) of all frames, and what is left over."""
    out, at = [], 0
    while at < slots:
        n = min(frame, slots - at)
        a, b = M.counts_at(weights, at), M.counts_at(weights, at + n)
        out += M.pfair(weights, {s: (a[s], b[s]) for s in weights}, at, n)
        at += n
    return out


def deviation(weights, slots):
    """The worst deviation of a source from its target after a slot, in blocks."""
    got, worst = dict.fromkeys(weights, 0), 0.0
    for slot, s in enumerate(slots, 1):
        if s:
            got[s] += 1
        worst = max([worst, *(abs(got[x] - w * slot) for x, w in weights.items())])
    return worst


WEIGHTS = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0}, {"a": 0.7, "b": 0.1, "c": 0.1, "d": 0.1}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": 0.41, "b": 0.17}, {f"s{k}": (k + 1) / 91 for k in range(13)}]


@pytest.mark.parametrize("weights", WEIGHTS)
@pytest.mark.parametrize("frame", [7, 64, 1000])
def test_less_than_one_block_off(weights, frame):
    n = 300
    plan = whole(weights, n, frame)
    slots = [None] * n
    for slot, s, _ in plan:
        assert slot < n and slots[slot] is None
        slots[slot] = s
    assert deviation(weights, slots) < 1
    for s, w in weights.items():  # each block once, in order, within its window
        own = [(slot, k) for slot, x, k in plan if x == s]
        assert [k for _, k in own] == list(range(1, len(own) + 1)) and len(own) >= math.floor(w * n + 1e-9)
        assert all(math.floor((k - 1) / w + 1e-9) <= slot < math.ceil(k / w - 1e-9) for slot, k in own)
    assert len(plan) == math.floor(sum(weights.values()) * n + 1e-6)


def tables(spark):
    n = spark.createDataFrame([(k, "big", 10) for k in range(1000)] + [(5000 + k, "small", 10) for k in range(10)] + [(9000, None, 7), (9001, "empty", 0), (None, "big", 0)], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 3), ("m", "none", 0.1, 9), ("z", "big", 0.0, 1), (None, "big", 1.0, 1), ("e", "empty", 1.0, 1)], "mix string, source string, target_share double, max_repeat int")
    return n, t


def test_report_and_places(spark):
    n, t = tables(spark)
    rep = {(r.mix, r.source): r for r in M.report(n, t, block=101, frame=16).collect()}
    assert set(rep) == {("m", "big"), ("m", "small"), ("m", "none"), ("z", "big"), ("e", "empty")}
    assert not rep["m", "big"].short and rep["m", "small"].short and rep["m", "none"].short and not rep["z", "big"].short and rep["e", "empty"].short
    assert rep["m", "small"].tokens == 300 and rep["m", "big"].tokens == 5050 and rep["m", "big"].actual_share == 0.5
    assert rep["m", "small"].missed_blocks == 50 - 3 and rep["m", "big"].missed_blocks == 0
    uses = M.place(n, t, block=101, frame=16, ranges=8).collect()
    assert sum(u.n_tokens for u in uses if u.source == "big") == 5050
    small = [u for u in uses if u.source == "small"]
    assert len(small) == 30 and {u["pass"] for u in small} == {1, 2, 3} and len({(u.mix, u.doc_id, u["pass"]) for u in uses}) == len(uses)
    assert all(u.slot is not None and 0 <= u.at < 101 for u in uses)
    assert M.report(n.limit(0), t).filter("tokens > 0").count() == 0 and M.report(n, t.limit(0)).count() == 0


def test_without_the_schedule_nothing_is_reached(spark, monkeypatch):
    n, t = tables(spark)
    monkeypatch.setattr(M, "schedule", lambda d, block, frame: d.sparkSession.createDataFrame([], "mix string, source string, block bigint, slot bigint"))
    rows = M.report(n, t, block=101).collect()
    assert all(r.tokens == 0 for r in rows) and all(r.short for r in rows if r.target_share > 0)


@pytest.mark.parametrize("shares", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.6, "b": 0.2}, {"a": 0.9, "b": 0.9, "c": 0.2}])
def test_what_is_put_out_keeps_its_shares(spark, shares):
    """After every block the tokens put out of a source are off by less than a block and the last document."""
    rnd, block = random.Random(3), 256
    docs = [(k, s, rnd.randrange(1, 120)) for k, s in enumerate(rnd.choices(list(shares), k=1500))]
    n = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("m", s, w, 9) for s, w in shares.items()], "mix string, source string, target_share double, max_repeat int")
    uses = sorted(M.place(n, t, block=block, frame=10).collect(), key=lambda u: (u.slot, u.at))
    size, total = sum(d[2] for d in docs), max(1.0, sum(shares.values()))
    owner = {}
    for u in uses:
        assert owner.setdefault(u.slot, u.source) == u.source  # a slot is one block of one source
    got = dict.fromkeys(shares, 0)
    last = max(owner)
    by_slot = {}
    for u in uses:
        by_slot.setdefault(u.slot, []).append(u)
    for slot in range(min(last, int(size * total / block))):
        for u in by_slot.get(slot, []):
            got[u.source] += u.n_tokens
        for s, w in shares.items():
            assert abs(got[s] - w / total * (slot + 1) * block) < block + 120
    for s, w in shares.items():
        assert 0 <= sum(u.n_tokens for u in uses if u.source == s) - w * size < 120
    # in a source, documents go in passes: the second use of each after the first of all
    seq = [u["pass"] for u in uses if u.source == "a"]
    assert seq == sorted(seq)


def test_every_use_has_its_slot(spark):
    """Shares whose blocks don't come out even: what the last slots leave over still goes."""
    docs = [(k, s, 1 + k % 5) for k in range(700) for s in ("a", "b", "c")]
    docs = [(i, s, v) for i, (_, s, v) in enumerate(docs)]
    n = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([(f"m{b}", s, w, 2) for b in range(3) for s, w in zip("abc", [(0.1, 0.2, 0.7), (1 / 3, 1 / 3, 1 / 3), (0.31, 0.07, 0.5)][b], strict=True)], "mix string, source string, target_share double, max_repeat int")
    for block in (1, 64, 1000, 10**9):
        rep = M.report(n, t, block=block, frame=32).collect()
        for r in rep:
            have, size = sum(v for _, s, v in docs if s == r.source) * 2, sum(v for *_, v in docs)
            assert r.short == (have < r.target_share * size)
            assert r.tokens == have if r.short else 0 <= r.tokens - r.target_share * size < 5
