"""Statistics of a group's series: divergences, roughness, cointegration, decomposition, warping, allocation.

Small dense algebra runs in numpy on one group at a time; a group is a series of
bars. Sums over rows (moments, covariances) are aggregates in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import by_symbol


def j_divergence(df: DataFrame, p: str, q: str) -> DataFrame:
    """Divergence of two columns by their means and population deviations, per symbol."""
    m = df.groupBy("symbol").agg(F.avg(p).alias("mp"), F.avg(q).alias("mq"), F.stddev_pop(p).alias("sp"), F.stddev_pop(q).alias("sq")).filter("sp > 0 and sq > 0")
    return m.select("symbol", (0.5 * (F.pow(F.col("mp") - F.col("mq"), 2) * (1 / F.col("sp") + 1 / F.col("sq")) + F.col("sq") / F.col("sp") + F.col("sp") / F.col("sq") - 2)).alias("divergence"))


def hurst(df: DataFrame, column: str, lags: int = 20) -> DataFrame:
    """Twice the slope of the log root deviation of lagged differences on the log lag."""
    w = by_symbol()
    x = df.select("symbol", *[(F.lead(column, k).over(w) - F.col(column)).alias(f"d{k}") for k in range(2, lags)])
    s = x.groupBy("symbol").agg(*[F.stddev_pop(f"d{k}").alias(f"d{k}") for k in range(2, lags)])
    long = s.select("symbol", F.inline(F.array(*[F.struct(F.lit(math.log10(k)).alias("lag"), F.col(f"d{k}").alias("s")) for k in range(2, lags)])))
    return long.filter("s > 0").groupBy("symbol").agg((2 * F.regr_slope(F.log10(F.sqrt("s")), "lag")).alias("hurst"))


def hurst_rescaled(x: Sequence[float], least: int = 10) -> tuple[float, float]:
    """Hurst exponents by rescaled ranges over equal boxes: corrected for small samples, and raw.

    The series is cut to the length within 1 % of its own that has most divisors.
    """
    x = np.asarray(x, dtype=float)
    boxes = lambda n: [k for k in range(least, n // 2 + 1) if n % k == 0]
    n = max(range(int(0.99 * len(x)), len(x) + 1), key=lambda k: len(boxes(k)))
    sizes = boxes(n)
    if len(sizes) < 2:
        return float("nan"), float("nan")
    ratio, expected = [], []
    for k in sizes:
        y = x[:n].reshape(-1, k)
        walk = np.cumsum(y - y.mean(axis=1, keepdims=True), axis=1)
        s = y.std(axis=1, ddof=1)
        ratio.append(np.mean((walk.max(axis=1) - walk.min(axis=1))[s > 0] / s[s > 0]))
        i = np.arange(1, k)
        root = (k - 0.5) / k * np.sqrt((k - i) / i).sum()
        expected.append(root / math.sqrt(0.5 * math.pi * k) if k > 340 else math.exp(math.lgamma(0.5 * (k - 1)) - math.lgamma(0.5 * k)) * root / math.sqrt(math.pi))
    logs, ratio, expected = np.log10(sizes), np.array(ratio), np.array(expected)
    corrected = np.polyfit(logs, np.log10(ratio - expected + np.sqrt(0.5 * math.pi * np.array(sizes))), 1)[0]
    return float(corrected), float(np.polyfit(logs, np.log10(ratio), 1)[0])


def density_mode(x: Sequence[float], points: int = 512) -> float:
    """Mode of a Gaussian kernel density (Scott's width) on a grid; the mean if nothing varies."""
    x = np.asarray(x, dtype=float)
    x = x[np.isfinite(x)]
    if len(x) < 2 or x.std() == 0:
        return float(x.mean()) if len(x) else float("nan")
    width = x.std(ddof=1) * len(x) ** (-1 / 5)
    grid = np.linspace(x.min(), x.max(), points)
    total = np.zeros(points)
    for part in np.array_split(x, max(1, len(x) // 4096)):
        total += np.exp(-0.5 * ((grid[:, None] - part[None, :]) / width) ** 2).sum(axis=1)
    return float(grid[total.argmax()])


def dickey_fuller(x: Sequence[float], lags: int = 1) -> tuple[float, float]:
    """t statistic of the level in the regression of the change (with a constant), and its 5 % critical value."""
    x = np.asarray(x, dtype=float)
    d = np.diff(x)
    y = d[lags:]
    design = np.column_stack([x[lags:-1], np.ones(len(y)), *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
    b, *_ = np.linalg.lstsq(design, y, rcond=None)
    rest = y - design @ b
    s = rest @ rest / (len(y) - design.shape[1])
    se = math.sqrt(s * np.linalg.pinv(design.T @ design)[0, 0])
    n = len(y)
    return float(b[0] / se), -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3


#: 90, 95 and 99 % critical values with a constant, for 1 to 8 remaining trends.
TRACE = ((2.705, 3.841, 6.635), (13.429, 15.494, 19.935), (27.067, 29.796, 35.463), (44.493, 47.855, 54.681), (65.820, 69.819, 77.820), (91.109, 95.754, 104.964), (120.367, 125.618, 135.982), (153.634, 159.529, 171.090))
LARGEST = ((2.705, 3.841, 6.635), (12.297, 14.264, 18.520), (18.893, 21.131, 25.865), (25.124, 27.586, 32.717), (31.238, 33.878, 39.369), (37.279, 40.076, 45.866), (43.295, 46.230, 52.307), (49.285, 52.362, 58.663))


def johansen(x: np.ndarray, lags: int) -> dict[str, np.ndarray]:
    """Cointegration of columns with a constant: eigenvalues and vectors, trace and largest-root statistics."""
    x = np.asarray(x, dtype=float)
    x = x - x.mean(axis=0)
    d = np.diff(x, axis=0)
    center = lambda v: v - v.mean(axis=0)
    past = center(np.column_stack([d[lags - k : len(d) - k] for k in range(1, lags + 1)]))
    project = np.linalg.pinv(past)
    free = lambda v: v - past @ (project @ v)
    change, level = free(center(d[lags:])), free(center(x[1 : len(x) - lags]))
    n, m = change.shape
    kk, k0, oo = level.T @ level / n, level.T @ change / n, change.T @ change / n
    root = np.linalg.cholesky(kk)
    inner = np.linalg.solve(root, k0 @ np.linalg.solve(oo, k0.T))
    values, vectors = np.linalg.eigh(np.linalg.solve(root, inner.T).T)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, 1 - 1e-15), np.linalg.solve(root.T, vectors[:, order])
    single = -n * np.log(1 - values)
    table = lambda t: np.array([t[m - r - 1] if m - r <= len(t) else (0.0,) * 3 for r in range(m)])
    return {"eigenvalues": values, "vectors": vectors, "trace": single[::-1].cumsum()[::-1], "largest": single, "trace_critical": table(TRACE), "largest_critical": table(LARGEST)}


def spectrum(x: Sequence[float], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Singular spectrum of a series: principal components, singular values, vectors."""
    x = np.asarray(x, dtype=float)
    t = len(x) - dim + 1
    windows = np.lib.stride_tricks.sliding_window_view(x, dim) / math.sqrt(t)
    _, s, v = np.linalg.svd(windows, full_matrices=False)
    return windows @ v.T, s, v.T


def rebuild(components: np.ndarray, vectors: np.ndarray, keep: Sequence[int]) -> np.ndarray:
    """The series from some components, averaged over its anti-diagonals."""
    keep = list(keep)
    t, dim = components.shape
    part = components[:, keep] @ vectors[:, keep].T
    total, count = np.zeros(t + dim - 1), np.zeros(t + dim - 1)
    for k in range(dim):
        total[k : k + t] += part[:, k]
        count[k : k + t] += 1
    return total / count * math.sqrt(t)


def forecast(x: Sequence[float], dim: int, keep: Sequence[int], steps: int, error: float = 1e-8, rounds: int = 1000) -> np.ndarray:
    """Values ahead, each the fixed point of rebuilding the series that ends with it."""
    out = np.asarray(x, dtype=float)
    for _ in range(steps):
        out = np.append(out, out[-1])
        for _ in range(rounds):
            pc, _, v = spectrum(out, dim)
            new = rebuild(pc, v, keep)[-1]
            moved, out[-1] = abs(new - out[-1]), new
            if moved < error * max(1.0, abs(new)):
                break
    return out


def component_count(x: Sequence[float], dim: int = 20, percentile: float = 75) -> int:
    """Components whose share of the singular entropy lies above a percentile of all shares."""
    _, s, _ = spectrum(x, dim)
    p = s / s.sum()
    entropy = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0)
    return int((entropy > np.percentile(entropy, percentile)).sum())


def warp_distance(a: Sequence[float], b: Sequence[float], window: int | None = None) -> float:
    """Dynamic time warping, row by row; with a window only cells less than that far from the diagonal."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    w = max(len(a), len(b)) + 1 if window is None else max(window, abs(len(a) - len(b)))
    before = np.full(len(b) + 1, np.inf)
    before[0] = 0.0
    for i, v in enumerate(a):
        now = np.full(len(b) + 1, np.inf)
        for j in range(max(0, i - w), min(len(b), i + w)):
            now[j + 1] = (v - b[j]) ** 2 + min(before[j + 1], now[j], before[j])
        before = now
    return math.sqrt(before[-1])


def keogh_bound(a: Sequence[float], b: Sequence[float], radius: int) -> float:
    """A lower bound of the warping distance: how far ``a`` leaves the envelope of ``b``."""
    b = np.asarray(b, dtype=float)
    total = 0.0
    for i, v in enumerate(a):
        near = b[max(0, i - radius) : i + radius]
        total += max(v - near.max(), near.min() - v, 0.0) ** 2 if len(near) else 0.0
    return math.sqrt(total)


def nearest_series(train: Sequence[tuple[object, np.ndarray]], x: np.ndarray, window: int, radius: int = 5) -> object:
    """Label of the series nearest by warping; the bound spares most of the work."""
    best, label = math.inf, None
    for name, y in train:
        if keogh_bound(x, y, radius) < best and (d := warp_distance(x, y, window)) < best:
            best, label = d, name
    return label


def nearest_of_all(series: DataFrame, window: int, radius: int = 5, blocks: int = 8) -> DataFrame:
    """``symbol``, ``nearest``, ``distance``: for each series the other one that is nearest by warping.

    ``series``: symbol, v (array). Queries and candidates are cut into blocks by
    hash and each pair of blocks is a group; of a group only the best candidate
    of each query comes out, most pairs being settled by the lower bound.
    """
    own = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    all_ = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    x = series.filter(F.col("symbol").isNotNull() & F.col("v").isNotNull()).select("symbol", F.col("v").cast("array<double>").alias("v"))
    both = x.select("*", own.alias("_q"), all_.alias("_c"), F.lit(True).alias("_query")).unionByName(x.select("*", all_.alias("_q"), own.alias("_c"), F.lit(False).alias("_query")))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        out, candidates = [], [(s, np.asarray(v)) for s, v, q in zip(pdf.symbol, pdf.v, pdf["_query"], strict=True) if not q]
        for s, v in ((s, np.asarray(v)) for s, v, q in zip(pdf.symbol, pdf.v, pdf["_query"], strict=True) if q):
            least, name = math.inf, None
            bounds = sorted(((keogh_bound(v, y, radius), c, y) for c, y in candidates if c != s), key=lambda b: b[:2])
            for low, c, y in bounds:
                if low > least:
                    break
                if (d := warp_distance(v, y, window)) < least or d == least and c < name:
                    least, name = d, c
            if name is not None:
                out.append((s, name, least))
        return pd.DataFrame(out, columns=["symbol", "nearest", "distance"])

    top = both.groupBy("_q", "_c").applyInPandas(best, "symbol string, nearest string, distance double")
    return top.groupBy("symbol").agg(F.min_by("nearest", F.struct("distance", "nearest")).alias("nearest"), F.min("distance").alias("distance"))


def cluster_series(series: Sequence[np.ndarray], k: int, window: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """k-means with the warping distance: the cluster of each series."""
    x = np.asarray(series, dtype=float)
    centers = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        new = np.array([min(range(k), key=lambda c: warp_distance(v, centers[c], window)) for v in x])
        for c in range(k):
            if (new == c).any():
                centers[c] = x[new == c].mean(axis=0)
        if (new == own).all():
            break
        own = new
    return own


def simplex(v: Sequence[float], total: float = 1.0) -> np.ndarray:
    """The nearest point with positive parts of sum ``total`` to the positive part of ``v``."""
    v = np.maximum(np.asarray(v, dtype=float), 0)
    u = np.sort(v)[::-1]
    excess = (np.cumsum(u) - total) / np.arange(1, len(u) + 1)
    k = np.flatnonzero(u > excess)[-1]
    return np.maximum(v - max(0.0, excess[k]), 0)


def tangency(returns: np.ndarray, risk_free: float = 0.01) -> np.ndarray:
    """Weights of the best return per risk, which may be negative."""
    w = np.linalg.solve(np.cov(returns.T), returns.mean(axis=0) - risk_free)
    return w / w.sum()


def least_variance(returns: np.ndarray, mean: float | None = None) -> np.ndarray:
    """Weights of the least variance, with a given mean if one is named."""
    cov, ones = np.cov(returns.T), np.ones(returns.shape[1])
    if mean is None:
        w = np.linalg.solve(cov, ones)
        return w / w.sum()
    rows = np.stack([returns.mean(axis=0), ones])
    inner = np.linalg.solve(cov, rows.T)
    return inner @ np.linalg.solve(rows @ inner, np.array([mean, 1.0]))


def reversion_step(prices: np.ndarray, weights: np.ndarray, epsilon: float = 1.0, volumes: np.ndarray | None = None) -> np.ndarray:
    """New weights from the expected return to (volume-weighted) mean prices, on the simplex.

    ``prices``: one row per asset, the last column the newest.
    """
    mean = prices.mean(axis=1) if volumes is None else (prices * volumes).sum(axis=1) / volumes.sum(axis=1)
    x = mean / prices[:, -1]
    d = x - x.mean()
    far = float(d @ d)
    step = max(0.0, (epsilon - float(np.asarray(weights) @ x)) / far) if far else 0.0
    return simplex(np.asarray(weights) + step * d)


def rolling_fit(y: np.ndarray, design: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares over each window of n rows: coefficients, last error, deviation of the errors."""
    k = design.shape[1]
    beta, error, spread = np.full((len(y), k), np.nan), np.full(len(y), np.nan), np.full(len(y), np.nan)
    for i in range(n - 1, len(y)):
        a, b = design[i - n + 1 : i + 1], y[i - n + 1 : i + 1]
        if np.isfinite(a).all() and np.isfinite(b).all():
            w, *_ = np.linalg.lstsq(a, b, rcond=None)
            rest = b - a @ w
            beta[i], error[i], spread[i] = w, rest[-1], rest.std()
    return beta, error, spread


def rolling_detrend(y: np.ndarray, order: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Last residual and r2 of a polynomial over each window of n rows."""
    design = np.vander(np.linspace(-1, 1, n), order + 1)
    project = design @ np.linalg.pinv(design)
    out, r2 = np.full(len(y), np.nan), np.full(len(y), np.nan)
    if len(y) >= n:
        v = np.lib.stride_tricks.sliding_window_view(np.asarray(y, dtype=float), n)
        rest = v - v @ project.T
        out[n - 1 :] = rest[:, -1]
        with np.errstate(invalid="ignore", divide="ignore"):
            r2[n - 1 :] = 1 - (rest**2).sum(axis=1) / ((v - v.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    return out, r2


def per_group(df: DataFrame, keys: Sequence[str], f: Callable[[pd.DataFrame], dict[str, object]], columns: str) -> DataFrame:
    """One row per group: the keys and what ``f`` gives for its rows in order of ``ts``."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + columns

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | f(pdf.sort_values("ts", kind="stable"))])

    return df.groupBy(*keys).applyInPandas(apply, schema)


def rolling_weights(returns: DataFrame, train: int, test: int, allocate: Callable[[np.ndarray], np.ndarray], symbols: Sequence[str]) -> DataFrame:
    """``fold``, ``symbol``, ``weight``: fitted on each fold's training days."""
    from .resample import walk_forward

    folds = walk_forward(returns.filter(F.col("symbol").isin(*symbols)), train, test).filter("part = 'train'")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="ts", columns="symbol", values="r", aggfunc="last").reindex(columns=list(symbols)).dropna()
        w = allocate(wide.to_numpy()) if len(wide) > len(symbols) else np.full(len(symbols), np.nan)
        return pd.DataFrame({"fold": pdf.fold.iloc[0], "symbol": list(symbols), "weight": w})

    return folds.select("fold", "symbol", "ts", "r").groupBy("fold").applyInPandas(fit, "fold int, symbol string, weight double")


def scaled_slope(values: np.ndarray, n: int, method: str = "ols", scale: str | None = "steps", bins: int = 5) -> np.ndarray:
    """Slope over each window of n rows: of the window scaled to -1..1 (``ols``), or as an angle
    of the change per row. ``steps`` puts it on half steps from -bins to bins, ``bins`` into bins."""
    x = np.asarray(values, dtype=float)
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        v = np.lib.stride_tricks.sliding_window_view(x, n)
        if method == "ols":
            lo, hi = v.min(axis=1, keepdims=True), v.max(axis=1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                y = 2 * (v - lo) / (hi - lo) - 1
            line = np.linspace(-1, 1, n)
            out[n - 1 :], top = y @ line / (line @ line), 1.0
        else:
            out[n - 1 :], top = np.degrees(np.arctan((v[:, -1] - v[:, 0]) / n)), 90.0
        if scale == "steps":
            out = np.round(np.clip(out / top, -1, 1) * 2 * bins) / 2
        elif scale == "bins":
            k = (bins - 1) * 4
            out = (np.floor(k * (out + top) / (2 * top)) - k // 2) / 2
    return out


def locked_trend(values: np.ndarray, order: int, n: int, ahead: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """How far each value lies from the polynomial of the n rows that end 1 to ``ahead`` rows before it
    (one column each), and the r2 of the window that ends at the row."""
    x = np.asarray(values, dtype=float)
    rest, r2 = np.full((len(x), ahead), np.nan), np.full(len(x), np.nan)
    m = n + ahead
    if len(x) >= m:
        v = np.lib.stride_tricks.sliding_window_view(x, m)
        design = np.vander(np.linspace(-1, 1, m), order + 1)
        beta = v[:, :n] @ np.linalg.pinv(design[:n]).T
        fitted = beta @ design.T
        with np.errstate(invalid="ignore", divide="ignore"):
            total = ((v[:, :n] - v[:, :n].mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
            r2[n - 1 : len(x) - ahead] = 1 - ((v[:, :n] - fitted[:, :n]) ** 2).sum(axis=1) / total
        for k in range(ahead):
            rest[n + k : len(x) - ahead + k + 1, k] = v[:, n + k] - fitted[:, n + k]
    return rest, r2


def space_time_distance(a: Sequence[float], b: Sequence[float], window: int) -> float:
    """Distance of the first two elements and of the warped rest."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    return math.sqrt(math.dist(a[:2], b[:2]) + warp_distance(a[2:], b[2:], window))
