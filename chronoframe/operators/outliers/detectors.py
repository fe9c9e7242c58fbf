"""Detectors on one ordered array of values: scores in 0 to 1, and the sign of each anomaly.

A score is e / (e + b), with evidence e and boundary b: 0.5 on the boundary, more exactly
for what is flagged. NaN scores 0 and is not flagged.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .quantiles import hyndman_fan, mad, median, student_quantile

EPSILON = float(np.finfo(float).eps)
Result = tuple[np.ndarray, np.ndarray]


def score(evidence: np.ndarray, boundary: np.ndarray | float) -> np.ndarray:
    e, b = np.broadcast_arrays(np.asarray(evidence, float), np.asarray(boundary, float))
    with np.errstate(all="ignore"):
        out = e / (e + b)
        out = np.where((out <= 0.5) & (e > b), np.nextafter(0.5, 1), out)
        out = np.where((b == 0) | np.isinf(e), 1.0, out)
        return np.where(np.isnan(e) | (e <= 0) | np.isnan(b) | (b < 0) | np.isposinf(b), 0.0, out)


def _fenced(x: np.ndarray, center: float, low: float, high: float) -> Result:
    with np.errstate(invalid="ignore"):
        d = x - center
        b = np.where(d >= 0, high - center, center - low)
        b = np.where(b < 0, np.nan, b)
        e = np.abs(d)
        return score(e, b), np.where(e > b, np.sign(d), 0).astype(int)


def _finite(x: np.ndarray) -> np.ndarray:
    return x[np.isfinite(x)]


def _mean_std(x: np.ndarray) -> tuple[float, float]:
    x = _finite(x)
    return (float(x.mean()) if len(x) else math.nan), (float(x.std(ddof=1)) if len(x) > 1 else 0.0)


def _known(x: np.ndarray) -> np.ndarray:
    """Values with NaN as 0, for the recursions that must have a value at every step."""
    return np.where(np.isnan(x), 0.0, x)


def _baseline(x: np.ndarray) -> tuple[float, float]:
    return _mean_std(x[: min(len(x) // 2, 100)])


def zscore(x: np.ndarray, threshold: float = 3.0) -> Result:
    mean, std = _mean_std(x)
    return _fenced(x, mean, mean - threshold * std, mean + threshold * std)


def modified_zscore(x: np.ndarray, threshold: float = 3.5) -> Result:
    v = x[~np.isnan(x)]
    center, spread = median(v), mad(v)
    reach = threshold * spread / 0.6745
    return _fenced(x, center, center - reach, center + reach)


def iqr(x: np.ndarray, threshold: float = 1.5) -> Result:
    v = np.sort(_known(x))
    q1, q3 = v[len(v) // 4], v[3 * len(v) // 4]
    return _fenced(x, (q1 + q3) / 2, q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))


def mad_fences(x: np.ndarray, k: float = 3.0, estimator: str = "invariant") -> Result:
    v = x[~np.isnan(x)]
    center, reach = median(v), k * mad(v, estimator)
    return _fenced(x, center, center - reach, center + reach)


def double_mad(x: np.ndarray, k: float = 3.0, estimator: str = "invariant") -> Result:
    v = x[~np.isnan(x)]
    center = median(v)
    return _fenced(x, center, center - k * mad(v, estimator, "below"), center + k * mad(v, estimator, "above"))


def cusum(x: np.ndarray, k: float = 0.5, h: float = 5.0) -> Result:
    target, std = _baseline(x)
    n = len(x)
    if not (math.isfinite(std) and std > EPSILON and math.isfinite(target)):
        return np.zeros(n), np.zeros(n, int)
    up, down = np.zeros(n), np.zeros(n)
    a = b = 0.0
    for i, d in enumerate(((_known(x) - target) / std).tolist()):
        a, b = max(0.0, a + d - k), max(0.0, b - d - k)
        up[i], down[i] = a, b
    return score(np.maximum(up, down), h), np.where(up > h, 1, np.where(down > h, -1, 0))


def ewma(x: np.ndarray, alpha: float = 0.3, multiplier: float = 3.0) -> Result:
    target, sigma = _baseline(x)
    level, levels = target, np.zeros(len(x))
    for i, v in enumerate(_known(x).tolist()):
        level = alpha * v + (1 - alpha) * level
        levels[i] = level
    steps = np.arange(1, len(x) + 1)
    limit = multiplier * np.sqrt(sigma * sigma * alpha / (2 - alpha) * (1 - (1 - alpha) ** (2 * steps)))
    limit = np.where(limit <= EPSILON, np.nan, limit)
    d = levels - target
    return score(np.abs(d), limit), np.where(np.abs(d) > limit, np.sign(d), 0).astype(int)


def smoothed_zscore(x: np.ndarray, threshold: float = 3.5, influence: float = 0.0, lag: int = 10) -> Result:
    """A value against the mean and deviation of the ``lag`` before it, in which signals count with ``influence``."""
    if lag < 1 or not 0 <= influence <= 1 or not (math.isfinite(threshold) and threshold >= 0):
        raise ValueError("lag, influence or threshold out of range")
    n = len(x)
    scores, signs = np.zeros(n), np.zeros(n, int)
    first = max(1, lag if lag < n else n - 1)
    window = x[:first].tolist()
    mean, std, before, at = float(np.mean(window)), float(np.std(window)), window[-1], 0
    for i in range(min(n, lag), n):
        d = abs(x[i] - mean)
        scores[i] = score(d, threshold * std)[()]
        signs[i] = 0 if not d > threshold * std else 1 if x[i] > mean else -1
        before = influence * x[i] + (1 - influence) * before if signs[i] else x[i]
        window[at] = before
        at = (at + 1) % len(window)
        mean, std = float(np.mean(window)), float(np.std(window))
    return scores, signs


def _location_scale(x: np.ndarray, hybrid: bool) -> tuple[float, float]:
    if hybrid:
        m = median(x)
        return m, 1.4826 * median(np.abs(x - m))
    return float(x.mean()), float(x.std(ddof=1))


@lru_cache(1 << 16)
def esd_limit(alpha: float, m: int) -> float:
    """What the most extreme of m values may reach."""
    t = student_quantile(1 - alpha / (2 * m), m - 2)
    return (m - 1) * t / math.sqrt(m * m - 2 * m + m * t * t)


def esd(x: np.ndarray, alpha: float = 0.05, hybrid: bool = True, max_outliers: int | None = None) -> Result:
    """Rosner's generalised test: removes the most extreme value up to n/2 times, then steps back to the last rejection."""
    n = len(x)
    if max_outliers is not None and max_outliers >= n / 2:
        raise ValueError("max_outliers must be less than n/2")
    scores, signs = np.zeros(n), np.zeros(n, int)
    active, tried, limit = np.flatnonzero(~np.isnan(x)), [], 0.0
    for _ in range(n // 2 if max_outliers is None else max_outliers):
        m = len(active)
        if m < 3:
            break
        center, scale = _location_scale(x[active], hybrid)
        far = np.abs(x[active] - center)
        i = active[m - 1 - int(np.argmax(far[::-1]))]
        stat = float(far.max()) / scale if scale > 0 else 0.0
        limit = esd_limit(alpha, m)
        tried.append((i, stat, limit, 1 if x[i] > center else -1))
        active = active[active != i]
    k = max((j + 1 for j, c in enumerate(tried) if c[1] > c[2]), default=0)
    for i, stat, bound, _ in tried[k:]:
        scores[i] = score(stat, bound)[()]
    for i, stat, _, sign in tried[:k]:
        scores[i], signs[i] = score(max(stat, tried[k - 1][1]), tried[k - 1][2])[()], sign
    if len(active):
        center, scale = _location_scale(x[active], hybrid) if len(active) > 1 else (x[active][0], 0.0)
        stats = np.abs(x[active] - center) / scale if scale > 0 else np.zeros(len(active))
        scores[active] = score(stats, max(limit, float(stats.max())))
    return scores, signs


class RandomCutTree:
    """A tree of random cuts over points; a point's score is its displacement when it is removed."""

    def __init__(self, points: np.ndarray, rng: np.random.Generator):
        self.rng = rng
        self.root = self._build(points)

    def _build(self, points: np.ndarray):
        low, high = points.min(0), points.max(0)
        span = high - low
        if len(points) == 1 or not span.sum() > 0:
            return (low, high, len(points), None)
        axis = int(self.rng.choice(len(span), p=span / span.sum()))
        cut = low[axis] + self.rng.random() * span[axis]
        left = points[:, axis] <= cut
        if left.all():
            left = points[:, axis] < high[axis]
        return (low, high, len(points), (axis, cut, self._build(points[left]), self._build(points[~left])))

    def displacement(self, point: np.ndarray) -> float:
        """The largest ratio, on the point's way down, of the siblings that its cut separates to its own side."""
        node, depth_best = self.root, 0.0
        while True:
            low, high, size, cut = node
            outside = float(np.maximum(0, low - point).sum() + np.maximum(0, point - high).sum())
            span = float((high - low).sum())
            if outside > 0:
                depth_best = max(depth_best, size * outside / (outside + span))
            if cut is None:
                return depth_best
            axis, at, left, right = cut
            down, other = (left, right) if point[axis] <= at else (right, left)
            depth_best = max(depth_best, other[2] / (down[2] + 1))
            node = down


def random_cut_forest(x: np.ndarray, trees: int = 100, sample: int = 256, shingle: int = 1, contamination: float | None = None, sigmas: float = 3.0, seed: int = 42) -> Result:
    """Displacement in random cut trees, each over a random sample of the points; flagged above mean + 3 deviations, or the share given."""
    rng = np.random.default_rng(seed)
    v = _known(x)
    points = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.repeat(v[:1], shingle - 1), v]), shingle)
    raw = np.zeros(len(v))
    for _ in range(trees):
        tree = RandomCutTree(points[rng.choice(len(points), min(sample, len(points)), replace=False)], rng)
        raw += [tree.displacement(p) for p in points]
    raw /= trees
    bound = hyndman_fan(raw, 1 - contamination) if contamination else raw.mean() + sigmas * raw.std()
    center = median(v)
    return score(raw, bound), np.where(raw > bound, np.where(v >= center, 1, -1), 0)


METHODS: dict[str, Callable[..., Result]] = {
    "zscore": zscore,
    "modified-zscore": modified_zscore,
    "iqr": iqr,
    "mad": mad_fences,
    "double-mad": double_mad,
    "cusum": cusum,
    "ewma": ewma,
    "smoothed-zscore": smoothed_zscore,
    "esd": esd,
    "rcf": random_cut_forest,
}
