"""The detectors on many series of one length at once: matrices with a series in each row.

They do what ``detectors`` does, operation by operation, and give the same numbers. Rows that
are not plain (NaN, infinite, huge) and the few whose steps can't be shared go one by one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import detectors as D
from .quantiles import ESTIMATORS

Result = tuple[np.ndarray, np.ndarray]
#: Values beyond this are left to the detectors on single series, which mind overflows.
HUGE = 1e100
#: Of fewer series than this, recursions step through one after the other.
FEW = 8
#: Values by trees that a forest steps through at once.
LANES = 400_000
#: Estimators made of medians.
SHARED = ("invariant", "simple")

#: Detectors on matrices: (scores, signs, and perhaps rows that must go one by one), or None if their options rule that out.
MATRICES = {}
#: Those that step along the series.
RECURSIONS = set()


def many(method: str, x: np.ndarray, **options) -> Result:
    """Scores and signs of series of equal length, the rows of ``x``."""
    x = np.ascontiguousarray(D._known(x) if method == "rcf" else x)
    scores, signs = np.zeros(x.shape), np.zeros(x.shape, int)
    plain = (np.abs(x) < HUGE).all(1)
    if method in MATRICES and (method not in RECURSIONS or plain.sum() >= FEW) and plain.any() and (found := MATRICES[method](x[plain], **options)) is not None:
        at = np.flatnonzero(plain)
        scores[at], signs[at] = found[:2]
        plain[at[found[2]] if len(found) > 2 else []] = False
    else:
        plain[:] = False
    for i in np.flatnonzero(~plain):
        scores[i], signs[i] = D.METHODS[method](x[i], **options)
    return scores, signs


def _middle(v: np.ndarray) -> np.ndarray:
    """Medians of sorted rows."""
    n = v.shape[1]
    h = (n - 1) * 0.5 + 1
    j = int(h)
    return v[:, j - 1] + (h - j) * (v[:, min(j, n - 1)] - v[:, j - 1])


@lru_cache(256)
def _cuts(seed: int, trees: int, n: int, d: int) -> np.ndarray:
    """What a forest over n points of d values draws for the cuts of each tree, in the order in which nodes are built.

    A tree over all points takes two draws, for axis and cut, for each of its d - 1 nodes, wherever they fall.
    """
    rng, out = np.random.default_rng(seed), np.zeros((trees, d - 1))
    for t in range(trees):
        rng.choice(n, n, replace=False)
        out[t] = rng.random(2 * (d - 1))[1::2]
    return out


def _forest(v: np.ndarray, c: np.ndarray, draws: np.ndarray) -> Result:
    """Displacement of d ascending values (rows of v, c times each) in trees of given draws, added up; rows in which a cut met the greatest value."""
    (rows, d), trees = v.shape, len(draws)
    sums = np.concatenate([np.zeros((rows, 1), int), np.cumsum(c, 1)], 1)
    row, lane, at = np.repeat(np.arange(rows), trees), np.arange(rows * trees), np.arange(d)
    values, best, draws = v[row], np.zeros((rows * trees, d)), np.tile(draws, (rows, 1))
    # nodes still to be cut, as ranges of values; the left one is on top
    start, end, top = np.zeros((rows * trees, d), np.int32), np.zeros((rows * trees, d), np.int32), np.ones(rows * trees, int)
    end[:, 0] = d
    met = np.zeros(rows * trees, bool)
    for k in range(d - 1):
        top -= 1
        i, j = start[lane, top], end[lane, top]
        low = v[row, i]
        cut = low + draws[:, k] * (v[row, j - 1] - low)
        s = (values <= cut[:, None]).sum(1)
        met |= s >= j
        s = np.minimum(s, j - 1)
        a, b, c = sums[row, i], sums[row, s], sums[row, j]
        move = np.where(at < s[:, None], ((c - b) / (b - a + 1))[:, None], ((b - a) / (c - b + 1))[:, None])
        np.maximum(best, move, out=best, where=(at >= i[:, None]) & (at < j[:, None]))
        for left, right in ((s, j), (i, s)):
            start[lane, top], end[lane, top] = left, right
            top += right - left > 1
    best, total = best.reshape(rows, trees, d), np.zeros((rows, d))
    for t in range(trees):
        total += best[:, t]
    return total, met.reshape(rows, trees).any(1)


def random_cut_forest(x: np.ndarray, trees: int = 100, sample: int = 256, shingle: int = 1, contamination: float | None = None, sigmas: float = 3.0, seed: int = 42) -> tuple[np.ndarray, ...] | None:
    rows, n = x.shape
    if n > sample or shingle != 1 or seed is None:
        return None
    order = np.argsort(x, 1, kind="stable")
    v = np.take_along_axis(x, order, 1)
    new = np.concatenate([np.ones((rows, 1), bool), v[:, 1:] != v[:, :-1]], 1)
    place, distinct = np.cumsum(new, 1) - 1, new.sum(1)
    raw, met = np.zeros(x.shape), np.zeros(rows, bool)
    for d in np.unique(distinct[distinct > 1]).tolist():
        draws, some = _cuts(seed, trees, n, d), np.flatnonzero(distinct == d)
        step = max(1, LANES // (trees * d))
        for r in (some[i : i + step] for i in range(0, len(some), step)):
            values = v[r][new[r]].reshape(len(r), d)
            counts = np.diff(np.append(np.flatnonzero(new[r]), new[r].size)).reshape(len(r), d)
            moved, met[r] = _forest(values, counts, draws)
            back = np.empty((len(r), n))
            np.put_along_axis(back, order[r], np.take_along_axis(moved, place[r], 1), 1)
            raw[r] = back / trees
    bound = np.array([D.hyndman_fan(y, 1 - contamination) for y in raw]) if contamination else raw.mean(1) + sigmas * raw.std(1)
    return D.score(raw, bound[:, None]), np.where(raw > bound[:, None], np.where(x >= _middle(v)[:, None], 1, -1), 0), met


MATRICES["rcf"] = random_cut_forest


def _nearest(v: np.ndarray, low: np.ndarray, m: int, center: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest distance from the center among m values from ``low`` on: the k nearest are neighbours in a sorted row."""
    row = np.arange(len(v))
    left, right = low.copy(), low + (m - k)
    for _ in range((m - k).bit_length()):  # to the first place whose right end is no nearer than its left
        mid = (left + right) // 2
        far = v[row, mid + k - 1] - center >= center - v[row, mid]
        left, right = np.where(far | (left >= right), left, mid + 1), np.where(far, mid, right)
    reach = lambda s: np.maximum(center - v[row, s], v[row, s + k - 1] - center)
    return np.where(left > low, np.minimum(reach(left), reach(np.maximum(left - 1, low))), reach(left))


def _hybrid(v: np.ndarray, low: np.ndarray, m: int) -> Result:
    """Median and scaled median deviation of m values from ``low`` on in sorted rows."""
    row, h = np.arange(len(v)), (m - 1) * 0.5 + 1
    j = int(h)
    first, second = v[row, low + j - 1], v[row, low + min(j, m - 1)]
    center = first + (h - j) * (second - first)
    near = _nearest(v, low, m, center, j)
    return center, 1.4826 * (near + (h - j) * (_nearest(v, low, m, center, min(j + 1, m)) - near) if h > j else near)


def esd(x: np.ndarray, alpha: float = 0.05, hybrid: bool = True, max_outliers: int | None = None) -> tuple[np.ndarray, ...] | None:
    """What remains is a run of the sorted values, so each round looks only at its ends and searches for the median deviation."""
    rows, n = x.shape
    if not hybrid or not 0 < alpha < 1 or (max_outliers is not None and max_outliers >= n / 2):
        return None
    rounds = min(n // 2 if max_outliers is None else max_outliers, n - 2)
    high_order = np.argsort(x, 1, kind="stable")
    low_order = n - 1 - np.argsort(x[:, ::-1], 1, kind="stable")  # of equal values the last goes first, from either end
    v, row = np.take_along_axis(x, high_order, 1), np.arange(rows)
    low, odd = np.zeros(rows, int), np.zeros(rows, bool)
    scores, signs, left = np.zeros(x.shape), np.zeros(x.shape, int), np.ones(x.shape, bool)
    which, sides = np.zeros((rounds, rows), int), np.zeros((rounds, rows), int)
    stats, limits = np.zeros((rounds, rows)), np.zeros(rounds)
    for k in range(rounds):
        m = n - k
        center, scale = _hybrid(v, low, m)
        last = low + m - 1
        below, above = np.abs(v[row, low] - center), np.abs(v[row, last] - center)
        at_low, at_high = low_order[row, low], high_order[row, last]
        down = (below > above) | ((below == above) & (at_low > at_high))
        far = np.maximum(below, above)
        # different values that are as far, by rounding, could go out of order
        odd |= (scale > 0) & (((below == far) & (v[row, low + 1] != v[row, low]) & (np.abs(v[row, low + 1] - center) == far)) | ((above == far) & (v[row, last - 1] != v[row, last]) & (np.abs(v[row, last - 1] - center) == far)))
        stats[k] = np.divide(far, scale, out=np.zeros(rows), where=scale > 0)
        limits[k] = D.esd_limit(alpha, m)
        which[k], sides[k] = np.where(down, at_low, at_high), np.where(np.where(down, v[row, low], v[row, last]) > center, 1, -1)
        left[row[scale > 0], which[k][scale > 0]] = False  # once it is 0, no later value is rejected or scores
        low = low + down
    over = stats > limits[:, None]
    kept = np.where(over.any(0), rounds - np.argmax(over[::-1], 0), 0) if rounds else np.zeros(rows, int)
    for k in range(rounds):
        r = np.flatnonzero(stats[k] > 0)
        flagged, at = k < kept[r], kept[r] - 1
        scores[r, which[k, r]] = D.score(np.where(flagged, np.maximum(stats[k, r], stats[at, r]), stats[k, r]), np.where(flagged, limits[at], limits[k]))
        signs[r, which[k, r]] = np.where(flagged, sides[k, r], 0)
    center, scale = _hybrid(v, low, n - rounds)
    stats = np.divide(np.abs(x - center[:, None]), scale[:, None], out=np.zeros(x.shape), where=(scale[:, None] > 0) & left)
    rest = D.score(stats, np.maximum(limits[-1] if rounds else 0.0, stats.max(1))[:, None])
    return np.where(left, rest, scores), signs, odd


MATRICES["esd"] = esd


def double_mad(x: np.ndarray, k: float = 3.0, estimator: str = "invariant") -> Result | None:
    if estimator not in SHARED:
        return None
    v, n, row = np.sort(x, 1), x.shape[1], np.arange(len(x))
    center, factor = _middle(v), ESTIMATORS[estimator][1](n)

    def spread(count: np.ndarray, place) -> np.ndarray:
        """The median distance of ``count`` values on one side; ``place`` of the i-th nearest to the center."""
        h = (count - 1) * 0.5 + 1
        j = h.astype(int)
        first, second = (np.abs(v[row, place(i)] - center) for i in (j - 1, np.minimum(j, count - 1)))
        return factor * (first + (h - j) * (second - first))

    below, above = (v <= center[:, None]).sum(1), (v >= center[:, None]).sum(1)
    low, high = center - k * spread(below, lambda i: below - 1 - i), center + k * spread(above, lambda i: n - above + i)
    return D._fenced(x, center[:, None], low[:, None], high[:, None])


MATRICES["double-mad"] = double_mad


def _baseline(x: np.ndarray) -> Result:
    first = np.ascontiguousarray(x[:, : min(x.shape[1] // 2, 100)])
    return first.mean(1), first.std(1, ddof=1) if first.shape[1] > 1 else np.zeros(len(x))


def ewma(x: np.ndarray, alpha: float = 0.3, multiplier: float = 3.0) -> Result:
    target, sigma = _baseline(x)
    level, levels = target, np.zeros(x.shape)
    for i, v in enumerate(np.ascontiguousarray(x.T)):
        level = alpha * v + (1 - alpha) * level
        levels[:, i] = level
    steps = np.arange(1, x.shape[1] + 1)
    limit = multiplier * np.sqrt((sigma * sigma * alpha / (2 - alpha))[:, None] * (1 - (1 - alpha) ** (2 * steps)))
    limit = np.where(limit <= D.EPSILON, np.nan, limit)
    d = levels - target[:, None]
    return D.score(np.abs(d), limit), np.where(np.abs(d) > limit, np.sign(d), 0).astype(int)


MATRICES["ewma"] = ewma
RECURSIONS.add("ewma")


def smoothed_zscore(x: np.ndarray, threshold: float = 3.5, influence: float = 0.0, lag: int = 10) -> Result | None:
    n = x.shape[1]
    if lag < 1 or lag >= n or not 0 <= influence <= 1 or not (np.isfinite(threshold) and threshold >= 0):
        return None
    scores, signs = np.zeros(x.shape), np.zeros(x.shape, int)
    window = x[:, :lag].copy()
    before = window[:, -1]
    for i in range(lag, n):
        v, mean, reach = x[:, i], window.mean(1), threshold * window.std(1)
        d = np.abs(v - mean)
        scores[:, i] = D.score(d, reach)
        signs[:, i] = np.where(d > reach, np.where(v > mean, 1, -1), 0)
        before = np.where(d > reach, influence * v + (1 - influence) * before, v)
        window[:, (i - lag) % lag] = before
    return scores, signs


MATRICES["smoothed-zscore"] = smoothed_zscore
RECURSIONS.add("smoothed-zscore")


def _mad(v: np.ndarray, center: np.ndarray, estimator: str) -> np.ndarray:
    return ESTIMATORS[estimator][1](v.shape[1]) * _middle(np.sort(np.abs(v - center[:, None]), 1))


def mad_fences(x: np.ndarray, k: float = 3.0, estimator: str = "invariant") -> Result | None:
    if estimator not in SHARED:
        return None
    v = np.sort(x, 1)
    center = _middle(v)
    reach = k * _mad(v, center, estimator)
    return D._fenced(x, center[:, None], (center - reach)[:, None], (center + reach)[:, None])


def modified_zscore(x: np.ndarray, threshold: float = 3.5) -> Result:
    v = np.sort(x, 1)
    center = _middle(v)
    reach = threshold * _mad(v, center, "invariant") / 0.6745
    return D._fenced(x, center[:, None], (center - reach)[:, None], (center + reach)[:, None])


MATRICES |= {"mad": mad_fences, "modified-zscore": modified_zscore}


def cusum(x: np.ndarray, k: float = 0.5, h: float = 5.0) -> Result:
    target, std = _baseline(x)
    usable = std > D.EPSILON
    up, down = np.zeros(x.shape), np.zeros(x.shape)
    a = b = np.zeros(len(x))
    for i, d in enumerate(np.ascontiguousarray(((x - target[:, None]) / np.where(usable, std, 1.0)[:, None]).T)):
        a, b = np.maximum(0.0, a + d - k), np.maximum(0.0, b - d - k)
        up[:, i], down[:, i] = a, b
    u = usable[:, None]
    return np.where(u, D.score(np.maximum(up, down), h), 0.0), np.where(u & (up > h), 1, np.where(u & (down > h), -1, 0))


MATRICES["cusum"] = cusum
RECURSIONS.add("cusum")
