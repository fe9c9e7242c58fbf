"""Seasonal adjustment: STL and MSTL by local regression, and periods by spectral density."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def loess(y: np.ndarray, width: int, weights: np.ndarray | None = None, degree: int = 1, at: np.ndarray | None = None) -> np.ndarray:
    """Local regression with tricube weights over the ``width`` nearest points of an even grid."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else at
    w = np.ones(n) if weights is None else weights
    q = min(width, n)
    left = np.clip(np.floor(at - (q - 1) / 2).astype(int), 0, n - q)
    index = left[:, None] + np.arange(q)
    d = np.abs(index - at[:, None])
    reach = d.max(1, keepdims=True) + (max(0, width - n) // 2) + 1e-12
    k = np.clip(1 - (d / (reach * 1.001)) ** 3, 0, None) ** 3 * w[index]
    total = k.sum(1, keepdims=True)
    k = np.where(total > 0, k / np.where(total > 0, total, 1), 1 / q)
    mean_y = (k * y[index]).sum(1)
    if degree == 0:
        return mean_y
    mean_x = (k * index).sum(1)
    dx = index - mean_x[:, None]
    var = (k * dx * dx).sum(1)
    slope = np.where(var > 1e-9, (k * dx * y[index]).sum(1) / np.where(var > 1e-9, var, 1), 0)
    return mean_y + slope * (at - mean_x)


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(y, np.ones(n) / n, "valid")


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n + 1 - n % 2


def stl(y: np.ndarray, period: int, robust: bool = True, seasonal_width: int = 7, outer: int = 6, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seasonal, trend, remainder) of Cleveland's decomposition."""
    n = len(y)
    if period < 2 or n < 2 * period:
        raise ValueError("two whole periods are needed")
    trend_width, low_width = _odd(1.5 * period / (1 - 1.5 / seasonal_width)), _odd(period)
    weights, trend, seasonal = np.ones(n), np.zeros(n), np.zeros(n)
    for _ in range(outer if robust else 1):
        for _ in range(inner):
            cycle = np.zeros(n + 2 * period)
            detrended = y - trend
            for p in range(period):
                part = detrended[p::period]
                cycle[p::period] = loess(part, seasonal_width, weights[p::period], at=np.arange(-1, len(part) + 1, dtype=float))
            low = loess(_moving(_moving(_moving(cycle, period), period), 3), low_width)
            seasonal = cycle[period : period + n] - low
            trend = loess(y - seasonal, trend_width, weights)
        rest = y - seasonal - trend
        h = 6 * np.median(np.abs(rest))
        weights = np.clip(1 - (np.abs(rest) / h) ** 2, 0, None) ** 2 if h > 0 else np.ones(n)
    return seasonal, trend, y - seasonal - trend


def mstl(y: np.ndarray, periods: Sequence[int], iterations: int = 2) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(a seasonal part for each period, trend, remainder), the periods fitted in turn."""
    periods = sorted(set(periods))
    parts, trend = [np.zeros(len(y)) for _ in periods], np.zeros(len(y))
    rest = y.copy()
    for _ in range(iterations):
        for i, p in enumerate(periods):
            rest = rest + parts[i]
            parts[i], trend, _ = stl(rest, p)
            rest = rest - parts[i]
    return parts, trend, rest - trend


def periods_of(y: np.ndarray, most: int = 4, threshold: float = 0.1) -> list[int]:
    """Periods of the peaks of Welch's spectral density that hold enough of the whole, strongest first."""
    n = len(y)
    size = min(n, 1 << max(3, int(np.log2(max(n, 8)))))
    x = y - np.polyval(np.polyfit(np.arange(n), y, 1), np.arange(n))
    window = np.hanning(size)
    spectra = [np.abs(np.fft.rfft(x[s : s + size] * window)) ** 2 for s in range(0, n - size + 1, max(1, size // 2))]
    power = np.mean(spectra, axis=0)
    power[0] = 0
    if not power.sum() > 0:
        return []
    share = power / power.sum()
    peaks = [i for i in range(1, len(share) - 1) if share[i] >= share[i - 1] and share[i] > share[i + 1] and share[i] >= threshold]
    found = [int(round(size / i)) for i in sorted(peaks, key=lambda i: -share[i])]
    return list(dict.fromkeys(p for p in found if 2 <= p <= n // 2))[:most]


def adjusted(y: np.ndarray, periods: Sequence[int] | str) -> np.ndarray:
    """The remainder without season and trend; ``auto`` finds the periods, and none change nothing."""
    periods = periods_of(y) if periods == "auto" else [p for p in periods]
    if not periods:
        return y
    if len(y) < 2 * max(periods):
        raise ValueError("two whole periods are needed")
    filled = np.where(np.isnan(y), np.nanmean(y), y)
    return stl(filled, periods[0])[2] if len(periods) == 1 else mstl(filled, periods)[2]
