"""What a range query asks for, checked when it is made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..functions.aggregators import Aggregator, parse_aggregators
from ..functions.literals import Window, parse_duration, parse_timestamp, parse_window

MAX_FILTER_TS = 128


@dataclass(frozen=True)
class Aggregation:
    """Buckets ``[align + k * bucket, ...)``; see :func:`aggregation`."""

    aggregators: tuple[Aggregator, ...]
    bucket_ms: int
    align: str | int | None = None
    report: str = "start"
    empty: bool = False

    def origin(self, window: Window) -> int:
        if self.align == "start":
            if window.start is None:
                raise ValueError("ALIGN start needs an explicit start")
            return window.start
        if self.align == "end":
            if window.end is None:
                raise ValueError("ALIGN end needs an explicit end")
            return window.end
        return self.align or 0

    @property
    def report_offset(self) -> int:
        return {"start": 0, "mid": self.bucket_ms // 2, "end": self.bucket_ms}[self.report]


def aggregation(aggregators: str | list, bucket: str | int, align: str | int | None = None, report: str = "start", empty: bool = False) -> Aggregation:
    """``report`` is start, mid or end (or ``-``, ``~``, ``+``); ``align`` start, end, a timestamp, or None for 0."""
    report = {"-": "start", "~": "mid", "+": "end", "low": "start", "high": "end"}.get(report, report)
    align = {"-": "start", "+": "end"}.get(align, align)
    if align not in (None, "start", "end"):
        align = parse_timestamp(align)
    ms = parse_duration(bucket)
    if ms <= 0 or report not in ("start", "mid", "end"):
        raise ValueError("a bucket needs a positive duration and a known timestamp kind")
    return Aggregation(tuple(parse_aggregators(aggregators)), ms, align, report, empty)


@dataclass(frozen=True)
class RangeQuery:
    window: Window = field(default_factory=Window)
    by_ts: tuple[int, ...] | None = None
    by_value: tuple[float, float] | None = None
    count: int | None = None
    aggregation: Aggregation | None = None
    reverse: bool = False


def range_query(start="-", end="+", *, now=None, by_ts=None, by_value=None, count=None, aggregate: Aggregation | None = None, reverse=False) -> RangeQuery:
    """Builds a query from literals; timestamps outside the window are dropped from ``by_ts``."""
    window = parse_window(start, end, now)
    if by_ts is not None:
        by_ts = tuple(sorted({parse_timestamp(t) for t in by_ts}))
        if not 0 < len(by_ts) <= MAX_FILTER_TS:
            raise ValueError(f"1 to {MAX_FILTER_TS} timestamps are needed")
        by_ts = tuple(t for t in by_ts if (window.start is None or t >= window.start) and (window.end is None or t <= window.end))
    if by_value is not None and any(math.isnan(v) for v in by_value):
        raise ValueError("NaN is no bound")
    if count is not None and count < 1:
        raise ValueError("COUNT must be positive")
    if aggregate:
        aggregate.origin(window)
    return RangeQuery(window, by_ts, tuple(by_value) if by_value else None, count, aggregate, reverse)
