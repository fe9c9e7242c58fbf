"""Tail reads: waiting for samples that match, from a cursor on."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import compare
from ..operators.ranges import read_after


def tail_stream(stream: DataFrame, cursor: int, op: str | None = None, operand: float | None = None) -> DataFrame:
    """The samples of a stream at or after a cursor that a condition accepts."""
    out = stream.where(F.col("ts") >= cursor)
    return out.where(compare(op, F.col("value"), F.lit(float(operand)))) if op else out


def blocking_read(load: Callable[[], DataFrame], cursor: str | int, min_count: int = 1, timeout_ms: int = 0, max_count: int | None = None, op: str | None = None, operand: float | None = None, poll_ms: int = 100) -> DataFrame:
    """Waits until ``min_count`` samples match, or the timeout gives what there is.

    ``load`` gives the stored samples of one series. ``+`` and ``$`` are resolved once, at the call.
    """
    if cursor in ("+", "$"):
        newest = load().agg(F.max("ts")).first()[0]
        cursor = 0 if newest is None else newest + (cursor == "$")
    deadline = time.monotonic() + timeout_ms / 1000
    while True:
        found = read_after(load(), cursor, op, operand, max_count)
        if found.limit(min_count).count() >= min_count or time.monotonic() >= deadline:
            return found
        time.sleep(poll_ms / 1000)
