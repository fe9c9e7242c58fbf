"""Joins of two sets of series on timestamps: equal, outer, semi, anti, and as-of.

Each side has ts, value and any further key columns ``by``; the pair of series with equal
keys are joined, all pairs in one job. As-of joins look for the nearest earlier or later
sample of the right side in a union of both sides that is windowed in chunks of time, with
the last (or first) right sample of the chunks before (or after) carried in; so one pair of
long series is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import BINARY, nan
from ..plans.query import Aggregation, RangeQuery
from .ranges import first_rows, join_null_safe, scan

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
CHUNK_MS = 86_400_000


def join_series(left: DataFrame, right: DataFrame, kind: str = "inner", by: Sequence[str] = ()) -> DataFrame:
    """(by, ts, left_value, right_value) of equal timestamps; semi and anti have left's (by, ts, value).

    Unmatched values are null.
    """
    keys = [*by, "ts"]
    if kind in ("semi", "anti"):
        return left.select(*keys, "value").join(right.select(*keys), keys, KINDS[kind])
    a = left.select(*keys, F.col("value").alias("left_value"))
    return a.join(right.select(*keys, F.col("value").alias("right_value")), keys, KINDS[kind])


def _carried(both: DataFrame, by: Sequence[str], directions: dict[str, bool], strict: bool) -> DataFrame:
    """The left rows, with a column for each of ``directions``: the right sample (ts, value) that its sweep, forward or not, saw last.

    Both sweeps go over one shuffle by key and chunk; the chunks' ends are one row a chunk.
    """
    side = F.col("_right")
    here, ends, carries = {}, [], {}
    for name, forward in directions.items():
        # at equal ts the right sample comes first in the sweep's direction, if it may match
        tie = F.desc("_is_right") if not strict else F.asc("_is_right")
        order = Window.partitionBy(*by, "_chunk").orderBy(F.asc("ts") if forward else F.desc("ts"), tie)
        here[name] = F.last(side, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        ends.append((F.max if forward else F.min)(side).alias(f"_end{name}"))
        chunks = Window.partitionBy(*by).orderBy(F.asc("_chunk") if forward else F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        carries[f"_end{name}"] = F.last(f"_end{name}", True).over(chunks)
    chunks = both.groupBy(*by, "_chunk").agg(*ends).withColumns(carries)
    out = join_null_safe(both, chunks, [*by, "_chunk"])
    return out.withColumns({name: F.coalesce(w, F.col(f"_end{name}")) for name, w in here.items()}).where(~F.col("_is_right"))


def asof_join(left: DataFrame, right: DataFrame, direction: str = "previous", tolerance_ms: int | None = None, exact: bool = True, by: Sequence[str] = (), keep_unmatched: bool = False, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """For each left sample the nearest right one: (by, ts, left_value, right_ts, right_value).

    ``direction``: previous (the latest not after), next (the earliest not before) or nearest,
    where a tie goes to the later sample if exact matches are allowed, else to the
    earlier. Without ``exact``, previous and next skip equal timestamps; nearest keeps them,
    as their distance is least. Matches further away than the tolerance count as none; no
    tolerance is no bound. Left samples without a match are dropped unless kept.
    """
    if direction not in ("previous", "next", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    sample = F.struct("ts", "value")
    none = F.lit(None).cast("struct<ts:bigint,value:double>")
    a = left.select(*by, "ts", "value", none.alias("_right"), F.lit(False).alias("_is_right"))
    b = right.select(*by, "ts", "value", sample.alias("_right"), F.lit(True).alias("_is_right"))
    both = a.unionByName(b).withColumn("_chunk", F.floor(F.col("ts") / F.lit(chunk_ms)))
    if direction == "nearest":
        swept = _carried(both, by, {"_before": True, "_after": False}, False)
        back, ahead = F.col("ts") - F.col("_before.ts"), F.col("_after.ts") - F.col("ts")
        later = ahead <= back if exact else (ahead < back) | (ahead == 0)
        found = F.when(F.col("_before").isNull() | later, F.coalesce("_after", "_before")).otherwise(F.col("_before"))
        out = swept.withColumn("_found", found)
    else:
        out = _carried(both, by, {"_found": direction == "previous"}, not exact)
    hit = F.col("_found").isNotNull()
    if tolerance_ms is not None:
        hit = hit & (F.abs(F.col("ts") - F.col("_found.ts")) <= tolerance_ms)
    match = F.when(hit, F.col("_found"))
    out = out.select(*by, "ts", F.col("value").alias("left_value"), match["ts"].alias("right_ts"), match["value"].alias("right_value"))
    return out if keep_unmatched else out.where("right_ts IS NOT NULL")


def reduce_pairs(joined: DataFrame, op: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, ts, value): a binary operator on both values, a missing one being NaN."""
    a, b = (F.coalesce(F.col(c), nan()) for c in ("left_value", "right_value"))
    return joined.select(*by, "ts", BINARY[op](a, b).alias("value"))


def joined_range(left: DataFrame, right: DataFrame, query: RangeQuery, kind: str = "inner", reduce: str | None = None, aggregate: Aggregation | None = None, by: Sequence[str] = (), **asof) -> DataFrame:
    """A join of two range scans, then optionally a binary operator and buckets over its result.

    The query's filters apply to both inputs and its count to the output. Buckets need one
    value a row: an operator, or a semi or anti join.
    """
    plain = RangeQuery(query.window, query.by_ts, query.by_value)
    a, b = scan(left, plain, by), scan(right, plain, by)
    if kind in ("semi", "anti") and reduce:
        raise ValueError("semi and anti joins have no second value to reduce")
    if aggregate and not reduce and kind not in ("semi", "anti"):
        raise ValueError("buckets need a reduced join")
    out = asof_join(a, b, by=by, **asof) if kind == "asof" else join_series(a, b, kind, by)
    if reduce:
        out = reduce_pairs(out, reduce, by)
    if aggregate:
        return scan(out, RangeQuery(query.window, count=query.count, aggregation=aggregate, reverse=query.reverse), by)
    if not query.count:
        return out
    order = F.desc("ts") if query.reverse else F.asc("ts")
    return first_rows(out, query.count, by, [order]) if by else out.orderBy(order).limit(query.count)

