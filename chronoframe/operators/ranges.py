"""Range scans and time-bucket aggregation over any number of series at once.

``samples`` has the key columns (``by``), ts (long, milliseconds) and value (double), unique
by key and ts. All series of a frame are worked on in one job, partitioned by key and bucket,
so that one series of any length spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregators import COUNTER
from ..functions.numeric import nan
from ..plans.query import Aggregation, RangeQuery

BY = ("key",)
#: Empty buckets are made, and values carried into them, in runs of so many.
RUN = 4096


def in_window(query: RangeQuery) -> Column:
    w = query.window
    out = F.lit(True)
    if w.start is not None:
        out = out & (F.col("ts") >= w.start)
    if w.end is not None:
        out = out & (F.col("ts") <= w.end)
    return out


def passing(query: RangeQuery) -> Column:
    """The timestamp and value filters; NaN passes no value filter."""
    out = F.lit(True)
    if query.by_ts is not None:
        out = out & (F.col("ts").isin(*query.by_ts) if query.by_ts else F.lit(False))
    if query.by_value is not None:
        out = out & F.col("value").between(*map(float, query.by_value)) & ~F.isnan("value")
    return out


def bucket_start(ts: Column, bucket_ms: int, origin: int) -> Column:
    return ts - F.pmod(ts - F.lit(origin), F.lit(bucket_ms))


def first_rows(df: DataFrame, n: int, by: Sequence[str], order: list[Column]) -> DataFrame:
    """The first n rows of each key. Spark limits each partition before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, null keys being equal to each other; ``how`` is inner or left."""
    other = right.select(*[F.col(k).alias(f"_other_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_other_{k}"))
    return left.join(other, same, how).drop(*[f"_other_{k}" for k in keys])


def _order(query: RangeQuery) -> list[Column]:
    return [F.desc("ts") if query.reverse else F.asc("ts")]


def bucketed(samples: DataFrame, agg: Aggregation, origin: int, by: Sequence[str]) -> DataFrame:
    """(by, bucket, one column for each aggregator) of the buckets that accepted a sample."""
    df = samples.withColumn("bucket", bucket_start(F.col("ts"), agg.bucket_ms, origin))
    keys = [*by, "bucket"]
    previous = None
    if any(a.name in COUNTER for a in agg.aggregators):
        before = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_previous", F.last(F.when(~F.isnan("value"), F.struct("ts", "value")), True).over(before))
        previous = F.col("_previous")
    ts, value = F.col("ts"), F.col("value")
    out = df.groupBy(*keys).agg(*[a.value(ts, value, agg.bucket_ms, previous).alias(a.column) for a in agg.aggregators], F.bool_or(_accepted(agg, value)).alias("_accepted"))
    return out.where("_accepted").drop("_accepted")


def _accepted(agg: Aggregation, value: Column) -> Column:
    out = F.lit(False)
    for a in agg.aggregators:
        out = out | a.accepts(value)
    return out


def _filled(samples: DataFrame, buckets: DataFrame, query: RangeQuery, by: Sequence[str]) -> DataFrame:
    """Adds the empty buckets between passing data, up to the window's edges where data lies beyond them.

    ``samples`` are the samples that pass the filters, inside the window and outside.
    """
    agg, w = query.aggregation, query.window
    origin = agg.origin(w)
    inside = in_window(query)
    leads = F.lit(False) if w.start is None else F.coalesce(F.bool_or(F.col("ts") < w.start), F.lit(False))
    trails = F.lit(False) if w.end is None else F.coalesce(F.bool_or(F.col("ts") > w.end), F.lit(False))
    extent = samples.groupBy(*by).agg(leads.alias("leads"), trails.alias("trails"), F.min(F.when(inside, F.col("ts"))).alias("low"), F.max(F.when(inside, F.col("ts"))).alias("high"))
    extent = extent.where(F.col("low").isNotNull() | (F.col("leads") & F.col("trails")))
    low = F.when(F.col("leads"), F.lit(w.start)).otherwise(F.col("low"))
    high = F.when(F.col("trails"), F.lit(w.end)).otherwise(F.col("high"))
    d, run = F.lit(agg.bucket_ms).cast("long"), agg.bucket_ms * RUN
    extent = extent.select(*by, bucket_start(low, agg.bucket_ms, origin).alias("_low"), bucket_start(high, agg.bucket_ms, origin).alias("_high"))
    runs = extent.select(*by, "_low", "_high", F.explode(F.sequence(bucket_start(F.col("_low"), run, origin), bucket_start(F.col("_high"), run, origin), F.lit(run).cast("long"))).alias("_run"))
    carried = [a.column for a in agg.aggregators if a.name == "last"]
    if carried:
        # into a run goes the last value of the runs before it
        ends = buckets.groupBy(*by, bucket_start(F.col("bucket"), run, origin).alias("_run")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("bucket"))).alias(f"_end_{c}") for c in carried])
        before = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        runs = join_null_safe(runs, ends, [*by, "_run"], "left").withColumns({f"_end_{c}": F.last(f"_end_{c}", True).over(before) for c in carried})
    first, last = F.greatest("_run", "_low"), F.least(F.col("_run") + F.lit(run - agg.bucket_ms), F.col("_high"))
    spine = runs.select(*by, "_run", *[f"_end_{c}" for c in carried], F.explode(F.sequence(first, last, d)).alias("bucket"))
    full = join_null_safe(spine, buckets.withColumn("_real", F.lit(True)), [*by, "bucket"], "left")
    if carried:
        seed = F.lit(None).cast("double")
        if w.start is not None:
            first_bucket = w.start - (w.start - origin) % agg.bucket_ms
            seeds = samples.where(F.col("ts") < first_bucket).groupBy(*by).agg(F.max_by("value", "ts").alias("_seed"))
            full = join_null_safe(full, seeds, by, "left")
            seed = F.col("_seed")
        here = Window.partitionBy(*by, "_run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        for c in carried:
            full = full.withColumn(c, F.coalesce(F.last(c, True).over(here), F.col(f"_end_{c}"), seed, nan()))
    fills = {a.column: a.empty for a in agg.aggregators if a.name != "last"}
    return full.select(*by, "bucket", *[F.when(F.col("_real"), F.col(a.column)).otherwise(fills[a.column]).alias(a.column) if a.column in fills else F.col(a.column) for a in agg.aggregators])


def scan(samples: DataFrame, query: RangeQuery, by: Sequence[str] = BY) -> DataFrame:
    """The range scan: (by, ts, value), or (by, ts, one column for each aggregator) with buckets.

    Two buckets that start before 0 may be reported under the same ts 0. Rows are not sorted;
    ``query.count`` takes the first rows of each key in the query's direction.
    """
    passed = samples.select(*by, "ts", "value").where(passing(query))
    inside = passed.where(in_window(query))
    if query.aggregation is None:
        out = inside
    else:
        agg = query.aggregation
        out = bucketed(inside, agg, agg.origin(query.window), by)
        if agg.empty:
            out = _filled(passed, out, query, by)
        order = [F.desc("bucket") if query.reverse else F.asc("bucket")]
        out = first_rows(out, query.count, by, order) if query.count else out
        shown = (F.greatest(F.col("bucket"), F.lit(0).cast("long")) + F.lit(agg.report_offset)).alias("ts")
        return out.select(*by, shown, *[a.column for a in agg.aggregators])
    return first_rows(out, query.count, by, _order(query)) if query.count else out


def last_sample(samples: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The last sample of each key."""
    return samples.groupBy(*by).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def samples_at(samples: DataFrame, timestamps: Sequence[int]) -> DataFrame:
    """Point lookup; the test is pushed down to the scan."""
    return samples.where(F.col("ts").isin(*timestamps))


def tail(samples: DataFrame, n: int, by: Sequence[str] = BY) -> DataFrame:
    """The last n samples of each key."""
    return first_rows(samples, n, by, [F.desc("ts")])


def read_after(samples: DataFrame, cursor: str | int, op: str | None = None, operand: float | None = None, max_count: int | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Cursor read: a timestamp, ``-`` from the start, ``+`` the newest sample, ``$`` only what comes later."""
    from ..functions.literals import parse_timestamp
    from ..functions.numeric import compare

    if cursor in ("+", "$"):
        newest = samples.groupBy(*by).agg(F.max("ts").alias("_newest"))
        out = samples.join(newest, list(by)).where(F.col("ts") >= F.col("_newest") + F.lit(int(cursor == "$"))).drop("_newest")
    else:
        out = samples if cursor == "-" else samples.where(F.col("ts") >= parse_timestamp(cursor))
    if op:
        out = out.where(compare(op, F.col("value"), F.lit(float(operand))))
    return first_rows(out, max_count, by, [F.asc("ts")]) if max_count else out
