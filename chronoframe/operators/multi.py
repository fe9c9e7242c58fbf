"""Queries over many series chosen by labels: range, last sample, grouping, pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregators import ORDERED, parse_aggregator
from ..functions.numeric import nan
from ..plans.query import RangeQuery
from ..plans.selectors import selector_column
from .ranges import first_rows, last_sample, scan


def select_series(series: DataFrame, selectors: Sequence[str], check: bool = True) -> DataFrame:
    """The rows of ``series`` (key, labels) that all selectors match."""
    return series.where(selector_column(selectors, F.col("labels"), check))


def having_samples(series: DataFrame, samples: DataFrame, query: RangeQuery, negate: bool = False) -> DataFrame:
    """Series with (or without) a sample in the query's window."""
    from .ranges import in_window

    return series.join(samples.where(in_window(query)).select("key"), "key", "left_anti" if negate else "left_semi")


def with_labels(rows: DataFrame, series: DataFrame, selected: Sequence[str] | None = None) -> DataFrame:
    """Adds labels: all, or the selected ones, empty where a series lacks one."""
    labels = F.col("labels")
    if selected is not None:
        labels = F.map_from_arrays(F.array(*[F.lit(n) for n in selected]), F.array(*[F.coalesce(F.try_element_at("labels", F.lit(n)), F.lit("")) for n in selected]))
    return rows.join(series.select("key", labels.alias("labels")), "key")


def multi_range(samples: DataFrame, series: DataFrame, selectors: Sequence[str], query: RangeQuery, keep_empty: bool = False) -> DataFrame:
    """The range scan of every matching series: (key, ts, ...). Kept empty series have one row with a null ts."""
    keys = select_series(series, selectors).select("key")
    out = scan(samples.join(keys, "key", "left_semi"), query)
    return keys.join(out, "key", "left") if keep_empty else out


def multi_get(samples: DataFrame, series: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """The last sample of every matching series that has one."""
    return last_sample(samples.join(select_series(series, selectors).select("key"), "key", "left_semi"))


def group_range(samples: DataFrame, series: DataFrame, selectors: Sequence[str], query: RangeQuery, label: str, reducer: str, sources: bool = False) -> DataFrame:
    """The range scans of all series with one value of a label, reduced where they share a timestamp.

    Returns (group, ts, the scan's columns), group being ``label=value``; series without the
    label are left out. ``query.count`` counts reduced rows. With ``sources``, a column
    names the keys of the group.
    """
    agg = parse_aggregator(reducer)
    if agg.name in ORDERED:
        raise ValueError(f"{agg.name} can't reduce several series")
    group = F.concat(F.lit(f"{label}="), F.element_at("labels", label)).alias("group")
    chosen = select_series(series, selectors).where(F.coalesce(F.try_element_at("labels", F.lit(label)), F.lit("")) != "").select("key", group)
    whole = RangeQuery(query.window, query.by_ts, query.by_value, None, query.aggregation, query.reverse)
    rows = scan(samples.join(chosen, "key"), whole, ("group", "key"))
    columns = [c for c in rows.columns if c not in ("group", "key", "ts")]
    out = rows.groupBy("group", "ts").agg(*[agg.value(F.col("ts"), F.col(c)).alias(c) for c in columns])
    if query.count:
        out = first_rows(out, query.count, ["group"], [F.desc("ts") if query.reverse else F.asc("ts")])
    if sources:
        names = chosen.groupBy("group").agg(F.array_join(F.sort_array(F.collect_set("key")), ",").alias("source"))
        out = out.join(names, "group").withColumn("reducer", F.lit(agg.name))
    return out


def pivot(samples: DataFrame, keys: Sequence[str], query: RangeQuery) -> DataFrame:
    """An outer join of the scans of some series on ts: one block of columns for each key, in order.

    A key may be named twice. Gaps are NaN; ``query.count`` counts joined rows. Columns are
    ``v0``, ``v1``, ... or with buckets ``v0_avg``, ...
    """
    whole = RangeQuery(query.window, query.by_ts, query.by_value, None, query.aggregation, query.reverse)
    rows = scan(samples.where(F.col("key").isin(*set(keys))), whole)
    columns = [c for c in rows.columns if c not in ("key", "ts")]
    name = lambda i, c: f"v{i}" if c == "value" else f"v{i}_{c}"
    cells = [F.coalesce(F.max(F.when(F.col("key") == k, F.col(c))), nan()).alias(name(i, c)) for i, k in enumerate(keys) for c in columns]
    out = rows.groupBy("ts").agg(*cells)
    return out.orderBy(F.desc("ts") if query.reverse else F.asc("ts")).limit(query.count) if query.count else out


def merge_streams(*frames: DataFrame) -> DataFrame:
    """All samples of several frames with the number of the frame they come from."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn("source", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out
