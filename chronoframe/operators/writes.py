"""Writing samples: duplicates, retention, ignored repeats, increments, deletion; series metadata.

Samples that arrive have an ``arrival`` number that orders them. All operators return new
DataFrames; storing them is the caller's (see ``sources.tables``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan, round_decimals, round_significant
from ..plans.query import RangeQuery
from ..plans.selectors import selector_column
from .folds import in_order
from .ranges import BY, in_window

POLICIES = ("block", "first", "last", "min", "max", "sum")


def collapse(samples: DataFrame, policy: str, by: Sequence[str] = BY) -> DataFrame:
    """One sample for each key and ts, as if all were written in order of arrival.

    block and first keep the first. min, max and sum of a number and NaN are refused, so what
    was written before stays: numbers only meet numbers if the first sample is one, and a
    first NaN stays.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    ordered = [*by, "ts"]
    if policy in ("block", "first"):
        value = F.min_by("value", "arrival")
    elif policy == "last":
        value = F.max_by("value", "arrival")
    else:
        number = F.when(~F.isnan("value"), F.col("value"))
        total = {"min": F.min, "max": F.max, "sum": F.sum}[policy](number)
        value = F.when(F.isnan(F.min_by("value", "arrival")), nan()).otherwise(total)
    return samples.groupBy(*ordered).agg(value.alias("value"))


def merge_samples(stored: DataFrame, incoming: DataFrame, policy: str = "block", by: Sequence[str] = BY) -> DataFrame:
    """Stored samples with the incoming ones (with arrival, from 0 up) written after them."""
    old = stored.select(*by, "ts", "value", F.lit(-1).cast("long").alias("arrival"))
    return collapse(old.unionByName(incoming.select(*by, "ts", "value", F.col("arrival").cast("long").alias("arrival"))), policy, by)


def blocked(stored: DataFrame, incoming: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Incoming samples that the policy block refuses: their timestamp is stored or came before."""
    keys = [*by, "ts"]
    again = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("arrival")))
    there = stored.select(*keys).withColumn("_there", F.lit(True))
    return again.join(there, keys, "left").where(F.col("_there") | (F.col("_n") > 1)).drop("_there", "_n")


def retained(samples: DataFrame, retention_ms: int, by: Sequence[str] = BY) -> DataFrame:
    """Samples no older than the retention before each key's last sample; 0 keeps all."""
    if not retention_ms:
        return samples
    last = samples.groupBy(*by).agg(F.max("ts").alias("_last"))
    return samples.join(last, list(by)).where(F.col("ts") >= F.col("_last") - retention_ms).drop("_last")


def retention_gate(incoming: DataFrame, retention_ms: int, last_ts: DataFrame | None = None, by: Sequence[str] = BY) -> DataFrame:
    """Adds accepted: whether a sample is young enough when it arrives, against the greatest ts before it."""
    before = F.max("ts").over(Window.partitionBy(*by).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    out = incoming.withColumn("_before", before)
    if last_ts is not None:
        out = out.join(last_ts.select(*by, F.col("ts").alias("_stored")), list(by), "left").withColumn("_before", F.greatest("_before", "_stored")).drop("_stored")
    young = F.col("_before").isNull() | (F.col("ts") >= F.col("_before") - retention_ms) if retention_ms else F.lit(True)
    return out.withColumn("accepted", young).drop("_before")


def drop_repeats(incoming: DataFrame, ignore_ms: int, ignore_value: float, by: Sequence[str] = BY) -> DataFrame:
    """Drops samples that follow the last kept one within both tolerances (policy last). NaN is always kept.

    What is dropped depends on the last sample that was kept, so each key is folded in order;
    rows stream through the fold, key after key, and none but the last kept is held.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_ts = last_value = None
        for rows in batches:
            keep = []
            for first, ts, value in zip(*(rows.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_first", "ts", "value")), strict=True):
                gap = None if first or last_ts is None else ts - last_ts
                drop = gap is not None and 0 <= gap <= ignore_ms and abs(value - last_value) <= ignore_value
                keep.append(not drop)
                if not drop and (gap is None or gap >= 0):
                    last_ts, last_value = ts, value
            yield rows.select(names).filter(pa.array(keep, pa.bool_()))

    names = incoming.columns
    return in_order(incoming, by, "arrival").mapInArrow(fold, incoming.schema)


def increments(stored: DataFrame, deltas: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Samples written by increments (key, ts, delta, arrival): each adds to the value before it.

    Increments start from the last stored value, or 0. One that is older than the last
    sample is refused, as are all for a series that ends with NaN; of increments at one
    timestamp the last is the value.
    """
    last = stored.groupBy(*by).agg(F.max("ts").alias("_ts"), F.max_by("value", "ts").alias("_value"))
    d = deltas.join(last, list(by), "left")
    order = Window.partitionBy(*by).orderBy("arrival")
    newest = F.greatest(F.coalesce(F.col("_ts"), F.lit(-1).cast("long")), F.coalesce(F.max("ts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1).cast("long")))
    d = d.withColumn("_ok", (F.col("ts") >= newest) & ~F.isnan(F.coalesce("_value", F.lit(0.0)))).where("_ok")
    value = F.coalesce("_value", F.lit(0.0)) + F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return collapse(d.select(*by, "ts", value.alias("value"), "arrival"), "last", by)


def rounded(samples: DataFrame, significant: int | None = None, decimals: int | None = None) -> DataFrame:
    """Rounds values on their way in, to significant digits or to decimals."""
    if significant is not None:
        return samples.withColumn("value", round_significant(F.col("value"), significant))
    return samples if decimals is None else samples.withColumn("value", round_decimals(F.col("value"), decimals))


def delete_range(samples: DataFrame, query: RangeQuery, series: DataFrame | None = None, selectors: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, deleted samples by key): in a window, of all series or those that match."""
    inside = in_window(query)
    if series is None:
        return samples.where(~inside), samples.where(inside).groupBy("key").agg(F.count(F.lit(1)).alias("deleted"))
    keys = series.where(selector_column(selectors, F.col("labels"))).select("key").withColumn("_hit", F.lit(True))
    marked = samples.join(keys, "key", "left").withColumn("_gone", F.coalesce("_hit", F.lit(False)) & inside)
    gone = marked.where("_gone").groupBy("key").agg(F.count(F.lit(1)).alias("deleted"))
    return marked.where("NOT _gone").drop("_hit", "_gone"), gone


def delete_series(series: DataFrame, samples: DataFrame, selectors: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Series and samples without the series that match."""
    keys = series.where(selector_column(selectors, F.col("labels"))).select("key")
    return series.join(keys, "key", "left_anti"), samples.join(keys, "key", "left_anti")


SERIES = "key string, labels map<string,string>, retention_ms long, duplicate_policy string, ignore_ms long, ignore_value double, significant int, decimals int"


def create_series(spark: SparkSession, key: str, labels: dict[str, str] | None = None, **options) -> DataFrame:
    """One row of series metadata; see SERIES for the options."""
    policy = options.get("duplicate_policy", "block")
    if policy not in POLICIES or len(labels or {}) > 128:
        raise ValueError("an unknown policy or too many labels")
    names = ("retention_ms", "ignore_ms", "ignore_value", "significant", "decimals")
    defaults = dict.fromkeys(names) | {"retention_ms": 0, "ignore_ms": 0, "ignore_value": 0.0}
    o = defaults | {k: v for k, v in options.items() if k in names}
    return spark.createDataFrame([(key, labels or {}, o["retention_ms"], policy, o["ignore_ms"], o["ignore_value"], o["significant"], o["decimals"])], SERIES)


def alter_series(series: DataFrame, key: str, **changes) -> DataFrame:
    """Series metadata with only the named properties of one series changed."""
    unknown = set(changes) - set(series.columns)
    if unknown:
        raise ValueError(f"unknown properties {sorted(unknown)}")
    here = F.col("key") == key
    for name, value in changes.items():
        new = F.create_map(*[F.lit(x) for kv in value.items() for x in kv]) if isinstance(value, dict) else F.lit(value)
        series = series.withColumn(name, F.when(here, new).otherwise(F.col(name)))
    return series


def series_info(series: DataFrame, samples: DataFrame) -> DataFrame:
    """Each series' metadata with its number of samples and first and last sample."""
    about = samples.groupBy("key").agg(F.count(F.lit(1)).alias("total_samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("value", "ts").alias("first_value"), F.max_by("value", "ts").alias("last_value"))
    return series.join(about, "key", "left").withColumn("total_samples", F.coalesce("total_samples", F.lit(0)))
