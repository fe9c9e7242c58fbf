"""Series and samples made from tables, and their storage as Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.writes import collapse
from ..plans.query import RangeQuery

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp without time zone, taken as UTC."""
    return F.unix_millis(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def _instant(ms: int) -> Column | None:
    """The timestamp without time zone, in UTC, of milliseconds since the epoch; None beyond the years 1 to 9999."""
    try:
        return F.lit((_EPOCH + timedelta(milliseconds=ms)).strftime("%Y-%m-%d %H:%M:%S.%f").rjust(26, "0")).cast("timestamp_ntz")
    except OverflowError:
        return None


def in_time(ts: Column, query: RangeQuery | None) -> Column:
    """What a query's window and timestamps ask of a timestamp column itself, so that the scan can skip what is outside.

    Buckets that are filled where they are empty need samples outside the window, so all are read for those.
    """
    out = F.lit(True)
    if query is None or query.aggregation and query.aggregation.empty:
        return out
    low, high = query.window.start, query.window.end
    if query.by_ts:
        low, high = max(query.by_ts[0], query.by_ts[0] if low is None else low), min(query.by_ts[-1], query.by_ts[-1] if high is None else high)
    if low is not None and (first := _instant(low)) is not None:
        out = out & (ts >= first)
    if high is not None and (after := _instant(high + 1)) is not None:
        out = out & (ts < after)
    return out


def _made_of(first: Column, second: Column, sep: str, key: str) -> Column:
    """Whether two columns, of which the second may be a number, can make a key: a test of the columns themselves."""
    out = F.lit(False)
    for i in range(len(key) - len(sep) + 1):
        if key[i : i + len(sep)] == sep:
            a, b = key[:i], key[i + len(sep) :]
            out = out | (first == a) & (second == b)
    return out


def samples_from(df: DataFrame, key: Column, ts: Column, value: Column) -> DataFrame:
    return df.select(key.alias("key"), ts.alias("ts"), value.cast("double").alias("value"))


def event_samples(spark: SparkSession, sf_dir: str, query: RangeQuery | None = None, key: str | None = None, kind: str | None = None) -> DataFrame:
    """Events as series ``event_type:user_id``; of several events in one millisecond the one with the greatest id counts.

    ``query``, ``key`` and ``kind`` (an event type) say what will be asked for, so that only that is read.
    """
    e = read(spark, sf_dir, "events").where("ts IS NOT NULL AND value IS NOT NULL").where(in_time(F.col("ts"), query))
    if kind is not None:
        e = e.where(F.col("event_type") == kind)
    if key is not None and (parts := key.rpartition(":"))[2].isdecimal():
        e = e.where((F.col("event_type") == parts[0]) & (F.col("user_id") == int(parts[2])))
    name = F.concat_ws(":", "event_type", "user_id")
    rows = e.select(name.alias("key"), millis(F.col("ts")).alias("ts"), "value", F.col("event_id").alias("arrival"))
    return collapse(rows if key is None else rows.where(F.col("key") == key), "last")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, labels) of the event series: name is the event type, user the id, tier its remainder by 3."""
    e = read(spark, sf_dir, "events").where("ts IS NOT NULL AND value IS NOT NULL").select("event_type", "user_id").distinct()
    user = F.col("user_id").cast("string")
    tier = F.concat(F.lit("t"), F.pmod("user_id", F.lit(3)).cast("string"))
    labels = F.map_from_arrays(F.array(F.lit("__name__"), F.lit("user"), F.lit("tier")), F.array("event_type", user, tier))
    return e.select(F.concat_ws(":", "event_type", "user_id").alias("key"), labels.alias("labels"))


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as series by priority; prices of one day are summed up."""
    o = read(spark, sf_dir, "orders")
    rows = samples_from(o, F.col("o_orderpriority"), millis(F.col("o_orderdate")), F.col("o_totalprice"))
    return collapse(rows.withColumn("arrival", F.lit(0).cast("long")), "sum")


def lineitem_samples(spark: SparkSession, sf_dir: str, query: RangeQuery | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Quantities as series by return flag and line status; of one day the greatest counts.

    ``query`` and ``keys`` say what will be asked for, so that only that is read.
    """
    i = read(spark, sf_dir, "lineitem").where(in_time(F.col("l_shipdate"), query))
    rows = samples_from(i, F.concat("l_returnflag", "l_linestatus"), millis(F.col("l_shipdate")), F.col("l_quantity"))
    if keys is not None:
        some = F.lit(False)
        for k in keys:
            some = some | _made_of(F.col("l_returnflag"), F.col("l_linestatus"), "", k)
        rows = samples_from(i.where(some), F.concat("l_returnflag", "l_linestatus"), millis(F.col("l_shipdate")), F.col("l_quantity"))
    return collapse(rows.withColumn("arrival", F.lit(0).cast("long")), "max")


def write_samples(samples: DataFrame, path: str, sort_within: Sequence[str] = ("key", "ts")) -> None:
    """Parquet in ranges of (key, ts), sorted, so that key and time filters skip files and row groups."""
    samples.repartitionByRange(*sort_within).sortWithinPartitions(*sort_within).write.mode("overwrite").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, ts long, value double").parquet(path)
