"""Down-sampling rules: buckets of a source series kept as samples of a destination series.

A rule publishes a bucket when a later one begins; samples that come late recompute their
bucket from the stored source, however old it is, and replace its destination sample. In a
stream each micro-batch appends to the stored source and recomputes the buckets it touches;
there is no watermark that would drop late rows, retention being the only bound.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregators import Aggregator, parse_aggregator
from ..functions.literals import parse_duration
from ..operators.ranges import bucket_start, bucketed, last_sample
from ..operators.writes import merge_samples
from ..plans.query import Aggregation


@dataclass(frozen=True)
class Rule:
    source: str
    dest: str
    aggregator: Aggregator
    bucket_ms: int
    align: int = 0
    retention_ms: int = 0

    @property
    def aggregation(self) -> Aggregation:
        return Aggregation((replace(self.aggregator, alias="value"),), self.bucket_ms, self.align)


def rule(source: str, dest: str, aggregator: str, bucket: str | int, align: int = 0, retention: str | int = 0) -> Rule:
    if source == dest:
        raise ValueError("a rule needs two series")
    return Rule(source, dest, parse_aggregator(aggregator), parse_duration(bucket), align, parse_duration(retention))


def ordered_rules(rules: Sequence[Rule]) -> list[Rule]:
    """Rules with every one behind those that write its source; a cycle, or two rules for one destination, is an error."""
    if len({r.dest for r in rules}) < len(rules):
        raise ValueError("two rules write one series")
    left, out = list(rules), []
    while left:
        ready = [r for r in left if all(r.source != o.dest for o in left)]
        if not ready:
            raise ValueError("the rules form a cycle")
        out += ready
        left = [r for r in left if r not in ready]
    return out


def add_rule(rules: Sequence[Rule], new: Rule) -> list[Rule]:
    return ordered_rules([*rules, new])


def drop_rule(rules: Sequence[Rule], source: str, dest: str) -> list[Rule]:
    left = [r for r in rules if (r.source, r.dest) != (source, dest)]
    if len(left) == len(rules):
        raise ValueError("no such rule")
    return left


def auto_rules(key: str, policies: str) -> list[Rule]:
    """Rules from ``aggregator:bucket:retention[:align]`` items separated by ``;`` or ``|``; destinations are ``key_AGG_bucket[_align]``."""
    out = []
    for item in filter(None, re.split(r"[;|]", policies)):
        name, bucket, *rest = item.strip().split(":")
        retention, align = (rest + ["0", ""])[:2] if len(rest) < 2 else rest[:2]
        ms, shift = parse_duration(bucket), parse_duration(align) if align else 0
        dest = f"{key}_{name.upper()}_{ms}" + (f"_{shift}" if shift else "")
        out.append(rule(key, dest, name.lower(), ms, shift, retention))
    return out


def open_buckets(samples: DataFrame, r: Rule) -> DataFrame:
    """(key, start) of the bucket that a source's last sample is in, which is not published yet."""
    last = last_sample(samples.where(F.col("key") == r.source))
    return last.select("key", bucket_start(F.col("ts"), r.bucket_ms, r.align).alias("start"))


def compact(samples: DataFrame, r: Rule, include_open: bool = False) -> DataFrame:
    """The destination samples (key, ts, value) of a rule, from all source samples."""
    mine = samples.where(F.col("key") == r.source)
    buckets = bucketed(mine, r.aggregation, r.align, ["key"])
    if not include_open:
        buckets = buckets.join(open_buckets(mine, r), "key").where(F.col("bucket") < F.col("start"))
    return buckets.select(F.lit(r.dest).alias("key"), F.greatest("bucket", F.lit(0).cast("long")).alias("ts"), "value")


def compact_all(samples: DataFrame, rules: Sequence[Rule], include_open: bool = False) -> DataFrame:
    """Destinations of chained rules, each computed from its source, which may be a destination itself."""
    out = samples.limit(0).select("key", "ts", "value")
    for r in ordered_rules(rules):
        out = out.unionByName(compact(samples.select("key", "ts", "value").unionByName(out), r, include_open))
    return out


def latest(dest: DataFrame, samples: DataFrame, r: Rule) -> DataFrame:
    """A rule's stored destination samples with the open bucket's as the last one."""
    mine = samples.where(F.col("key") == r.source)
    buckets = bucketed(mine, r.aggregation, r.align, ["key"]).join(open_buckets(mine, r), "key").where(F.col("bucket") == F.col("start"))
    now = buckets.select(F.lit(r.dest).alias("key"), F.greatest("bucket", F.lit(0).cast("long")).alias("ts"), "value")
    return dest.where(F.col("key") == r.dest).unionByName(now)


def touched(batch: DataFrame, r: Rule) -> DataFrame:
    """The buckets of a rule that a batch of new, changed or deleted samples falls into."""
    return batch.where(F.col("key") == r.source).select(bucket_start(F.col("ts"), r.bucket_ms, r.align).alias("bucket")).distinct()


def refresh(dest: DataFrame, samples: DataFrame, batch: DataFrame, r: Rule) -> DataFrame:
    """A rule's destination after a batch: only touched buckets are recomputed from the stored source.

    ``samples`` is the source as it is after the batch. Deleted samples are passed as a
    batch too; a bucket that is left empty goes. The bucket that was open before the batch
    is published once a later one begins, so it counts as touched.
    """
    mine = samples.where(F.col("key") == r.source)
    published = dest.where(F.col("key") == r.dest).agg(F.max("ts")).first()[0]
    start = bucket_start(F.col("ts"), r.bucket_ms, r.align)
    since = (mine if published is None else mine.where(start > published)).select(start.alias("bucket"))
    changed = touched(batch, r).unionByName(since).distinct()
    fresh = compact(mine.join(changed, start == F.col("bucket"), "left_semi"), r, include_open=True)
    border = open_buckets(mine, r).first()
    fresh = fresh.where(F.col("ts") < border.start) if border else fresh.limit(0)
    kept = dest.join(changed.select(F.greatest("bucket", F.lit(0).cast("long")).alias("ts")), "ts", "left_anti")
    return kept.select("key", "ts", "value").unionByName(fresh)


def start_compaction(stream: DataFrame, rules: Sequence[Rule], samples_path: str, dest_path: str, checkpoint: str, policy: str = "last", available_now: bool = True):
    """Runs rules over a stream of samples (key, ts, value, arrival). Returns the streaming query.

    Samples and destinations are stored as Parquet versions ``v=<batch>`` under their paths;
    a batch that is run again writes the version it wrote before.
    """
    rules = ordered_rules(rules)

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        load = lambda path: _version(spark, path, number - 1)
        stored, dest = load(samples_path), load(dest_path)
        merge_samples(stored, batch, policy).write.mode("overwrite").parquet(f"{samples_path}/v={number}")
        samples, changes = _version(spark, samples_path, number), batch.select("key", "ts", "value")
        out = None
        for r in rules:
            part = refresh(dest.where(F.col("key") == r.dest), samples if out is None else samples.unionByName(out), changes if out is None else changes.unionByName(out), r)
            out = part if out is None else out.unionByName(part)
        out.write.mode("overwrite").parquet(f"{dest_path}/v={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _version(spark, path: str, number: int) -> DataFrame:
    schema = "key string, ts long, value double"
    return spark.createDataFrame([], schema) if number < 0 else spark.read.schema(schema).parquet(f"{path}/v={number}")
