import time

import pytest
from pyspark.sql import functions as F

from chronoframe.functions.literals import parse_duration
from chronoframe.sources.tables import read_samples, write_samples
from chronoframe.streaming import rules as R
from chronoframe.streaming.tail import blocking_read, tail_stream

SCHEMA = "key string, ts long, value double, arrival long"


def test_rules_are_checked():
    a, b = R.rule("s", "d", "avg", "1m"), R.rule("d", "e", "max", "5m")
    assert R.ordered_rules([b, a]) == [a, b] and R.drop_rule([a, b], "d", "e") == [a]
    for bad in ([a, R.rule("d", "s", "sum", "1m")], [a, R.rule("x", "d", "sum", "1m")]):
        with pytest.raises(ValueError):
            R.ordered_rules(bad)
    auto = R.auto_rules("k", "avg:1m:1h;max:1h:0:10s")
    assert [(r.dest, r.bucket_ms, r.retention_ms, r.align) for r in auto] == [("k_AVG_60000", 60_000, parse_duration("1h"), 0), ("k_MAX_3600000_10000", 3_600_000, 0, 10_000)]


def test_stream_with_late_data_and_chain(spark, tmp_path):
    batches = [[("s", 0, 1.0, 0), ("s", 500, 3.0, 1), ("s", 1200, 5.0, 2)], [("s", 2500, 7.0, 3), ("s", 700, 9.0, 4), ("s", 6100, 1.0, 5)], [("s", 100, 100.0, 6), ("s", 9000, 2.0, 7)]]
    rules = [R.rule("s", "d", "sum", 1000), R.rule("d", "e", "max", 3000)]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        R.start_compaction(stream, rules, str(tmp_path / "s"), str(tmp_path / "d"), str(tmp_path / "c")).awaitTermination(120)
    newest = max(tmp_path.glob("d/v=*"), key=lambda p: int(p.name[2:]))
    got = sorted((r.key, r.ts, r.value) for r in spark.read.parquet(str(newest)).collect())
    everything = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    expected = sorted((r.key, r.ts, r.value) for r in R.compact_all(everything, rules).collect())
    assert got == expected == [("d", 0, 113.0), ("d", 1000, 5.0), ("d", 2000, 7.0), ("d", 6000, 1.0), ("e", 0, 113.0)]


def test_refresh_after_deletion(spark):
    s = spark.createDataFrame([("s", t, float(t)) for t in (0, 500, 1500, 2500, 3500)], "key string, ts long, value double")
    r = R.rule("s", "d", "sum", 1000)
    gone = s.where("ts IN (500, 1500)")
    left = s.where("ts NOT IN (500, 1500)")
    assert sorted((x.ts, x.value) for x in R.refresh(R.compact(s, r), left, gone, r).collect()) == [(0, 0.0), (2000, 2500.0)]


def test_tail_and_blocking_read(spark, tmp_path):
    s = spark.createDataFrame([("k", t, float(t)) for t in range(5)], "key string, ts long, value double")
    write_samples(s, str(tmp_path / "x"))
    load = lambda: read_samples(spark, str(tmp_path / "x"))
    assert blocking_read(load, 3, min_count=2).count() == 2
    began = time.monotonic()
    assert blocking_read(load, "$", timeout_ms=300).count() == 0 and time.monotonic() - began >= 0.3
    stream = spark.readStream.schema("key string, ts long, value double").parquet(str(tmp_path / "x"))
    q = tail_stream(stream, 1, ">", 2).writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.ts for r in spark.table("tail").collect()) == [3, 4]
    assert s.where(F.col("ts") > 3).count() == 1


def test_filters_and_columns_reach_the_scan(spark, tmp_path, capsys):
    from chronoframe.operators.ranges import scan
    from chronoframe.plans.query import aggregation, range_query

    s = spark.createDataFrame([("k", t, float(t)) for t in range(5)], "key string, ts long, value double")
    write_samples(s, str(tmp_path / "x"))
    q = range_query(1, 3, by_value=(0, 9), aggregate=aggregation("avg", 2))
    scan(read_samples(spark, str(tmp_path / "x")).where("key = 'k'"), q).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(ts,1)" in plan and "LessThanOrEqual(ts,3)" in plan and "EqualTo(key,k)" in plan
    assert plan.count("Exchange") <= 4 and "Python" not in plan
