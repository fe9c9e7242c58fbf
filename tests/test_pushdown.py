"""The registered queries' filters reach the Parquet scan, and reading less changes no row."""

import pytest
from pyspark.sql import functions as F

from chronoframe.operators.ranges import scan
from chronoframe.plans.query import range_query
from chronoframe.queries import QUERIES
from chronoframe.sources import tables


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.partition("PushedFilters: [")[2].partition("], ReadSchema")[0] for line in plan.split("\n") if "PushedFilters" in line]


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        ("range_window", ("GreaterThanOrEqual(ts", "LessThan(ts")),
        ("range_relative", ("GreaterThanOrEqual(ts", "LessThan(ts")),
        ("revrange_count", ("LessThan(ts",)),
        ("read_cursor", ("GreaterThanOrEqual(ts",)),
        ("agg_sum", ("GreaterThanOrEqual(ts",)),
        ("mrange", ("GreaterThanOrEqual(ts", "LessThan(ts")),
        ("range_by_ts", ("GreaterThanOrEqual(l_shipdate", "LessThan(l_shipdate")),
        ("get_last", ("EqualTo(event_type,click)", "EqualTo(user_id,1)")),
        ("rule_compact", ("EqualTo(event_type,click)", "EqualTo(user_id,1)")),
        ("asof_previous", ("EqualTo(event_type,",)),
        ("join_inner", ("EqualTo(l_returnflag,",)),
    ],
)
def test_filters_of_registered_queries_are_pushed(spark, sf, name, wanted):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = pushed(QUERIES[name](spark, sf))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert found and any(all(w in f for w in wanted) for f in found), found


def test_reading_less_changes_nothing(spark, sf):
    key = lambda df: sorted(map(str, df.collect()))
    whole = tables.event_samples(spark, sf)
    edges = [r.ts for r in whole.orderBy("ts").limit(3).collect()]
    for q in (range_query(edges[0], edges[1]), range_query(edges[1], edges[1]), range_query(by_ts=edges), range_query(0, 10**17), range_query(edges[2] + 1)):
        assert key(scan(tables.event_samples(spark, sf, q), q)) == key(scan(whole, q))
    for k in ("click:1", "click:x", "view", "", "no:such:1"):
        assert key(tables.event_samples(spark, sf, key=k)) == key(whole.where(F.col("key") == k))
