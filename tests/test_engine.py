"""Hand-computed fixtures for what the driver's tables don't hold: NaN, gaps, ties, edges."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoframe.functions.aggregators import Aggregator, parse_aggregator, parse_aggregators
from chronoframe.functions.numeric import BINARY, round_significant
from chronoframe.functions.strings import jaro_winkler, subsequence
from chronoframe.operators import labels, multi, writes
from chronoframe.operators.joins import asof_join, join_series, joined_range
from chronoframe.operators.ranges import read_after, scan
from chronoframe.plans.query import aggregation, range_query
from chronoframe.plans.selectors import SelectorError, parse_selector, parse_selectors
from chronoframe.sources.json_bulk import parse_bulk

NAN = float("nan")


def samples(spark, *rows, key="k"):
    return spark.createDataFrame([(key, t, float(v)) for t, v in rows], "key string, ts long, value double")


def out(df, *columns):
    def show(v):
        return None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else v

    return [tuple(show(r[c]) for c in columns) for r in df.orderBy("ts").collect()]


def test_aggregators_on_a_counter_with_reset_and_nan(spark):
    s = samples(spark, (0, 10), (1000, NAN), (2000, 14), (3000, 3), (4000, 5))
    row = scan(s, range_query(aggregate=aggregation("increase,rate,irate,count,countall,countnan,first,last,std.s,range", 10_000))).first()
    assert (row["increase"], row["rate"], row["irate"]) == (6.0, 0.6, 2.0)
    assert (row["count"], row["countall"], row["countnan"], row["first"], row["last"], row["range"]) == (4.0, 5.0, 1.0, 10.0, 5.0, 11.0)


def test_counter_edges(spark):
    row = scan(samples(spark, (0, 10), (400, 3)), range_query(aggregate=aggregation("rate,irate", 500))).first()
    assert math.isnan(row["rate"]) and math.isnan(row["irate"])
    row = scan(samples(spark, (5, 7)), range_query(aggregate=aggregation("increase,irate,std.s,var.s", 1000))).first()
    assert row["increase"] == 0.0 and math.isnan(row["irate"]) and row["std_s"] == 0.0 and row["var_s"] == 0.0


def test_a_bucket_of_nan_is_reported_only_if_accepted(spark):
    s = samples(spark, (0, 1), (1000, NAN), (2000, 3))
    assert out(scan(s, range_query(aggregate=aggregation("sum", 1000))), "ts", "sum") == [(0, 1.0), (2000, 3.0)]
    assert out(scan(s, range_query(aggregate=aggregation("sum,countall", 1000))), "ts", "sum") == [(0, 1.0), (1000, "nan"), (2000, 3.0)]
    assert out(scan(s, range_query(aggregate=aggregation("any(> 2)", 1000))), "ts", "any") == [(0, 0.0), (1000, 0.0), (2000, 1.0)]
    assert out(scan(s, range_query(aggregate=aggregation("sum,last", 1000, empty=True))), "ts", "sum", "last") == [(0, 1.0, 1.0), (1000, 0.0, 1.0), (2000, 3.0, 3.0)]


def test_infinities_and_big_sums(spark):
    s = samples(spark, (0, math.inf), (1, 1.0), (2, -math.inf))
    row = scan(s, range_query(aggregate=aggregation("max,min,count", 10))).first()
    assert (row["max"], row["min"], row["count"]) == (math.inf, -math.inf, 3.0)


def test_buckets_before_zero_are_shown_at_zero(spark):
    s = samples(spark, (0, 1), (400, 2), (700, 4))
    assert out(scan(s, range_query(aggregate=aggregation("sum", 1000, align=600))), "ts", "sum") == [(0, 3.0), (600, 4.0)]


def test_empty_fill_reaches_edges_only_where_data_lies_beyond(spark):
    s = samples(spark, (1000, 1), (5000, 2))
    fill = lambda a, b: out(scan(s, range_query(a, b, aggregate=aggregation("count", 1000, empty=True))), "ts", "count")
    assert fill(2000, 4000) == [(2000, 0.0), (3000, 0.0), (4000, 0.0)]
    assert fill(0, 2500) == [(1000, 1.0), (2000, 0.0)]
    assert fill(6000, 8000) == []
    assert [t for t, _ in fill(0, 9000)] == [1000, 2000, 3000, 4000, 5000]


def test_last_is_carried_from_before_the_first_filled_bucket(spark):
    s = samples(spark, (500, 7), (2100, 8), (6000, 9))
    got = out(scan(s, range_query(2500, 5000, aggregate=aggregation("last", 1000, empty=True))), "ts", "last")
    assert got == [(2000, 7.0), (3000, 7.0), (4000, 7.0), (5000, 7.0)]


def test_conditions_are_checked():
    for bad in ("countif", "avg(> 1)", "nothing", "share"):
        with pytest.raises(ValueError):
            parse_aggregator(bad)
    assert parse_aggregator("sum(>= 2k)") == Aggregator("sumif", ">=", 2000.0)
    with pytest.raises(ValueError):
        parse_aggregators("avg,avg")
    with pytest.raises(ValueError):
        range_query(aggregate=aggregation("avg", "1s", align="start"))
    with pytest.raises(ValueError):
        range_query(by_value=(NAN, 1))


def test_binary_operators_follow_ieee(spark):
    cases = [(7.0, 0.0), (NAN, 2.0), (3.0, NAN), (NAN, NAN), (-7.0, 3.0), (0.0, 0.0), (1.0, NAN)]
    df = spark.createDataFrame(cases, "a double, b double")
    rows = df.select(*[f(F.col("a"), F.col("b")).alias(n) for n, f in BINARY.items()]).collect()
    get = lambda n: ["nan" if math.isnan(r[n]) else r[n] for r in rows]
    assert get("div")[0] == "nan" and get("mod")[4] == -1.0 and get("mod")[5] == "nan"
    assert get("cmp") == [1.0, -1.0, 1.0, 1.0, -1.0, 0.0, 1.0]
    assert get("min") == [0.0, 2.0, 3.0, "nan", -7.0, 0.0, 1.0] and get("max") == [7.0, 2.0, 3.0, "nan", 3.0, 0.0, 1.0]
    assert get("eq") == ["nan", "nan", "nan", "nan", "nan", 0.0, "nan"] and get("gt")[0] == 7.0 and get("lt")[1] == "nan"
    assert get("sgn_diff")[5] == 1.0 and get("pct_change")[5] == 0.0 and get("pow")[6] == 1.0


def test_rounding(spark):
    df = spark.createDataFrame([(123456.0,), (-0.0012345,), (0.0,), (math.inf,)], "v double")
    assert [r[0] for r in df.select(round_significant(F.col("v"), 3)).collect()] == [123000.0, pytest.approx(-0.00123), 0.0, math.inf]


@pytest.fixture(scope="module")
def pair(spark):
    a = spark.createDataFrame([(1000 * i, 10.0 * i) for i in range(1, 11)], "ts long, value double")
    b = spark.createDataFrame([(1800, 100.0), (2800, 200.0), (3800, 300.0), (4800, 400.0)], "ts long, value double")
    return a, b


def test_asof_tolerance_and_chunks(spark, pair):
    a, b = pair
    for chunk in (500, 3000, 10**9):
        got = out(asof_join(a, b, tolerance_ms=500, chunk_ms=chunk), "ts", "right_value")
        assert got == [(2000, 100.0), (3000, 200.0), (4000, 300.0), (5000, 400.0)]
        assert len(out(asof_join(a, b, chunk_ms=chunk), "ts")) == 9
        assert out(asof_join(a, b, "next", chunk_ms=chunk), "ts", "right_ts")[:2] == [(1000, 1800), (2000, 2800)]


def test_asof_ties(spark):
    a = spark.createDataFrame([(10, 1.0), (20, 2.0)], "ts long, value double")
    b = spark.createDataFrame([(5, 5.0), (10, 6.0), (15, 7.0), (25, 8.0)], "ts long, value double")
    assert out(asof_join(a, b), "right_ts") == [(10,), (15,)]
    assert out(asof_join(a, b, exact=False), "right_ts") == [(5,), (15,)]
    assert out(asof_join(a, b, "next", exact=False), "right_ts") == [(15,), (25,)]
    assert out(asof_join(a, b, "nearest"), "right_ts") == [(10,), (25,)]
    assert out(asof_join(a, b, "nearest", exact=False), "right_ts") == [(10,), (15,)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=25, unique=True), st.lists(st.integers(0, 60), max_size=25, unique=True), st.sampled_from(["previous", "next", "nearest"]), st.booleans())
def test_asof_against_a_model(spark, left, right, direction, exact):
    a = spark.createDataFrame([(t, float(t)) for t in left], "ts long, value double")
    b = spark.createDataFrame([(t, float(t)) for t in right], "ts long, value double")

    def model(t):
        back = max((r for r in right if r < t or r == t and (exact or direction == "nearest")), default=None)
        ahead = min((r for r in right if r > t or r == t and (exact or direction == "nearest")), default=None)
        if direction != "nearest":
            return back if direction == "previous" else ahead
        if back is None or ahead is None:
            return ahead if back is None else back
        return ahead if ahead - t < t - back or exact and ahead - t == t - back or ahead == t else back

    expected = [(t, model(t)) for t in sorted(left) if model(t) is not None]
    assert out(asof_join(a, b, direction, exact=exact, chunk_ms=7), "ts", "right_ts") == expected


def test_joins(spark, pair):
    a = spark.createDataFrame([(1000 + 1000 * i, 10.0 * i) for i in range(10)], "ts long, value double")
    b = spark.createDataFrame([(1000 + 1000 * i, 5.0 * i) for i in range(5, 15)], "ts long, value double")
    assert [join_series(a, b, k).count() for k in ("inner", "left", "right", "full", "semi", "anti")] == [5, 10, 10, 15, 5, 5]
    assert out(joined_range(a, b, range_query(count=2), "full", "sum"), "value") == [("nan",), ("nan",)]
    with pytest.raises(ValueError):
        joined_range(a, b, range_query(), "semi", "sum")


LABELS = [{"__name__": "cpu", "host": "a1", "dc": "x"}, {"__name__": "cpu", "host": "b2"}, {"__name__": "mem", "host": "a1", "dc": "y z"}, {}]


@pytest.mark.parametrize(
    ("text", "hits"),
    [("cpu", [0, 1]), ('cpu{dc=""}', [1]), ('{host=~"a.*"}', [0, 2]), ('{host!~"a.*"}', [1, 3]), ("{host^=(a,b)}", [0, 1, 2]), ("{host^~a}", [1, 3]), ('{dc="y z"}', [2]), ("{host=(a1,b2)}", [0, 1, 2]), ('{host=(a1,"")}', [0, 2, 3]), ('cpu{dc="x" or host="b2"}', [0, 1]), ("host=a1", [0, 2]), ("cpu{} or mem", [0, 1, 2]), ("{dc=~'x|y z'}", [0, 2]), ("{dc!=x}", [1, 2, 3]), ("{host=~'a1.+'}", [])],
)
def test_selectors(spark, text, hits):
    selector = parse_selector(text)
    assert [i for i, x in enumerate(LABELS) if selector.accepts(x)] == hits
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LABELS)], "i int, labels map<string,string>")
    assert sorted(r.i for r in df.where(selector.column(F.col("labels"))).collect()) == hits


@pytest.mark.parametrize("text", ["{}", "cpu{", "{a=~'('}", "{a^=''}", "{a<b}", "cpu mem", ""])
def test_bad_selectors(text):
    with pytest.raises(SelectorError):
        parse_selector(text)


def test_unbounded_selectors_are_refused():
    for texts in (['{a!="x"}'], ['{a=~".*"}'], ['{a=""}'], ['cpu{} or {a!="x"}']):
        with pytest.raises(SelectorError):
            parse_selectors(texts)
    assert parse_selectors(['{a!="x"}', "cpu"])


def test_grouping_drops_series_without_the_label(spark):
    series = spark.createDataFrame([(str(i), x) for i, x in enumerate(LABELS)], "key string, labels map<string,string>")
    s = spark.createDataFrame([(str(i), 1000 * t, float(10 * i + t)) for i in range(4) for t in range(3)], "key string, ts long, value double")
    got = multi.group_range(s, series, ["{host=~'.+'}"], range_query(count=2), "dc", "sum", sources=True)
    assert sorted((r.group, r.ts, r.value, r.source) for r in got.collect()) == [("dc=x", 0, 0.0, "0"), ("dc=x", 1000, 1.0, "0"), ("dc=y z", 0, 20.0, "2"), ("dc=y z", 1000, 21.0, "2")]
    with pytest.raises(ValueError):
        multi.group_range(s, series, ["cpu"], range_query(), "dc", "last")
    assert labels.search_labels(series, terms=["HOS"], case_sensitive=False).collect()[0].cardinality == 3


def test_pivot(spark):
    s = samples(spark, (1000, 10), (2000, 12), key="s1").union(samples(spark, (1000, 20), (3000, 25), key="s2"))
    assert out(multi.pivot(s, ["s1", "s2", "s1"], range_query()), "ts", "v0", "v1", "v2") == [(1000, 10.0, 20.0, 10.0), (2000, 12.0, "nan", 12.0), (3000, "nan", 25.0, "nan")]


def test_string_similarity():
    assert jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("", "a") == 0.0 and jaro_winkler("a", "a") == 1.0
    assert subsequence("abc", "abc") == 1.0 and subsequence("abd", "abc") == 0.0
    assert subsequence("my", "my-tag") == pytest.approx(0.999 * (4 - 4 / 12) / 4)


def test_duplicate_policies_with_nan(spark):
    rows = [("k", 1, 5.0, 0), ("k", 1, NAN, 1), ("k", 1, 3.0, 2), ("k", 2, NAN, 0), ("k", 2, 4.0, 1)]
    df = spark.createDataFrame(rows, "key string, ts long, value double, arrival long")
    got = {p: out(writes.collapse(df, p), "value") for p in writes.POLICIES}
    assert got == {"block": [(5.0,), ("nan",)], "first": [(5.0,), ("nan",)], "last": [(3.0,), (4.0,)], "min": [(3.0,), ("nan",)], "max": [(5.0,), ("nan",)], "sum": [(8.0,), ("nan",)]}


def test_ignore_depends_on_the_last_kept_sample(spark):
    rows = [("k", t, v, i) for i, (t, v) in enumerate([(0, 1.0), (5, 1.4), (9, 1.8), (11, 1.1), (12, NAN), (13, 1.1), (14, 1.2)])]
    df = spark.createDataFrame(rows, "key string, ts long, value double, arrival long")
    assert [t for (t,) in out(writes.drop_repeats(df, 10, 0.5), "ts")] == [0, 9, 11, 12, 13]


def test_increments(spark):
    stored = samples(spark, (100, 5))
    d = spark.createDataFrame([("k", 90, 1.0, 0), ("k", 100, 2.0, 1), ("k", 200, 3.0, 2), ("n", 1, 4.0, 3)], "key string, ts long, delta double, arrival long")
    assert sorted((r.key, r.ts, r.value) for r in writes.increments(stored, d).collect()) == [("k", 100, 7.0), ("k", 200, 10.0), ("n", 1, 4.0)]


def test_metadata(spark):
    s = writes.create_series(spark, "a", {"x": "1"}, retention_ms=5).unionByName(writes.create_series(spark, "b"))
    row = writes.alter_series(s, "a", retention_ms=9, labels={"y": "2"}).where("key = 'a'").first()
    assert (row.retention_ms, row.labels, row.duplicate_policy) == (9, {"y": "2"}, "block")
    info = writes.series_info(s, samples(spark, (1, 2), (3, 4), key="a")).orderBy("key").collect()
    assert [(r.total_samples, r.last_value) for r in info] == [(2, 4.0), (0, None)]
    with pytest.raises(ValueError):
        writes.create_series(spark, "c", duplicate_policy="other")


def test_bulk_errors(spark):
    texts = ['{"values": [1, 2], "timestamps": [20, 10]}', '{"values": [1]}', "{}", '{"values": [], "timestamps": []}', '{"values": [1], "timestamps": [-1]}', '{"values": [1, 2], "timestamps": [1]}', "no json", '{"values": ["x"], "timestamps": [1]}']
    df = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "key string, arrival long, payload string")
    got = parse_bulk(df).orderBy("arrival").collect()
    assert [(r.ts, r.value) for r in got[:2]] == [(10, 2.0), (20, 1.0)] and all(r.error for r in got[2:]) and len(got) == 9


def test_cursor_reads(spark):
    s = samples(spark, (1, 1), (2, NAN), (3, 3))
    assert out(read_after(s, "$"), "ts") == [] and out(read_after(s, "+"), "ts") == [(3,)]
    assert out(read_after(s, 2, "<", 9), "ts") == [(3,)] and out(read_after(s, "-", "!=", 1, 1), "ts") == [(2,)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5000), st.sampled_from([1.0, -2.5, 7.25, NAN])), min_size=1, max_size=30, unique_by=lambda x: x[0]), st.sampled_from([500, 1000, 700]), st.integers(0, 999))
def test_buckets_against_a_model(spark, rows, size, align):
    groups = {}
    for t, v in sorted(rows):
        groups.setdefault(t - (t - align) % size, []).append(v)
    model = []
    for b, vs in sorted(groups.items()):
        good = [v for v in vs if not math.isnan(v)]
        if good:
            model.append((max(b, 0), sum(good), float(len(good)), good[-1], max(good)))
    random.shuffle(rows)
    got = scan(samples(spark, *rows), range_query(aggregate=aggregation("sum,count,last,max", size, align=align))).collect()
    assert sorted((r.ts, r["sum"], r["count"], r["last"], r["max"]) for r in got) == sorted(model)


def test_asof_keeps_rows_with_a_null_key(spark):
    left = spark.createDataFrame([(None, 10, 1.0), (None, 10**9, 2.0), ("a", 10, 3.0), ("b", 5, 4.0)], "k string, ts long, value double")
    right = spark.createDataFrame([(None, 8, 5.0), (None, 13, 6.0), ("a", 10, 7.0)], "k string, ts long, value double")
    for direction, expected in (("previous", [5.0, 6.0, 7.0, None]), ("next", [6.0, None, 7.0, None]), ("nearest", [5.0, 6.0, 7.0, None])):
        got = {r["left_value"]: r["right_value"] for r in asof_join(left, right, direction, by=["k"], keep_unmatched=True).collect()}
        assert [got[v] for v in (1.0, 2.0, 3.0, 4.0)] == expected


def test_nearest_shuffles_each_side_once_for_both_sweeps(spark):
    left = spark.range(10).selectExpr("id AS ts", "id * 1.0D AS value", "'x' AS k")
    plan = asof_join(left, left, "nearest", by=["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4


def test_empty_buckets_in_many_runs(spark, monkeypatch):
    from chronoframe.operators import ranges

    s = samples(spark, (0, 1), (7, 2), (95, 3), (400, 4)).unionByName(samples(spark, (50, 8), (60, 9), key=None))
    q = range_query(5, 300, aggregate=aggregation("last,sum", 10, empty=True))
    key = lambda: sorted(map(str, scan(s, q).collect()))
    whole = key()
    monkeypatch.setattr(ranges, "RUN", 3)
    assert key() == whole and len(whole) == 31 + 2
    values = {r.ts: (r["last"], r["sum"]) for r in scan(s, q).where("key IS NOT NULL").collect()}
    assert values[0] == (2.0, 2.0) and values[80] == (2.0, 0.0) and values[90] == (3.0, 3.0) and values[300] == (3.0, 0.0)
