"""Series that are taken together give what each gives alone."""

import numpy as np
import pyarrow as pa
import pytest

from chronoframe.operators.folds import firsts, whole_series
from chronoframe.operators.outliers import detectors as D
from chronoframe.operators.outliers import many as M
from chronoframe.operators.writes import drop_repeats
from chronoframe.queries import QUERIES

RNG = np.random.default_rng(5)
PLANS = ["outliers_rcf", "outliers_esd", "outliers_double_mad_batch", "outliers_ewma", "outliers_smoothed_zscore", "ignore_repeats", "outliers_mad_cleaned", "outliers_cusum"]


def blocks():
    for n in (3, 4, 5, 9, 12, 13, 24):
        x = RNG.normal(50, 20, (24, n)).round(2)
        x[1], x[2, n // 2 :], x[3, 0] = 7.0, 7.0, 900.0
        x[4], x[5], x[6] = RNG.integers(0, 3, n), np.arange(n), np.where(np.arange(n) % 3, 1e-17, 1.0)
        x[7], x[8], x[9, -1] = RNG.normal(0, 1, n) * 1e150, np.resize([1e16, 1, 1, -1e16], n), -np.inf
        x[10, :2], x[11] = np.nan, -np.abs(x[11])
        x[12], x[13], x[14] = RNG.integers(-1, 2, n), np.resize([1.0, 1 + 2**-52, 1e8], n), np.resize([5.0, -5.0], n)
        yield x


def same(method, x, **options):
    scores, signs = M.many(method, x, **options)
    for i, row in enumerate(x):
        alone = D.METHODS[method](row, **options)
        assert np.array_equal(scores[i], alone[0]) and np.array_equal(signs[i], alone[1])


def check(method, *options):
    assert method in M.MATRICES
    with np.errstate(all="ignore"):
        for x in blocks():
            for o in options or ({},):
                same(method, x, **o)


@pytest.mark.parametrize("name", PLANS)
def test_no_group_for_each_series(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    below = plan[plan.index("MapInArrow") :].partition("Exchange")[0]
    assert below.count("Sort [") == 1


@pytest.mark.parametrize("block", [1, 20, 10_000])
def test_blocks_hold_whole_series(block):
    first = np.concatenate([np.arange(n) == 0 for n in (1, 3, 70, 2, 1, 16, 40, 1)])
    rows = pa.table({"i": np.arange(len(first)), "_first": first})
    found = list(whole_series(iter(rows.to_batches(16)), block))
    assert all(firsts(t)[0] == 0 for t in found) and pa.concat_tables(found).equals(rows)
    assert len(found) == 1 if block == 10_000 else len(found) > 1


def test_rcf():
    for x in blocks():
        same("rcf", np.where(np.isinf(x), 3.0, x), trees=7)


def test_esd():
    check("esd", {}, {"max_outliers": 1}, {"hybrid": False})
    for x in (RNG.standard_cauchy((9, 101)).round(1), RNG.integers(0, 9, (9, 200)).astype(float)):
        same("esd", x)


def test_double_mad():
    check("double-mad", {}, {"estimator": "simple"})


def test_ewma():
    check("ewma")


def test_smoothed_zscore():
    check("smoothed-zscore", {}, {"lag": 3, "influence": 0.5})


def test_repeats_of_a_long_series(spark):
    rows = [(k, t, float(RNG.integers(0, 4)) if t % 50 else float("nan"), t) for k, n in (("a", 25_000), (None, 30), ("b", 30)) for t in range(n)]
    df = spark.createDataFrame(rows, "key string, ts long, value double, arrival long").repartition(7, "value")
    expected, last = [], {}
    for k, ts, value, _ in rows:
        if k not in last or not (ts - last[k][0] <= 5 and abs(value - last[k][1]) <= 1):
            last[k] = ts, value
            expected.append((str(k), ts))
    assert sorted((str(r.key), r.ts) for r in drop_repeats(df, 5, 1.0).collect()) == sorted(expected)


def test_mad():
    check("mad", {}, {"estimator": "simple"}, {"estimator": "harrell-davis"})
    check("modified-zscore")


def test_cusum():
    check("cusum")
