import math

import numpy as np
import pytest

from chronoframe.operators.outliers import detectors as D
from chronoframe.operators.outliers import quantiles as Q
from chronoframe.operators.outliers.detect import fenced_outliers, outliers
from chronoframe.operators.outliers.seasonality import adjusted, loess, periods_of, stl
from chronoframe.plans.query import range_query

RNG = np.random.default_rng(3)
NOISE = RNG.normal(10, 1, 200)
SPIKES = NOISE.copy()
SPIKES[[50, 120]] = 40, -20


@pytest.mark.parametrize("method", sorted(D.METHODS))
@pytest.mark.parametrize("data", [NOISE, SPIKES, np.full(50, 3.0), np.array([1.0, 2.0, 50.0]), np.append(NOISE[:60], np.nan)])
def test_score_contract(method, data):
    options = {"trees": 10} if method == "rcf" else {}
    scores, signs = D.METHODS[method](data, **options)
    assert len(scores) == len(signs) == len(data) and ((scores >= 0) & (scores <= 1)).all()
    assert ((scores > 0.5) == (signs != 0)).all()


@pytest.mark.parametrize("method", ["zscore", "modified-zscore", "iqr", "mad", "double-mad", "smoothed-zscore", "esd", "rcf"])
def test_spikes_are_found(method):
    _, signs = D.METHODS[method](SPIKES)
    assert signs[50] != 0 and signs[120] != 0


def test_shift_is_found_by_control_charts():
    x = np.concatenate([NOISE, NOISE + 3])
    for method in (D.cusum, D.ewma):
        assert method(x)[1][210:].sum() > 100


def test_score_edges():
    assert D.score(0, 1)[()] == 0 and D.score(math.nan, 1)[()] == 0 and D.score(1, math.nan)[()] == 0
    assert D.score(1, 1)[()] == 0.5 and D.score(1, 0)[()] == 1 and D.score(math.inf, 3)[()] == 1


def test_esd_on_rosners_example():
    x = np.array([-0.25, 0.68, 0.94, 1.15, 1.20, 1.26, 1.26, 1.34, 1.38, 1.43, 1.49, 1.49, 1.55, 1.56, 1.58, 1.65, 1.69, 1.70, 1.76, 1.77, 1.81, 1.91, 1.94, 1.96, 1.99, 2.06, 2.09, 2.10, 2.14, 2.15, 2.23, 2.24, 2.26, 2.35, 2.37, 2.40, 2.47, 2.54, 2.62, 2.64, 2.90, 2.92, 2.92, 2.93, 3.21, 3.26, 3.30, 3.59, 3.68, 4.30, 4.64, 5.34, 5.42, 6.01])
    assert np.flatnonzero(D.esd(x, hybrid=False, max_outliers=10)[1]).tolist() == [51, 52, 53]


def test_quantiles():
    x = np.arange(1.0, 11)
    assert [round(Q.hyndman_fan(x, 0.25, k), 4) for k in range(1, 10)] == [3, 3, 2, 2.5, 3, 2.75, 3.25, 2.9167, 2.9375]
    assert Q.harrell_davis(x, 0.5) == pytest.approx(5.5) and Q.trimmed_harrell_davis(x, 0.5) == pytest.approx(5.5)
    assert Q.student_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert Q.incomplete_beta(0.3, 2, 3) == pytest.approx(0.3483)
    big = RNG.normal(0, 2, 4000)
    assert Q.mad(big, "simple") == pytest.approx(2, abs=0.1) and Q.mad(big[:400], "harrell-davis") == pytest.approx(2, abs=0.3)


def test_seasonality():
    t = np.arange(240.0)
    y = 5 * np.sin(2 * np.pi * t / 12) + 0.05 * t + RNG.normal(0, 0.1, 240)
    assert 11 <= periods_of(y)[0] <= 13
    seasonal, trend, rest = stl(y, 12)
    assert np.abs(rest).mean() < 0.3 and np.corrcoef(seasonal, np.sin(2 * np.pi * t / 12))[0, 1] > 0.98
    assert np.allclose(seasonal + trend + rest, y) and np.allclose(loess(t, 9), t)
    y[100] += 4
    assert np.argmax(np.abs(adjusted(y, [12]))) == 100 and len(adjusted(y, [12, 24])) == 240
    with pytest.raises(ValueError):
        adjusted(y[:20], [12])


def test_both_forms_agree(spark):
    rows = [(k, i, float(v)) for k in ("a", "b") for i, v in enumerate(SPIKES if k == "a" else NOISE[:30])] + [("c", 0, 1.0)]
    s = spark.createDataFrame(rows, "key string, ts long, value double")
    for method in ("zscore", "modified-zscore", "mad", "double-mad", "iqr"):
        plain = lambda df: sorted((r.key, r.ts, round(r.score, 9), r.signal) for r in df.collect())
        assert plain(fenced_outliers(s, range_query(), method)) == plain(outliers(s, range_query(), method))
    assert outliers(s, range_query(), "zscore", direction="positive", output="simple").count() == 1
    assert outliers(s, range_query(), "zscore", output="cleaned").columns == ["key", "ts", "value"]
