"""The registered outlier queries cover all event series, with the detectors' own settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators.outliers import detectors as D
from chronoframe.queries import QUERIES


@pytest.mark.parametrize("name", ["cusum", "ewma", "smoothed_zscore", "esd", "rcf"])
def test_all_series(spark, sf, name):
    rows = QUERIES[f"outliers_{name}"](spark, sf).toPandas()
    expected = {r.key: r.n for r in QUERIES["outliers_zscore"](spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rows.groupby("key").size().to_dict() == expected
    if name == "rcf":
        key = max(expected, key=expected.get)
        one = rows[rows.key == key].sort_values("ts")
        assert np.allclose(one["score"], D.METHODS["rcf"](one["value"].to_numpy(float), trees=100)[0], atol=2e-6)
