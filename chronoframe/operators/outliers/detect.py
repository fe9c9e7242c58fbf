"""Anomaly detection for many series: one pass over each series' ordered values.

The fenced methods that need only moments or exact quantiles also come as plain
aggregations joined to the samples, which never hold a whole series in a worker; methods that
recur over a series, or rank it again and again, take blocks of whole series, those of one length together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.numeric import ok
from ...plans.query import RangeQuery
from ..folds import firsts, in_order, whole_series
from ..ranges import BY, scan
from .detectors import METHODS
from .many import many
from .seasonality import adjusted

MIN_SAMPLES = 3
SIGNS = {"both": (-1, 1), "positive": (1,), "negative": (-1,)}


def _output(rows: DataFrame, direction: str, output: str) -> DataFrame:
    flagged = F.col("signal").isin(*SIGNS[direction])
    rows = rows.withColumn("signal", F.when(flagged, F.col("signal")).otherwise(0))
    if output == "simple":
        return rows.where("signal <> 0")
    if output == "cleaned":
        return rows.where("signal = 0").drop("signal", "score")
    return rows


def outliers(samples: DataFrame, query: RangeQuery, method: str = "zscore", direction: str = "both", output: str = "full", seasonality: Sequence[int] | str | None = None, by: Sequence[str] = BY, **options) -> DataFrame:
    """(by, ts, value, score, signal) of the samples in a window; signal is 1, -1, or 0 for none.

    ``output``: full is all samples, simple the anomalies, cleaned the others. With
    seasonality (periods, or auto) the detector sees the remainder. Series of fewer
    than three samples have no result.
    """
    if method not in METHODS:
        raise KeyError(method)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_series(batches):
            starts, x = firsts(rows), rows.column("value").to_numpy().astype(float)
            lengths = np.diff(np.append(starts, len(x)))
            scores, signs = np.zeros(len(x)), np.zeros(len(x), np.int32)
            for n in np.unique(lengths[lengths >= MIN_SAMPLES]).tolist():
                at = starts[lengths == n][:, None] + np.arange(n)
                values = np.array([adjusted(v, seasonality) for v in x[at]]) if seasonality else x[at]
                scores[at], signs[at] = many(method, values, **options)
            rows = rows.drop_columns(["_first"]).append_column("score", pa.array(scores)).append_column("signal", pa.array(signs))
            yield from rows.filter(pa.array(np.repeat(lengths >= MIN_SAMPLES, lengths))).to_batches()

    found = scan(samples, query, by)
    schema = T.StructType([*found.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("signal", T.IntegerType())])
    return _output(in_order(found, by, "ts").mapInArrow(run, schema), direction, output)


def fenced_outliers(samples: DataFrame, query: RangeQuery, method: str = "zscore", threshold: float | None = None, direction: str = "both", output: str = "full", by: Sequence[str] = BY) -> DataFrame:
    """The same for zscore, modified-zscore, mad, double-mad and iqr, by aggregations and joins alone."""
    found = scan(samples, query, by)
    v = ok(F.col("value"))
    keys = list(by)
    n = F.count(F.lit(1)).alias("_n")
    if method == "zscore":
        finite = F.when(F.abs(v) < float("inf"), v)
        k = threshold or 3.0
        fences = found.groupBy(*keys).agg(n, F.avg(finite).alias("_c"), F.coalesce(F.stddev_samp(finite), F.lit(0.0)).alias("_s"))
        fences = fences.select(*keys, "_n", "_c", (F.col("_c") - k * F.col("_s")).alias("_lo"), (F.col("_c") + k * F.col("_s")).alias("_hi"))
    elif method in ("modified-zscore", "mad"):
        k = (threshold or 3.5) / 0.6745 if method == "modified-zscore" else threshold or 3.0
        center = found.groupBy(*keys).agg(n, F.percentile(v, 0.5).alias("_c"))
        spread = found.join(center, keys).groupBy(*keys).agg(F.percentile(F.abs(v - F.col("_c")), 0.5).alias("_s"))
        fences = center.join(spread, keys).select(*keys, "_n", "_c", (F.col("_c") - k * F.col("_s")).alias("_lo"), (F.col("_c") + k * F.col("_s")).alias("_hi"))
    elif method == "double-mad":
        k = threshold or 3.0
        center = found.groupBy(*keys).agg(n, F.percentile(v, 0.5).alias("_c"))
        away = v - F.col("_c")
        sides = found.join(center, keys).groupBy(*keys).agg(F.percentile(F.when(away <= 0, -away), 0.5).alias("_a"), F.percentile(F.when(away >= 0, away), 0.5).alias("_b"))
        fences = center.join(sides, keys).select(*keys, "_n", "_c", (F.col("_c") - k * F.col("_a")).alias("_lo"), (F.col("_c") + k * F.col("_b")).alias("_hi"))
    elif method == "iqr":
        k = threshold or 1.5
        known = F.when(F.isnan("value"), 0.0).otherwise(F.col("value"))
        ranked = found.groupBy(*keys).agg(n, F.sort_array(F.collect_list(known)).alias("_all"))
        q = ranked.select(*keys, "_n", F.expr("_all[int(_n div 4)]").alias("_q1"), F.expr("_all[int(3 * _n div 4)]").alias("_q3"))
        r = F.col("_q3") - F.col("_q1")
        fences = q.select(*keys, "_n", ((F.col("_q1") + F.col("_q3")) / 2).alias("_c"), (F.col("_q1") - k * r).alias("_lo"), (F.col("_q3") + k * r).alias("_hi"))
    else:
        raise ValueError(f"{method!r} has no form by aggregations")
    d = v - F.col("_c")
    bound = F.when(d >= 0, F.col("_hi") - F.col("_c")).otherwise(F.col("_c") - F.col("_lo"))
    e = F.abs(d)
    usable = e.isNotNull() & (e > 0) & (bound >= 0) & ~F.isnan(bound)
    score = F.when(~F.coalesce(usable, F.lit(False)), 0.0).when((bound == 0) | (e == float("inf")), 1.0).otherwise(e / F.when(bound > 0, e + bound))
    signal = F.when(F.coalesce(usable & (e > bound), F.lit(False)), F.signum(d).cast("int")).otherwise(0)
    out = found.join(fences, keys).where(F.col("_n") >= MIN_SAMPLES).select(*keys, "ts", "value", score.alias("score"), signal.alias("signal"))
    return _output(out, direction, output)

