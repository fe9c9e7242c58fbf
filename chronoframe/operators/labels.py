"""Queries about series and their labels: keys, names, values, cardinalities, search, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import similarity
from ..plans.selectors import NAME_LABEL
from .multi import select_series

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
ORDERS = ("value", "score", "cardinality")


def query_index(series: DataFrame, selectors: Sequence[str]) -> DataFrame:
    return select_series(series, selectors).select("key")


def cardinality(series: DataFrame, selectors: Sequence[str] | None = None) -> DataFrame:
    chosen = select_series(series, selectors) if selectors else series
    return chosen.agg(F.count(F.lit(1)).alias("card"))


def pairs(series: DataFrame) -> DataFrame:
    """(key, label, value) of every label of every series."""
    return series.select("key", F.explode("labels").alias("label", "value"))


def query_labels(series: DataFrame, label: str | None = None, selectors: Sequence[str] | None = None) -> DataFrame:
    """Distinct label names, or the distinct values of one label, as column ``value``."""
    chosen = select_series(series, selectors) if selectors else series
    if label is None:
        return chosen.select(F.explode(F.map_keys("labels")).alias("value")).distinct()
    return chosen.select(F.try_element_at("labels", F.lit(label)).alias("value")).where("value IS NOT NULL").distinct()


def _search(found: DataFrame, terms: Sequence[str], algorithm: str, threshold: float, case_sensitive: bool) -> DataFrame:
    """Adds score, and drops what no term accepts. A threshold of 0 looks for substrings, which score 1."""
    fold = (lambda c: c) if case_sensitive else F.lower
    terms = list(terms) if case_sensitive else [t.lower() for t in terms]
    if not terms:
        return found.withColumn("score", F.lit(1.0))
    value = fold(F.col("value"))
    if threshold == 0:
        hit = F.lit(False)
        for t in terms:
            hit = hit | value.contains(t)
        return found.where(hit).withColumn("score", F.lit(1.0))
    scores = [similarity(value, t, algorithm) for t in terms]
    score: Column = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return found.withColumn("score", score).where(F.col("score") >= threshold)


def _sorted(found: DataFrame, sort_by: str, descending: bool, limit: int) -> DataFrame:
    if sort_by not in ORDERS or sort_by == "score" and not descending:
        raise ValueError("sort by value, score (descending only) or cardinality")
    limit = min(limit or DEFAULT_LIMIT, MAX_LIMIT)
    first = F.desc(sort_by) if descending else F.asc(sort_by)
    return found.orderBy(first, F.asc("value")).limit(limit)


def search_labels(
    series: DataFrame,
    label: str | None = None,
    terms: Sequence[str] = (),
    algorithm: str = "jarowinkler",
    threshold: float = 0.0,
    case_sensitive: bool = True,
    selectors: Sequence[str] | None = None,
    sort_by: str = "value",
    descending: bool = False,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """(value, score, cardinality) of label names, or of one label's values.

    The cardinality of a value counts the matching series that have it; that of a name is the
    sum over its values, counted over all series even when selectors choose the names. The limit
    is a feature of the search and at most 1000.
    """
    chosen = select_series(series, selectors) if selectors else series
    if label is None:
        names = pairs(chosen).select(F.col("label").alias("value")).distinct()
        counts = pairs(series).groupBy(F.col("label").alias("value")).agg(F.count(F.lit(1)).alias("cardinality"))
        found = names.join(counts, "value")
    else:
        found = pairs(chosen).where(F.col("label") == label).groupBy("value").agg(F.count(F.lit(1)).alias("cardinality"))
    return _sorted(_search(found, terms, algorithm, threshold, case_sensitive), sort_by, descending, limit).select("value", "score", "cardinality")


def search_metric_names(series: DataFrame, **options) -> DataFrame:
    return search_labels(series, NAME_LABEL, **options)


def label_stats(series: DataFrame, selectors: Sequence[str] | None = None, limit: int = 10, focus: str | None = None) -> DataFrame:
    """(section, name, n): totals, and the top series counts by metric name, label name, pair, and focus label's values."""
    chosen = select_series(series, selectors) if selectors else series
    found = pairs(chosen)
    limit = min(limit, MAX_LIMIT)

    def top(section: str, rows: DataFrame, name: Column) -> DataFrame:
        counted = rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
        return counted.orderBy(F.desc("n"), "name").limit(limit).select(F.lit(section).alias("section"), "name", "n")

    def total(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("section"), F.lit(name).alias("name"), "n")

    pair = F.concat_ws("=", "label", "value")
    out = total("series", chosen).unionByName(total("labels", found.select("label").distinct())).unionByName(total("pairs", found.select("label", "value").distinct()))
    out = out.unionByName(top("metric", found.where(F.col("label") == NAME_LABEL), F.col("value")))
    out = out.unionByName(top("label", found, F.col("label"))).unionByName(top("pair", found, pair))
    return out.unionByName(top("focus", found.where(F.col("label") == focus), F.col("value"))) if focus else out
