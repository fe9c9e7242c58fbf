"""Bulk ingestion of JSON payloads: ``{"values": [...], "timestamps": [...]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SAMPLES = 1000


def parse_bulk(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(key, ts, value, arrival, error): one row a sample, or one row with an error a rejected payload.

    ``payloads`` has key, the payload, and arrival (the order of payloads). A payload is
    rejected whole: for missing or empty arrays, different lengths, over 1000 samples, a
    negative timestamp or an element that is no number. Samples are in order of time.
    """
    parsed = F.from_json(column, "values array<double>, timestamps array<long>", {"mode": "PERMISSIVE"})
    p = payloads.select("key", "arrival", parsed.alias("p")).select("key", "arrival", F.col("p.values").alias("v"), F.col("p.timestamps").alias("t"))
    error = (
        F.when(F.col("v").isNull(), "missing values")
        .when(F.col("t").isNull(), "missing timestamps")
        .when((F.size("v") == 0) | (F.size("t") == 0), "no timestamps or values")
        .when(F.size("v") != F.size("t"), "timestamps and values length mismatch")
        .when(F.size("v") > MAX_SAMPLES, "too many samples")
        .when(F.exists("v", lambda x: x.isNull()), "invalid value")
        .when(F.exists("t", lambda x: x.isNull() | (x < 0)), "invalid timestamp")
    )
    p = p.withColumn("error", error)
    samples = F.array_sort(F.arrays_zip(F.col("t").alias("ts"), F.col("v").alias("value")))
    good = p.where("error IS NULL").select("key", "arrival", F.posexplode(samples).alias("i", "s"))
    good = good.select("key", F.col("s.ts").alias("ts"), F.col("s.value").alias("value"), (F.col("arrival") * MAX_SAMPLES + F.col("i")).alias("arrival"), F.lit(None).cast("string").alias("error"))
    bad = p.where("error IS NOT NULL").select("key", F.lit(None).cast("long").alias("ts"), F.lit(None).cast("double").alias("value"), (F.col("arrival") * MAX_SAMPLES).alias("arrival"), "error")
    return good.unionByName(bad)
