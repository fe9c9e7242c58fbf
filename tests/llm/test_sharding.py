"""Fractional ranks against plain Python."""

from pyspark.sql import functions as F

from chronoframe.llm import sharding


def test_order_by_fractional_rank(spark):
    slim = spark.range(700).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 20)).alias("source"), (F.col("id") % 50).alias("size"), (F.col("id") * 31).alias("text_crc32"))
    salt, seed, n = ("size", "text_crc32"), sharding.SEED, 700
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    hashed = slim.select("text_crc32", "doc_id", name.alias("s"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", *salt), 1).alias("h"), ((F.pmod(F.xxhash64(F.lit(seed), name), F.lit(1 << 20)) + 0.5) / F.lit(float(1 << 20))).alias("u")).collect()
    sources = {}
    for r in hashed:
        sources.setdefault(r.s, []).append(r)
    ranked = []
    for s, rows in sources.items():
        for k, r in enumerate(sorted(rows, key=lambda r: (r.h, r.doc_id if r.doc_id is not None else -1)), 1):
            ranked.append(((k - r.u) / len(rows), s, r.h, r.text_crc32))
    expected = {}
    for place, (*_, row) in enumerate(sorted(ranked)):
        shard = place * 8 // n
        expected[row] = (shard, place - (shard * n + 7) // 8)
    for bucket_rows in (16, 8192):
        got = {r.text_crc32: (r.shard, r.slot) for r in sharding.interleave(slim, 8, seed, bucket_rows, salt).collect()}
        assert got == expected


def test_rows_without_an_id_are_spread(spark):
    slim = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one").alias("source"), F.col("id").alias("size"))
    hashed = slim.select(F.xxhash64("doc_id", "source", "size").alias("h")).distinct().count()
    got = sharding.interleave(slim, 8, bucket_rows=64, salt=("size",)).collect()
    assert hashed == 4000 and sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(8) for i in range(500)]
