"""Sharding by proportional stratified interleaving, under the law ``rows``.

Rows are shuffled by a seeded hash within their source; row number r of a source of n rows
gets the fractional rank (r - u) / n, where u in (0, 1) is the source's own phase, so that
many small sources do not all fall on one place. Sorting all rows by fractional rank mixes the sources in
proportion everywhere, and cutting the sorted rows into equal runs gives shards that all
hold the mixture and whose counts differ by one at most.

Scale: no task sorts a whole source or the whole table. Both rankings are done in buckets
(of the hash, then of the fractional rank) that hold about ``BUCKET_ROWS`` rows whatever
the number of rows, with the buckets' cumulated counts as offsets. Texts are read once, for
size and checksum, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

BUCKET_ROWS = 8192
SEED = 20240601


def interleave(slim: DataFrame, n_shards: int = 8, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, salt: tuple[str, ...] = ()) -> DataFrame:
    """Adds shard (int) and slot (long) to rows that have doc_id and source.

    ``slim`` is read several times, so it should be a written table. A null source is a
    stratum of its own. The columns ``salt`` go into the hash, so that rows of one id, or none, are spread
    too; rows that agree in all of these are told apart arbitrarily. Of equal fractional ranks the source's name and then
    the hash decide; an empty table stays empty.
    """
    n = slim.count()
    bits = max(0, (max(n, 1) // bucket_rows).bit_length())
    rows = slim.select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_s"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", *salt), 1).alias("_h"))
    rows = rows.withColumn("_b", F.shiftright("_h", 63 - bits) if bits else F.lit(0).cast("long"))
    counts = rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    by_source = Window.partitionBy("_s")
    offsets = counts.select("_s", "_b", (F.sum("_c").over(by_source.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(by_source).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", "doc_id"))
    phase = (F.pmod(F.xxhash64(F.lit(seed), "_s"), F.lit(1 << 20)) + 0.5) / F.lit(float(1 << 20))
    ranked = rows.join(offsets, ["_s", "_b"]).withColumn("_f", (F.col("_before") + rank - phase) / F.col("_n"))
    ranked = ranked.drop("_b", "_before", "_n").withColumn("_b", F.floor(F.col("_f") * (1 << bits)))
    counts = ranked.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    # one row for each bucket_rows rows of the table, in one task
    offsets = counts.select("_b", (F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_f", "_s", "_h", "doc_id")) - 1
    out = ranked.join(offsets, "_b").withColumn("_p", F.col("_before") + place)
    shard = F.expr(f"(_p * {n_shards}L) div {max(n, 1)}L")
    out = out.withColumn("_shard", shard).withColumn("slot", F.col("_p") - F.expr(f"(_shard * {n}L + {n_shards - 1}L) div {n_shards}L"))
    return out.withColumn("shard", F.col("_shard").cast("int")).drop("_s", "_h", "_f", "_b", "_before", "_p", "_shard")


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = SEED) -> DataFrame:
    """Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, source for every row.

    Size: UTF-8 bytes of the text plus 1. A null text has size 1 and the checksum 0 of no
    bytes, as the empty one. Repeated and null ids are one row each; an empty table gives none. Other columns are left aside.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", "source", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = interleave(materialize(slim, "shard-rows"), n_shards, seed, salt=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = SEED) -> None:
    """Writes whole rows under ``path/shard=k``, several files a shard, each sorted by slot."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]).alias("row")
    salt = F.xxhash64("text").alias("salt")
    rows = interleave(materialize(docs.select("doc_id", "source", salt, whole), "shard-input"), n_shards, seed, salt=("salt",))
    rows.select("row.*", "shard", "slot").repartitionByRange(4 * n_shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
