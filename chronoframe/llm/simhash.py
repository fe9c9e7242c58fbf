"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 bits have a value between them that differs from
each in at most 1 bit. So every distinct fingerprint emits all values within half the radius
(itself and its 64 one-bit variants), rows are shuffled on that value, and fingerprints that
meet there are verified and linked. At most 65 fingerprints can meet on a value, whatever
the data, so no group is large; a chain through the sorted group links them all.

Scale: equal fingerprints (copies, however many) are merged before the ball is made, so the
emitted rows are 65 times the distinct fingerprints at most. Components are found on links
between distinct fingerprints by alternating large and small stars, each round a few joins
on a written table; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch, small, spread, table

_hash = partial(xxhash.xxh64_intdigest, seed=42)
_ROWS = 255  # as many bits can be summed in a byte


def shingle_hashes(text: bytes | None, length: int) -> np.ndarray:
    """The hashes of a text's shingles of ``length`` words, in order; a shorter text is one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - length + 1)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(length)], strict=False)) if len(words) >= length else [b" ".join(words)]
    return np.fromiter(map(_hash, shingles), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The SimHash of hashes, unsigned: the bits that are set in more than half of them; 0 without any."""
    n = len(h)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _ROWS * 256):
        part = h[i : i + _ROWS * 256]
        part = np.concatenate([part, np.zeros(-len(part) % _ROWS, np.uint64)]).astype(">u8")  # the highest bit first
        bits = np.unpackbits(part.view(np.uint8)).reshape(-1, _ROWS, 64)
        counts += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: bytes | None, length: int = 3) -> int:
    """The SimHash of a text's shingles of ``length`` words, unsigned; 0 without a word."""
    return majority(shingle_hashes(text, length))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, length: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = [_signed(fingerprint(t, length)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _flipped(value, bit):
    return value.bitwiseXOR(F.when(bit < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, bit)")))


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that connect all fingerprints at a distance of 2 or less.

    ``fps`` has distinct, non-null fingerprints fp. Only (value, bit) is shuffled: the
    fingerprint is the value with that bit flipped back.
    """
    ball = fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit"))
    ball = ball.select(_flipped(F.col("fp"), F.col("bit")).alias("value"), F.col("bit").cast("int").alias("bit"))
    fp = _flipped(F.col("value"), F.col("bit"))
    met = ball.withColumn("b", fp).withColumn("a", F.lag("b").over(Window.partitionBy("value").orderBy("b")))
    return met.where(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable."""
    edges, before = materialize(links, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select("b", F.least("a", "m").alias("m")).where("b <> m").distinct()
        large = materialize(large, "stars")
        least = large.groupBy("b").agg(F.min("m").alias("r"))
        small = large.join(least, "b")
        small = small.where("m <> r").select(F.col("m").alias("b"), F.col("r").alias("a")).unionByName(least.select("b", F.col("r").alias("a"))).distinct()
        edges = materialize(small.select("a", "b"), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


@dataclass(frozen=True)
class SimHashLinks:
    """A rule that links texts whose SimHash differs in at most 2 bits.

    A rule has ``mark`` (what stands for a text), ``found`` (doc_id, fp: the marks of all rows),
    ``links`` (a, b between marks) and ``roots`` (their components). ``similarity.JaccardLinks`` is the other one.
    """

    words: int = 3

    def mark(self, text: bytes | None) -> int:
        return _signed(fingerprint(text, self.words))

    def found(self, docs: DataFrame) -> DataFrame:
        return fingerprints(docs, self.words)

    def links(self, docs: DataFrame, found: DataFrame) -> DataFrame:
        return ball_links(found.select("fp").distinct())

    def roots(self, docs: DataFrame, found: DataFrame) -> DataFrame:
        return components(self.links(docs, found))


def _labelled(docs: DataFrame, found: DataFrame, rule) -> DataFrame:
    """(fp, root, component_id) for every distinct mark of a written table (doc_id, fp) of ``docs``.

    root names the component; two of them have one component_id only if that id is repeated.
    """
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = rule.roots(docs, found)
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    nodes = materialize(nodes, "nodes")
    least = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return nodes.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Returns doc_id, fingerprint, component_id for every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows
    repeated under one id are one row each. Null ids take part, but an id of a component is
    null only if all its ids are.
    """
    found = materialize(fingerprints(docs), "fingerprints")
    labels = _labelled(docs, found, SimHashLinks()).select(F.col("fp").alias("_fp"), "component_id")
    out = found.join(labels, found.fp == labels._fp, "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, rule=SimHashLinks()) -> DataFrame:  # noqa: B008
    """The rows of ``docs``, all columns, one of each component of ``rule``'s links: the one with the smallest id.

    Of rows repeated under that id one stays, and rows of different components under one id
    stay each for its own. A row with a null id stays only if its component has nothing but
    null ids, as one of these.
    """
    found = materialize(rule.found(docs), "fingerprints")
    with scratch(docs.sparkSession):
        labels = materialize(_labelled(docs, found, rule), "labels", keep=True)
    ids = materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "ids")
    once = ids.where("n = 1").join(labels, "fp").where("doc_id = component_id").select(F.col("doc_id").alias("_kept"))
    out = docs.join(once, docs["doc_id"] == once["_kept"], "left_semi")
    # ids that don't tell rows apart: null, or repeated; their rows are told apart by fingerprints
    repeated = ids.where("n > 1").select(F.col("doc_id").alias("_kept"))
    unclear = [docs.join(repeated, docs["doc_id"] == repeated["_kept"], "left_semi")] if repeated.limit(1).count() else []
    unclear += [docs.where("doc_id IS NULL")] if found.where("doc_id IS NULL").limit(1).count() else []
    for rows in unclear:
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        marked = _with_mark(rows.select("text", whole), rule).join(labels, "fp").where(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
        out = out.unionByName(marked.dropDuplicates(["root"]).select("row.*"))
    return out


def _with_mark(docs: DataFrame, rule) -> DataFrame:
    """``docs`` (text and others) with its marks as fp."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fps = pa.array([rule.mark(t) for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], [*batch.schema.names, "fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())]))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))
