"""Near-duplicates by the Jaccard similarity of shingle sets, found by SimHash and prefix filtering and verified exactly.

First come the sets whose SimHash differs in at most 2 bits: they meet in balls (``simhash``), and what meets
is compared exactly. Most similar sets differ in more bits, up to 11 or so, for which balls would need millions of values a set,
and no number of bits holds all pairs for certain. So what the balls leave apart is then found by prefix filtering.

Shingles have one global order. Two sets of similarity s or more share
a shingle among the first ``n - ceil(s n) + 1`` of each, n being a set's size, whatever the order is;
so no pair is missed (but for equal 64-bit hashes of different shingles). Orders here go by the number of sets that
have a shingle, counted over the whole corpus: a set that has as many shingles to itself as its prefix is long
is similar to none, and passages that many texts quote come last, so sets meet on rare shingles. That is done
twice. First the shingles whose hash is a multiple of ``CLASS`` come before the others, which follow by their hash; these are
more than prefixes hold, so the others need no counting. Sets that meet none drop out, most of a corpus. Then the shingles of
those that remain are counted and ordered, all of them.

A pair is also told by its first common shingle: none of what comes before it, on either side, is in the other set. That
leaves sets that share all but a few shingles of their own too many unmatched before they meet the others.

Candidates are sifted by parity maps before sets are compared. Bit i of a set's map is the parity of
its shingles whose hash is i modulo the map's length, so two maps differ in no more places than the sets in
shingles: a pair whose maps differ in more places than similar sets may is none. A map takes a bit or two for
a shingle, a hundredth of the text, and leaves hardly a pair that is not similar.

Sets that meet on a shingle are first compared along chains, by their fingerprints, so that near ones are neighbours, and by chance; each
set with one of those that pass. As long as many pairs of sets that meet are not yet in one component, that goes on in other orders (the
fingerprints' bits are turned), and at last come all such pairs. A large group of near copies is connected by the chains, which are linear in its size;
only sets that meet but are not linked cost a comparison for each pair.

Scale: equal sets are one node, in each task before the shuffle already. One shingle in ``CLASS`` is
shuffled, and all of the sets that remain; nothing else that is shuffled or written grows with the texts' length but
the sets that are compared, each once or twice. What links join is found by rounds over all tasks if they are many (``components``),
and in one task if they are ``FEW`` or less, as after most chains: rounds write many small files and tell of many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, scratch, small
from .simhash import _signed, ball_links, components, majority, shingle_hashes

CLASS = 3
#: Chains are tried again while the pairs that remain exceed so many times the rows that meet.
REST = 2
#: And while a round leaves less than this part of them.
KEPT = 0.85
#: By so many bits the order of fingerprints is turned from chain to chain.
STEP = 23
#: The components of so many links (16 bytes each) are found in one task.
FEW = 250_000
#: So many marks are remembered by a task, to leave out the shingles of copies.
SEEN = 200_000

_node = partial(xxhash.xxh64_intdigest, seed=42)
_NONE = np.empty(0, np.uint64)
_CLASS = np.uint64(CLASS)


@dataclass(frozen=True)
class JaccardLinks:
    """Links sets of ``words``-word shingles whose Jaccard similarity is ``over / under`` or more (4 / 5).

    A text of fewer words is one shingle; texts without a word are equal.
    """

    words: int = 5
    over: int = 4
    under: int = 5

    def shingles(self, text: bytes | None) -> np.ndarray:
        return np.unique(shingle_hashes(text, self.words))

    def mark(self, text: bytes | None) -> int:
        """What stands for a text: the hash of its set, signed."""
        return _mark(self.shingles(text))

    def found(self, docs: DataFrame) -> DataFrame:
        """doc_id, fp (the mark), size, first, text_key, simhash and map of every row; copies in a task have the last two once.

        ``first`` is the number of shingles of the first class.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = _Seen()
            for batch in small(batches):
                sets = [self.shingles(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
                marks = [_mark(s) for s in sets]
                new = [len(s) > 0 and seen.is_new(m) for m, s in zip(marks, sets, strict=True)]
                maps = [parity_map(s) if x else _NONE for x, s in zip(new, sets, strict=True)]
                simhashes = pa.array([_signed(majority(s)) if x else None for x, s in zip(new, sets, strict=True)], pa.int64())
                columns = [batch.column(0), pa.array(marks, pa.int64()), *(pa.array(x, pa.int32()) for x in ([len(s) for s in sets], [len(_head(s)) for s in sets])), batch.column(1), simhashes, _lists(maps)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "size", "first", "text_key", "simhash", "map"])

        id_type = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", _text_key(), "text").mapInArrow(run, f"doc_id {id_type}, fp long, size int, first int, text_key long, simhash long, map array<long>")

    def _prefix(self, n: int) -> int:
        """How many shingles of a set of n, in any one order, hold one of each similar set's."""
        return n - -(-self.over * n // self.under) + 1 if n else 0

    def _tokens(self, s: np.ndarray) -> np.ndarray:
        """The shingles of the first class, and as many others, by their hash, as the prefix takes beyond them."""
        head = _head(s)
        return np.concatenate([head, s[s % _CLASS != 0][: max(0, self._prefix(len(s)) - len(head))]])

    def _rows(self, docs: DataFrame, pick) -> DataFrame:
        """(fp, shingle) for the shingles that pick(set) gives of every text; copies in a task give them once."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = _Seen()
            for batch in small(batches):
                sets = [self.shingles(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
                parts = [(m, pick(s)) for m, s in ((_mark(s), s) for s in sets if len(s)) if seen.is_new(m)]
                marks = np.repeat(np.array([m for m, _ in parts], np.int64), [len(p) for _, p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array(np.concatenate([_NONE, *(p for _, p in parts)]).view(np.int64))], ["fp", "shingle"])

        return docs.select("text").mapInArrow(run, "fp long, shingle long")

    def _met(self, rows: DataFrame, nodes: DataFrame, first: Column, late: Column) -> DataFrame:
        """(shingle, fp, size, place, simhash) of the shingles in prefixes that another set has too; place is from 1.

        ``rows`` has all shingles of a set, ``first`` in number, that are not late, which come by the number of sets that have them;
        and those late ones that are in the prefix.
        """
        n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "shingle").distinct()
        rows = rows.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("shingle")).cast("int")).where("sets > 1")
        rows = rows.join(nodes.select(F.col("fp").alias("_node"), "size", "first", "simhash"), F.col("fp") == F.col("_node"))
        own = Window.partitionBy("fp")
        # what a set has to itself comes first and meets nothing, so it only counts
        place = first - F.sum(F.when(late, 0).otherwise(1)).over(own) + F.row_number().over(own.orderBy(late, "sets", "shingle"))
        prefix = F.col("size") - F.ceil(F.col("size") * self.over / self.under) + 1
        return rows.withColumn("place", place.cast("int")).where(late | (F.col("place") <= prefix)).select("shingle", "fp", "size", "place", "simhash")

    def links(self, docs: DataFrame, found: DataFrame) -> DataFrame:
        """Links (a, b), a < b, that connect all marks of the written table ``found`` as all similar pairs do."""
        nodes = found.where(F.size("map") > 0).groupBy("fp").agg(*[F.first(c).alias(c) for c in ("size", "first", "simhash", "map")])
        nodes = materialize(nodes, "maps")
        maps = nodes.select("fp", "map")
        pairs = materialize(self._sifted(self._near(self._balls(nodes)), maps), "ball-pairs")
        links = self._verified(pairs, docs, found)
        some = self._met(self._rows(docs, self._tokens), nodes, F.col("first"), _is_late())
        rest = self._texts(docs, found, some.select("fp").distinct())
        met = self._met(self._rows(rest, lambda s: s), nodes, F.col("size"), F.lit(False))
        roots = _roots(links)
        met = materialize(self._unlinked(materialize(met, "met"), roots), "met-roots")
        k, before = 0, None
        while True:
            rows, left = self._left(met, k)
            if left <= REST * rows or before is not None and left >= KEPT * before:
                break  # few remain, or chains link few more
            before = left
            orders = [_turned("simhash", 2 * k * STEP), _turned("simhash", (2 * k + 1) * STEP), F.xxhash64("fp", F.lit(k))]
            pairs = self._sifted(self._near(self._chains(met, orders)), maps)
            if not k:  # at first each set is compared with the likeliest of its neighbours, so that sets are not sent around for each pair
                pairs = pairs.groupBy("b").agg(F.max(F.struct("spare", "a")).alias("_best")).select("_best.a", "b")
            pairs = materialize(pairs.select("a", "b"), "pairs")
            roots, k = _roots(_stars(roots).unionByName(self._verified(pairs, docs, found))), k + 1
            met = materialize(self._unlinked(met, roots), "met-roots")
        other = met.select("shingle", *[F.col(c).alias(f"_{c}") for c in ("fp", "size", "place", "root")])
        rest = met.join(other, (met.shingle == other.shingle) & (F.col("_fp") < F.col("fp")) & (F.col("_root") != F.col("root")) & self._may())
        pairs = materialize(self._sifted(self._near(rest), maps), "pairs")
        return _stars(roots).unionByName(self._verified(pairs, docs, found))

    def roots(self, docs: DataFrame, found: DataFrame) -> DataFrame:
        """(node, root) of all marks that are linked, but for the roots themselves: root is the smallest mark reachable."""
        return _roots(self.links(docs, found))

    def _chains(self, met: DataFrame, orders: list[Column]) -> DataFrame:
        """``met``, each row beside the last before it on its shingle, in each of the orders, that is of another component (columns with a _ before)."""
        names = ("fp", "size", "place", "root")
        for i, order in enumerate(orders):  # in one shuffle
            met = met.withColumn(f"_order{i}", order)
            by = Window.partitionBy("shingle").orderBy(f"_order{i}", "fp")
            met = met.withColumn("_before", F.lag(F.struct(*names)).over(by))
            other = F.when(F.col("_before.root") != F.col("root"), F.col("_before"))
            met = met.withColumn(f"_other{i}", F.last(other, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_before", f"_order{i}")
        met = met.select("shingle", *names, F.explode(F.array(*[f"_other{i}" for i in range(len(orders))])).alias("_other"))
        return met.select("shingle", *names, *[F.col(f"_other.{c}").alias(f"_{c}") for c in names])

    def _left(self, met: DataFrame, k: int) -> tuple[int, float]:
        """The rows of ``met``, and about how many pairs of them meet, can be similar and are not in one component.

        Of the neighbours in a chain of n rows in an order by chance as large a part is such as of all pairs, which are n / 2 times as many.
        """
        other = F.col("_fp").isNotNull() & (F.col("root") != F.col("_root")) & self._may()
        by = Window.partitionBy("shingle").orderBy(F.xxhash64("fp", F.lit(-1 - k)), "fp")
        chain = met.select("*", *[F.lag(c).over(by).alias(f"_{c}") for c in ("fp", "size", "place", "root")])
        of = chain.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.count_if(other).alias("c"))
        rows, left = of.agg(F.sum("n"), F.sum(F.col("n") * F.col("c") / 2)).first()
        return rows or 0, left or 0.0

    def _balls(self, nodes: DataFrame) -> DataFrame:
        """Pairs of rows of the written table ``nodes`` that connect all whose SimHash differs in at most 2 bits: (fp, size, place, root and those with a _ before)."""
        one = nodes.groupBy("simhash").agg(F.min(F.struct("fp", "size")).alias("one"))
        one = materialize(one.select("simhash", "one.fp", "one.size"), "simhashes")
        a, b = (one.select(F.col("simhash").alias(c), F.col("fp").alias(f"{p}fp"), F.col("size").alias(f"{p}size")) for c, p in (("a", ""), ("b", "_")))
        unlike = ball_links(one.select(F.col("simhash").alias("fp"))).join(a, "a").join(b, "b").drop("a", "b")
        by = Window.partitionBy("simhash").orderBy("fp")
        alike = nodes.select("fp", "size", *[F.lag(c).over(by).alias(f"_{c}") for c in ("fp", "size")])
        first = F.lit(1)  # the shingles' places don't matter
        return unlike.unionByName(alike).withColumns({"place": first, "_place": first, "root": F.col("fp"), "_root": F.col("_fp")})

    def _may(self) -> Column:
        """Whether the sets of a row can be similar if the shingle at their places is the first that they share."""
        common = F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place")) + 1
        return common * (self.over + self.under) >= (F.col("size") + F.col("_size")) * self.over

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Distinct (a, b, most) of the rows' pairs of two components that can be similar by their sizes and places.

        most is in how many shingles the sets differ at most if they are similar: m + n - 2 c, with
        c / (m + n - c) >= over / under.
        """
        pairs = pairs.where(F.col("_fp").isNotNull() & (F.col("root") != F.col("_root")) & self._may())
        both = F.col("size") + F.col("_size")
        most = F.floor(both * (self.under - self.over) / (self.over + self.under)).cast("int")
        return pairs.select(F.least("fp", "_fp").alias("a"), F.greatest("fp", "_fp").alias("b"), most.alias("most")).distinct()

    def _sifted(self, pairs: DataFrame, maps: DataFrame) -> DataFrame:
        """The pairs (a, b) whose maps differ in no more places than their sets may, and in how many less (spare)."""
        a, b = (maps.select(F.col("fp").alias(c), F.col("map").alias(f"_{c}")) for c in "ab")
        n = F.least(F.size("_a"), F.size("_b"))
        folded = [F.when(F.size(c) > n, F.zip_with(F.slice(c, 1, n), F.slice(c, n + 1, n), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c)) for c in ("_a", "_b")]
        differ = F.aggregate(F.zip_with(*folded, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("most") - differ).alias("spare")).where("spare >= 0")

    def _verified(self, pairs: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
        """Those of the written pairs (a, b) whose sets are similar, written; each b's set goes to where a's is."""
        with scratch(docs.sparkSession):
            marks = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
            sets = materialize(self._sets(docs, found, marks), "sets")
            a, b = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")
            a = a.join(pairs.select("a").distinct(), "a", "left_semi")
            common, both = F.size(F.array_intersect("_a", "_b")), F.size("_a") + F.size("_b")
            # c / (m + n - c) >= over / under, in whole numbers
            similar = pairs.join(b, "b").join(a, "a").where(common * (self.over + self.under) >= both * self.over)
            return materialize(similar.select("a", "b"), "similar", keep=True)

    def _unlinked(self, met: DataFrame, roots: DataFrame) -> DataFrame:
        """``met`` with its roots, without the shingles that meet in one component only."""
        roots = broadcast_if_small(roots, F.lit(16))
        by = Window.partitionBy("shingle")
        now = met.drop("root").join(roots, F.col("fp") == F.col("node"), "left").select("shingle", "fp", "size", "place", "simhash", F.coalesce("root", "fp").alias("root"))
        now = now.withColumn("_more", F.min("root").over(by) != F.max("root").over(by))
        return now.where("_more").drop("_more")

    def _texts(self, docs: DataFrame, found: DataFrame, marks: DataFrame) -> DataFrame:
        """The texts of ``marks``, at least one of each."""
        marks = broadcast_if_small(materialize(marks, "marks"), F.lit(8))
        keys = found.select("fp", "text_key").join(marks, "fp", "left_semi").groupBy("fp").agg(F.min("text_key").alias("text_key"))
        keys = broadcast_if_small(materialize(keys.select("text_key").distinct(), "keys"), F.lit(8))
        return docs.select(_text_key(), "text").join(keys, "text_key", "left_semi")

    def _sets(self, docs: DataFrame, found: DataFrame, marks: DataFrame) -> DataFrame:
        """(fp, shingles), one row of each of ``marks``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = _Seen()
            for batch in small(batches):
                sets = [(_mark(s), s) for s in map(self.shingles, batch.column(1).cast(pa.binary()).to_pylist())]
                sets = [x for x in sets if seen.is_new(x[0])]
                yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in sets], pa.int64()), _lists([s for _, s in sets])], ["fp", "shingles"])

        return self._texts(docs, found, marks).mapInArrow(run, "fp long, shingles array<long>").dropDuplicates(["fp"])


class _Seen:
    """The marks that a task has met lately."""

    def __init__(self) -> None:
        self.marks: set[int] = set()

    def is_new(self, mark: int) -> bool:
        if mark in self.marks:
            return False
        if len(self.marks) >= SEEN:
            self.marks.clear()
        self.marks.add(mark)
        return True


def _roots(links: DataFrame) -> DataFrame:
    """``components`` of ``links`` (a, b), written; of ``FEW`` links or less in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.concatenate([np.empty((2, 0), np.int64), *([c.to_numpy() for c in batch.columns] for batch in batches)], axis=1)
        nodes, roots = forest(*links)
        yield pa.RecordBatch.from_arrays([pa.array(x[nodes != roots]) for x in (nodes, roots)], ["node", "root"])

    with scratch(links.sparkSession):
        links = materialize(links, "links")
        few = links.count() <= FEW
        return materialize(links.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long") if few else components(links), "roots", keep=True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a to b, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while not np.array_equal(x := root[a], y := root[b]):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(above := root[root], root):
            root = above
    return nodes, nodes[root]


def _stars(roots: DataFrame) -> DataFrame:
    """Links (a, b) of the nodes to their roots."""
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b"))


def _head(s: np.ndarray) -> np.ndarray:
    """The shingles of the first class."""
    return s[s % _CLASS == 0]


def _is_late() -> Column:
    """Whether the shingle, unsigned, is not of the first class."""
    return F.pmod(F.pmod("shingle", F.lit(CLASS)) + F.when(F.col("shingle") < 0, F.lit((1 << 64) % CLASS)).otherwise(0), F.lit(CLASS)) != 0


def _turned(fingerprint: str, bits: int) -> Column:
    """The 64 bits of a column, turned left."""
    by = bits % 64
    return F.shiftleft(fingerprint, by).bitwiseOR(F.shiftrightunsigned(fingerprint, 64 - by)) if by else F.col(fingerprint)


def _mark(shingles: np.ndarray) -> int:
    x = _node(shingles.tobytes())
    return x - (1 << 64) if x >> 63 else x


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([_NONE, *arrays]).view(np.int64)))


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """The parities, in words of 64 bits, of a set's hashes modulo the least power of two that is its size or more (64 at least)."""
    n = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    bits = np.bincount((shingles & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)
