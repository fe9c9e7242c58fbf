"""Benchmark decontamination with suffix arrays over the training texts.

Documents are cut into shards of some hundred thousand words. Each shard gets a suffix array: its
word positions sorted by the words that follow, as deep as a window is long. Every suffix
of every benchmark item is looked up in it by binary search; the range that is found holds
all places of its window. Where windows follow each other, the longest verbatim match is looked up among the
benchmark's own suffixes.

Positions whose first four words start no window of the benchmark cannot be found by any
search, so they are left out before sorting; the test is a hashed table that only errs on
the side of keeping a position.

Windows that many items share, such as a preamble, are one window: places are marked window by window, and items are
listed by distinct sets of owners, so repeated items cost nothing but their names.

Scale: each shard is worked on where it is read, so nothing is shuffled. The benchmark goes
to the workers in blocks of at most ``BLOCK_BYTES`` of text, each a file that a worker reads when its turn comes; a shard is
searched for one block after the other, so the benchmark's size does not have to fit anywhere at once.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, spread, table

WINDOW = 13
BLOCK_BYTES = 4 << 20
SHARD_WORDS = 150_000
_BITS = 22
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
#: A-Z to a-z; every ASCII character that is no letter or digit to a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def _gram(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n ids from every place on; ids has as many places more at its end."""
    size = len(ids) - 3
    h = ids[:size] * _MULTIPLIERS[0]
    for j in range(1, n):
        h += ids[j : size + j] * _MULTIPLIERS[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - _BITS)


def _keys(rows: np.ndarray, window: int, pad: int) -> np.ndarray:
    """Rows of word ids as byte strings that sort as the rows do, filled up with pad."""
    full = np.full((len(rows), window * 4), pad, np.uint8)
    width = rows.shape[1] * 4
    full[:, :width] = np.ascontiguousarray(rows.astype(">u4")).view(np.uint8).reshape(len(rows), width)
    return full.view(f"S{window * 4}").ravel()


class TestBlock:
    """All suffixes of a block of benchmark items, as deep as a window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.ids, self.vocabulary = window, [i for i, _ in items], {}
        self.texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.uint32) for _, text in items]
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for n, ids in enumerate(self.texts):
            if k := min(window, len(ids)):
                rows = np.lib.stride_tricks.sliding_window_view(ids, k)
                by_length[k].append((rows, np.stack([np.full(len(rows), n), np.arange(len(rows))], 1)))
        self.tables, self.groups, self.owned, classes = {}, [], [], {}
        for k, parts in sorted(by_length.items()):
            owners = np.concatenate([p[1] for p in parts])
            unique, which = np.unique(np.concatenate([p[0] for p in parts]), axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            starts = np.searchsorted(which.ravel()[order], np.arange(len(unique) + 1))
            owners = owners[order]
            # windows with the same items are of one class
            of = np.empty(len(unique), np.int64)
            for q in range(len(unique)):
                who = tuple(dict.fromkeys(owners[starts[q] : starts[q + 1], 0].tolist()))
                of[q] = classes.setdefault(who, len(classes))
            self.groups.append((k, _keys(unique, window, 0), _keys(unique, window, 255), starts, owners, of))
            g = min(k, 4)
            seen = self.tables.setdefault(g, np.zeros(1 << _BITS, bool))
            seen[_gram(np.concatenate([np.pad(unique[:, :g], ((0, 0), (0, 4))), np.zeros((1, g + 4), np.uint32)]).ravel(), g)[:: g + 4][: len(unique)]] = True
        self.owned = [{self.ids[i] for i in who} for who in classes]
        self._suffixes: tuple[np.ndarray, bytes] | None = None

    def search(self, ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, windows) of all windows found, by the windows' length; ids ends with ``window`` zeros."""
        found: list[tuple] = []
        if self.groups:
            ids = ids.astype(np.uint32)
            maybe = np.zeros(len(ids) - 3, bool)
            for g, seen in self.tables.items():
                maybe |= seen[_gram(ids, g)]
            maybe &= ids[: len(maybe)] > 0
            at = np.flatnonzero(maybe)
            at = at[at + self.window <= len(ids)]
            keys = _keys(ids[at[:, None] + np.arange(self.window)], self.window, 0)
            order = np.argsort(keys, kind="stable")
            keys, suffixes = keys[order], at[order]
            for k, low, high, *_ in self.groups:
                first, last = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
                n = last - first
                if n.sum():
                    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append((k, suffixes[np.repeat(first, n) + within], np.repeat(np.arange(len(n)), n)))
        return found

    def _sorted_suffixes(self) -> tuple[np.ndarray, bytes]:
        """The places of all items' words, by all words that follow in the item; and those words as bytes that sort alike."""
        if self._suffixes is None:
            end = np.array([0xFFFFFFFF], np.uint32)
            words = np.concatenate([x for t in self.texts for x in (t, end)])
            rank, reach, n = np.unique(words, return_inverse=True)[1].ravel(), 1, len(words)
            ends = np.flatnonzero(words == end[0])
            rank[ends] = rank.max() + np.arange(len(ends))  # items' ends differ, so that no order goes beyond them
            while True:
                ahead = np.zeros(n, np.int64)
                ahead[: max(0, n - reach)] = rank[reach:] + 1
                order = np.lexsort((ahead, rank))
                new = np.concatenate([[0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(ahead[order]) != 0))])
                rank[order] = new
                if new[-1] == n - 1:
                    break
                reach *= 2
            self._suffixes = order, words.astype(">u4").tobytes()
        return self._suffixes

    def longest(self, words: bytes, least: int) -> int:
        """How many of the words, in bytes, stand verbatim in an item from any of the first places on; ``least`` of them do."""
        order, test = self._sorted_suffixes()
        size, best, p = len(words) // 4, least, 0
        while size - p > best:
            key = words[4 * p :]
            low, high = 0, len(order)
            while low < high:
                mid = (low + high) // 2
                s = 4 * int(order[mid])
                if test[s : s + len(key)] < key:
                    low = mid + 1
                else:
                    high = mid
            for i in (low - 1, low):
                if 0 <= i < len(order):
                    s = 4 * int(order[i])
                    best = max(best, _common(test, s, key))
            p += 1
        return best


def _common(test: bytes, at: int, key: bytes) -> int:
    """How many words of key stand in test from a place on."""
    a = np.frombuffer(test, ">u4", min(len(key), len(test) - at) // 4, at)
    differ = np.flatnonzero(a != np.frombuffer(key, ">u4", len(a)))
    return int(differ[0]) if len(differ) else len(a)


class Shard:
    """The words of some rows as numbers, ``window`` zeros after each row."""

    def __init__(self, window: int):
        self.window, self.vocabulary, self.lengths, self.parts = window, defaultdict(count(1).__next__), [], []
        self.size = 0

    def add(self, text: bytes | None) -> None:
        words = words_of(text)
        self.lengths.append(len(words))
        self.parts += [np.fromiter(map(self.vocabulary.__getitem__, words), np.uint32, len(words)), np.zeros(self.window, np.uint32)]
        self.size += len(words)

    def ids(self, block: TestBlock) -> np.ndarray:
        """The words by the block's numbers, 0 for others."""
        known = np.fromiter(map(block.vocabulary.get, self.vocabulary, repeat(0)), np.uint32, len(self.vocabulary))
        return np.concatenate([np.zeros(1, np.uint32), known])[np.concatenate(self.parts)]

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.array(self.lengths, np.int64) + self.window)])


def _shards(batches: Iterator[pa.RecordBatch], window: int, shard_words: int) -> Iterator[tuple[list[pa.RecordBatch], Shard]]:
    """Batches whose texts hold about so many words together, and their shard; a batch is bounded in bytes or one long row."""
    held, shard = [], Shard(window)
    for batch in small(batches):
        held.append(batch)
        for text in _texts(batch):
            shard.add(text)
        if shard.size >= shard_words:
            yield held, shard
            held, shard = [], Shard(window)
    if held:
        yield held, shard


class Found:
    """What a shard's search finds in each row: words hit, items, whether a whole window occurs, the longest match."""

    def __init__(self, shard: Shard, blocks: Iterator[TestBlock], names: bool = True):
        starts, rows = shard.starts(), len(shard.lengths)
        lengths = np.array(shard.lengths, np.int64)
        hits = np.zeros(starts[-1] + 1, np.int64)
        self.items, self.whole, self.longest = [set() for _ in range(rows)], np.zeros(rows, bool), np.zeros(rows, np.int64)
        for block in blocks:
            ids = shard.ids(block)
            for (k, where, window), group in ((f, next(g for g in block.groups if g[0] == f[0])) for f in block.search(ids)):
                hits += np.bincount(where, minlength=len(hits)) - np.bincount(where + k, minlength=len(hits))
                row = np.searchsorted(starts, where, "right") - 1
                if k == block.window:
                    self.whole[row] = True
                if not names:
                    continue
                for r, c in np.unique(np.stack([row, group[5][window]], 1), axis=0).tolist():
                    self.items[r] |= block.owned[c]
                np.maximum.at(self.longest, row, k)
                if k == block.window:
                    self._follow(block, ids, np.unique(where), starts)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(hits) > 0)])
        self.n_words, self.n_hit = lengths, hit[starts[:-1] + lengths] - hit[starts[:-1]]

    def _follow(self, block: TestBlock, ids: np.ndarray, where: np.ndarray, starts: np.ndarray) -> None:
        """Lengthens the longest matches by the windows that follow each other."""
        first = np.flatnonzero(np.diff(where, prepend=-2) != 1)
        last = np.append(first[1:], len(where)) - 1
        row = np.searchsorted(starts, where[first], "right") - 1
        for r, a, b in zip(row.tolist(), where[first].tolist(), (where[last] + block.window).tolist(), strict=True):
            if b - a > self.longest[r]:
                self.longest[r] = block.longest(ids[a:b].astype(">u4").tobytes(), int(self.longest[r]))


def _matches(shard: Shard, blocks: Iterator[TestBlock]) -> list[tuple]:
    """All longest verbatim matches: (row, item, item word, word, words)."""
    starts, out = shard.starts(), []
    for block in blocks:
        for (k, where, window), group in ((f, next(g for g in block.groups if g[0] == f[0])) for f in block.search(shard.ids(block))):
            n = np.diff(group[3])[window]
            who = group[4][np.repeat(group[3][window], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            where, item, offset = np.repeat(where, n), who[:, 0], who[:, 1]
            order = np.lexsort((where, where - offset, item))
            where, item, offset = where[order], item[order], offset[order]
            row = np.searchsorted(starts, where, "right") - 1
            new = np.concatenate([[True], (item[1:] != item[:-1]) | (where[1:] != where[:-1] + 1) | (offset[1:] != offset[:-1] + 1)])
            ends = np.concatenate([np.flatnonzero(new)[1:], [len(new)]]) - 1
            for a, b in zip(np.flatnonzero(new).tolist(), ends.tolist(), strict=True):
                out.append((int(row[a]), block.ids[item[a]], int(offset[a]), int(where[a] - starts[row[a]]), int(where[b] - where[a]) + k))
    return out


def _blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """Broadcasts the benchmark in blocks; returns a function that gives them to a worker one by one."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    context, sent = benchmark.sparkSession.sparkContext, []
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        sent.append(context.broadcast([(r.item_id, r.text.encode()) for r in part.collect()]))
    kept: dict[int, TestBlock] = {}

    def blocks() -> Iterator[TestBlock]:
        for i, s in enumerate(sent):
            if i not in kept:
                kept.clear()  # one block at a time is in memory
                kept[i] = TestBlock(s.value, window)
                s.__dict__.pop("_value", None)
            yield kept[i]

    return blocks


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def _contaminated(n_hit, n_words) -> bool:
    return bool(n_hit > 0 and 20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match for every row.

    Null and empty texts have no words and no hits; an item that is null or has no word has
    no window; an item repeated under one id counts once; a null item id counts as the empty
    string; an empty benchmark hits nothing. Repeated documents are judged row by row. A text of any length is searched whole.
    """
    blocks = _blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, shard in _shards(batches, window, shard_words):
            f = Found(shard, blocks())
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in f.items]
            bad = [_contaminated(h, n) for h, n in zip(f.n_hit.tolist(), f.n_words.tolist(), strict=True)]
            ids = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            columns = [ids, pa.array(f.n_words, pa.int64()), pa.array(f.n_hit, pa.int64()), pa.array([len(x) for x in f.items], pa.int64()), pa.array(digest), pa.array(bad), pa.array(f.longest, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """All longest verbatim matches: doc_id, item_id (string), item_word, doc_word, n_words; one row for each item that has the passage."""
    blocks = _blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, shard in _shards(batches, window, shard_words):
            found = _matches(shard, blocks())
            at = pa.array([m[0] for m in found], pa.int64())
            rest = [pa.array([m[i] for m in found], pa.string() if i == 1 else pa.int64()) for i in range(1, 5)]
            ids = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(at), *rest], ["doc_id", "item_id", "item_word", "doc_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id string, item_word long, doc_word long, n_words long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no whole window of the benchmark.

    One verbatim window is enough, however long the document. Items of fewer words than a window say little by
    themselves, so a document that holds only such ones goes if they are a twentieth of its words or more.
    Null and empty texts stay, repeated rows are judged one by one, an empty benchmark removes nothing.
    """
    blocks = _blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, shard in _shards(batches, window, shard_words):
            f, first = Found(shard, blocks(), names=False), 0
            bad = [w or _contaminated(h, n) for w, h, n in zip(f.whole.tolist(), f.n_hit.tolist(), f.n_words.tolist(), strict=True)]
            for batch in held:
                yield batch.filter(pa.array([not x for x in bad[first : first + batch.num_rows]], pa.bool_()))
                first += batch.num_rows

    return docs.mapInArrow(run, docs.schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3_SQL = f"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
bw AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT item_id, k, j, array_to_string(list_slice(w, j, j + k - 1), ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM bw)),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT rid, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT rid, i, j, dwin.k, item_id FROM dwin JOIN win ON dwin.k = win.k AND dwin.s = win.s),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid),
runs AS (SELECT rid, max(n) AS longest FROM (SELECT rid, max(i + k) - min(i) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, item_id, i - j ORDER BY i) AS g FROM hit) GROUP BY rid, item_id, i - j, g) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM dw LEFT JOIN words USING (rid) LEFT JOIN ids USING (rid) LEFT JOIN runs USING (rid)
"""
