"""Token files: every id in as few bits as the vocabulary needs, in blocks with offsets.

A block holds whole documents: their ids and counts, and one payload of fixed-width ids,
most significant bit first. As the width is fixed, the ids from place a to b of a block are
found without decoding what precedes them, and a whole block is unpacked by numpy at once.
Blocks are rows of Parquet files, as these can be written to and read from any store that
Spark reaches, and as a lost task leaves nothing behind.

Texts are encoded by the tokenizers library. What lies between blanks is encoded once and
kept, as blanks end every piece of a text for this vocabulary; a word of Latin letters with
end marks is put together from the word and its marks. Both are exact and tested.

Scale: one range shuffle by document id, none for the read-back; a block's place is the
sum of the counts of the partitions before it, one number for each partition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, table

END_ID = 2
BLOCK_IDS = 1 << 18
CACHE_ENTRIES = 500_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return wide[:, 4 - bits // 8 :].tobytes()
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :].ravel()).tobytes()


def unpack(payload: bytes, bits: int, start: int, end: int) -> np.ndarray:
    """The ids from place start to end of a payload, reading only the bytes that hold them."""
    first = start * bits // 8
    raw = np.frombuffer(payload, np.uint8, -(-end * bits // 8) - first, first)
    if bits in (8, 16, 32):
        return raw.view(f">u{bits // 8}").astype(np.uint32)
    out = np.zeros((end - start, 4), np.uint8)
    if bits % 8 == 0:
        out[:, 4 - bits // 8 :] = raw.reshape(-1, bits // 8)
        return out.view(">u4").ravel().astype(np.uint32)
    used = np.unpackbits(raw)[start * bits - first * 8 :][: (end - start) * bits].reshape(-1, bits)
    return np.packbits(np.pad(used, ((0, 0), (32 - bits, 0))), axis=1).view(">u4").ravel().astype(np.uint32)


class Generations(dict):
    """A bounded cache: when it is full, only what was used since the last time is kept."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Encodes texts with a tokenizer whose pre-tokenizer never joins what blanks divide."""

    #: A word and its end marks; an apostrophe could start one of the vocabulary's suffixes.
    LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
    MARKS = ".,!?;:#$%&*"
    END = "</w>"

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab(False).items():
            self.ends[i] = token.endswith(self.END)
        self.words: Generations = Generations(self._encode)
        self.chunks: Generations = Generations(self._chunk)
        self.bits = bits_for(self.vocabulary)
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _simple(self, chunk: str) -> tuple[str, str] | None:
        """The word in lower case and its marks, of a chunk that is just these."""
        word = chunk.rstrip(self.MARKS)
        if word.isalpha() and (word.isascii() or self.LATIN.fullmatch(word)):
            return word.lower(), chunk[len(word) :]
        return None

    def _chunk(self, chunk: str) -> bytes:
        found = self._simple(chunk)
        if found is None:
            return self._encode(chunk) if chunk else b""
        return self.words[found[0]] + (self.words[found[1]] if found[1] else b"")

    def _learn(self, texts: list[list[str]]) -> None:
        """Fills the caches for some texts, new words in few calls; each word ends with one end piece."""
        seen: set[str] = set()
        for t in texts:
            seen.update(t)
        chunks, old, simple = self.chunks, self.chunks.old, self._simple
        seen.difference_update(chunks)
        known = list(seen & old.keys())
        chunks.update(zip(known, map(old.__getitem__, known), strict=True))
        seen.difference_update(known)
        new = [(c, *found) for c in seen if (found := simple(c))]
        words = list({w for _, w, _ in new if w not in self.words and w not in self.words.old})
        width = self.kind.itemsize
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, self.kind)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(stops) == len(part):
                raw = ids.tobytes()
                self.words.update(zip(part, (raw[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
        get = self.words.__getitem__
        chunks.update((c, get(w) + get(tail) if tail else get(w)) for c, w, tail in new)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self._learn(split)
        out = [np.frombuffer(b"".join(map(self.chunks.__getitem__, t)), self.kind) for t in split]
        self.chunks.trim()
        self.words.trim()
        return out


@lru_cache(1)
def _encoder(tokenizer_json: str) -> WordEncoder:
    return WordEncoder(tokenizer_json)


def _groups(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of so many characters together; null texts are empty."""
    first, part, size = 0, [], 0
    for i, x in enumerate(texts):
        part.append(x.as_py() or "")
        size += len(part[-1])
        if size >= most:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


BLOCKS = "part int, block int, before long, doc_ids array<{id}>, counts array<long>, bits int, payload binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every text and writes blocks to ``path`` in ascending order of doc_id, nulls first.

    A null or empty text has the end id alone. Rows of one id are in an order that their
    texts fix. An empty table writes no blocks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, not data
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number, before = _encoder(sent.value), TaskContext.get().partitionId(), 0, 0
        names = ["part", "block", "before", "doc_ids", "counts", "bits", "payload"]
        for batch in batches:
            types = pa.list_(batch.column(0).type)
            for first, texts in _groups(batch.column(1)):
                open_ids, open_counts, open_size, a = [], [], 0, first
                for i, ids in enumerate(encoder.encode_batch(texts), first):
                    open_ids += [ids, np.array([end_id], encoder.kind)]
                    open_counts.append(len(ids) + 1)
                    open_size += len(ids) + 1
                    if open_size >= block_ids or i == first + len(texts) - 1:
                        all_ids = np.concatenate(open_ids)
                        payload = pack(all_ids, encoder.bits)
                        columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([batch.column(0)[a : i + 1].to_pylist()], types), pa.array([open_counts], pa.list_(pa.int64())), pa.array([encoder.bits], pa.int32()), pa.array([payload], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names)
                        number, before = number + 1, before + len(all_ids)
                        open_ids, open_counts, open_size, a = [], [], 0, i + 1

    ordered = docs.select("doc_id", "text").withColumn("_t", F.xxhash64("text")).repartitionByRange("doc_id", "_t").sortWithinPartitions("doc_id", "_t").drop("_t")
    ordered.mapInArrow(run, BLOCKS.format(id=id_type)).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with the place of their first id among all ids (start)."""
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_s"))
    # one row for each partition that wrote: as many as the session's shuffle partitions at most
    return blocks.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("_s")).drop("_s", "before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    blocks = read_blocks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                counts = np.array(block["counts"], np.int64)
                ends = np.cumsum(counts)
                ids = unpack(block["payload"], block["bits"], 0, int(ends[-1])).astype("<u4")
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(block["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(block["start"] + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_documents(spark, path)
