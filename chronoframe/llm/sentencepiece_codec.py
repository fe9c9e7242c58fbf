"""SentencePiece encoding and decoding in one pass over an Aho-Corasick automaton.

The automaton holds all pieces. While it reads a text, its output links list every piece
that ends at the current position, longest first, and each relaxes the best segmentation of
the text up to there. For a unigram model the best one has the greatest sum of scores. For
a BPE model the one to keep is that which merging would give: among the pieces that end
here exactly one follows the last piece of the segmentation before it in a way that merging
the two texts leaves both pieces alone, so that this test takes the place of the sum.
Results are those of the sentencepiece library, byte fallback included.

What lies between blanks is segmented once and kept in a bounded cache: no piece has a
blank behind another character, so blanks always end a segment, as do line ends, which the
vocabulary only has as a byte.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, spread, table
from .token_files import Generations

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 250_000


class SentencePieceModel:
    def __init__(self, data: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that keep the text as it is are supported")
        self.unigram, self.prefix = trainer.model_type == trainer.UNIGRAM, norm.add_dummy_prefix
        self.pieces, self.bytes, self.raw, self.unknown = {}, [None] * 256, [], 0
        self.scores: dict[int, float] = {}
        for i, p in enumerate(proto.pieces):
            self.raw.append(p.piece.replace(BLANK, " ").encode() if p.type == kinds.NORMAL else b"")
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.raw[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == kinds.UNKNOWN:
                self.unknown, self.raw[i] = i, b" \xe2\x81\x87 "
            elif p.type == kinds.NORMAL:
                self.pieces[p.piece], self.scores[i] = i, p.score
            elif p.type != kinds.CONTROL:
                raise ValueError(f"pieces of type {p.type} are not supported")
        self.text = {i: p for p, i in self.pieces.items()}
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.inner = any(BLANK in p.lstrip(BLANK) for p in self.pieces)
        self.line_end_known = any("\n" in p for p in self.pieces)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            if self.unigram or self.merge(p) == [i]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: Generations = Generations(self._segment_bytes, CACHE_ENTRIES)

    def merge(self, text: str) -> list[int]:
        """Plain BPE: joins the neighbours of the best score, the leftmost first. Unknown characters are -1 - code point."""
        symbols, pieces, scores = list(text), self.pieces, self.scores
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := pieces.get(both := symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (-scores[i], a, b, both))

        for a in range(len(symbols) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != both or after[a] != b:
                continue
            symbols[a], symbols[b], after[a] = both, "", after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [pieces[s] if s in pieces else -1 - ord(s) for s in symbols if s]

    def _fits(self, p: int, q: int) -> bool:
        found = self.pairs.get((p, q))
        if found is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            found = self.pairs[p, q] = self.merge(self.text[p] + self.text[q]) == [p, q]
        return found

    def segment(self, text: str) -> list[int]:
        """Piece ids of a normalised text; unknown characters are -1 - code point."""
        if not self.unigram and BLANK * 2 in text:
            return self.merge(text)  # runs of blanks have equal scores, which the pair test can't order
        n = len(text)
        last, size = [None] * (n + 1), [1] * (n + 1)
        if self.unigram:
            best, done = [0.0] + [None] * n, 0
            for end, (i, k) in self.automaton.iter(text):
                while done < end + 1 - k or best[done] is None:  # characters that no piece covers
                    if best[done] is None:
                        best[done], size[done] = best[done - 1] + self.unknown_score, 1
                    if done >= end + 1 - k:
                        break
                    done += 1
                score = best[end + 1 - k] + self.scores[i]
                if best[end + 1] is None or score > best[end + 1]:
                    best[end + 1], last[end + 1], size[end + 1] = score, i, k
        else:
            for end, (i, k) in self.automaton.iter(text):
                if last[end + 1] is None:
                    p = last[end + 1 - k]
                    if p is None or self._fits(p, i):
                        last[end + 1], size[end + 1] = i, k
        out, at = [], n
        while at:
            out.append(last[at] if last[at] is not None else -1 - ord(text[at - 1]))
            at -= size[at]
        return out[::-1]

    def _segment_bytes(self, text: str) -> bytes:
        ids: list[int] = []
        for i in self.segment(text):
            if i >= 0:
                ids.append(i)
            elif self.bytes[0] is not None:
                ids += [self.bytes[b] for b in chr(-1 - i).encode("utf-8", "replace")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        text = (" " if self.prefix else "") + text.replace(BLANK, " ")
        if self.inner:
            return np.frombuffer(self._segment_bytes(text.replace(" ", BLANK)), "<u4")
        if "  " in text or text[0] != " " or text[-1] == " " or self.line_end_known:
            parts = re.findall(r"\n| +[^ \n]*|[^ \n]+" if not self.line_end_known else r" +[^ ]*|[^ ]+", text)
        else:
            parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if "\0" not in text else re.findall(r"\n| +[^ \n]*|[^ \n]+", text)
        out = b"".join(map(self.cache.__getitem__, parts))
        self.cache.trim()
        return np.frombuffer(out, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that was encoded."""
        out = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return out[1:] if self.prefix and out[:1] == b" " else out


# The cache's keys have plain blanks, so that splitting needs no copy with wider characters.
_segment = SentencePieceModel._segment_bytes
SentencePieceModel._segment_bytes = lambda self, part: _segment(self, part.replace(" ", BLANK)) if part else b""


@lru_cache(2)
def load_model(data: bytes) -> SentencePieceModel:
    return SentencePieceModel(data)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """All columns of ``docs`` but text, and ids (array of int), round_trip (decoding gives the text).

    A null text has no ids and round_trip true, as the empty one. Bytes that are no UTF-8 are read as replacement
    characters, so such a text has no round trip. A column that is called ids or round_trip already is left out. Repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_read(model_path))  # a vocabulary file, not data
    names = [c for c in docs.columns if c not in ("text", "ids", "round_trip")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(sent.value)
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            part = texts.cast(pa.binary()).to_pylist()
            ids = [model.encode(t.decode(errors="replace")) if t else np.zeros(0, "<u4") for t in part]
            same = [model.decode(x) == (t or b"") for x, t in zip(ids, part, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(same)], [*names, "ids", "round_trip"])

    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add("ids", T.ArrayType(T.IntegerType())).add("round_trip", T.BooleanType())
    return docs.select(*[F.col(f"`{c}`") for c in [*names, "text"]]).mapInArrow(run, schema)


def codec_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian 32-bit), decoded_crc32 (UTF-8), round_trip of every row.

    A null text has no pieces, as the empty one. Bytes that are no UTF-8 are read as replacement characters, so such a text has
    no round trip. Repeated rows and ids give one row each, equal texts equal values, an empty table none; further columns are left aside.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(sent.value)
        for batch in small(batches):
            rows: list[tuple] = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                ids = model.encode(text.decode(errors="replace")) if text else np.zeros(0, "<u4")
                back = model.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back), back == (text or b"")))
            columns = [pa.array([r[k] for r in rows], pa.bool_() if k == 3 else pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digest(spread(table(spark, sf_dir, "documents")), model_path())
