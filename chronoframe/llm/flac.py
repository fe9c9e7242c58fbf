"""FLAC media columns: bytes stored as 8-bit mono samples, and read back.

Encoding chooses for every frame the smallest of a constant, plain samples, and fixed linear
predictors of order 0 to 2 with Rice-coded residuals. Every file has a seek table with one
point a frame, so each frame's samples can be found and decoded on their own. Decoding knows
constant, plain, fixed (order 0 to 4) and LPC subframes, Rice partitions with 4- and 5-bit
parameters and escapes, verifies the checksums of all headers and frames and the MD5 of the
samples, and gives PCM blocks with their sample offsets.

Both work on the frames of many files at once: bits are placed by numpy over runs of about ``RUN`` samples, and
decoding steps through the frames side by side, one code of each at a time. Files are
made and read where their row is, without a shuffle; a worker holds the payloads of ``GROUP``
bytes, or one longer row, and the arrays of one run.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import materialize, small, spread, table

BLOCK = 4096
RATE = 16_000
UNIT = 64
GROUP = 4 << 20
RUN = 4 << 20
_POINT = np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")])


def _crc_tables(polynomial: int, bits: int, n: int) -> np.ndarray:
    """Table j advances a byte's remainder by j bytes more."""
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, np.zeros((n, 256), np.uint32)
    for b in range(256):
        r = b << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ polynomial if r & top else r << 1) & mask
        out[0, b] = r
    for j in range(1, n):
        out[j] = (out[j - 1] << 8 & mask) ^ out[0][out[j - 1] >> (bits - 8)]
    return out


_CRC8 = _crc_tables(0x07, 8, 1)[0].tolist()
_CRC16 = _crc_tables(0x8005, 16, 8)
_ZEROS = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.uint8)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16_many(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many slices. They are aligned at their ends: zeros in front don't change it."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(ends - starts, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 512)):
        if not len(part):
            continue
        n = -(-int((ends - starts)[part].max()) // 8) * 8
        at = ends[part][None, :] - n + np.arange(n)[:, None]
        data = np.where(at >= starts[part][None, :], buffer[np.maximum(at, 0)], 0).astype(np.intp)
        c = np.zeros(len(part), np.intp)
        for i in range(0, n, 8):
            d = data[i : i + 8]
            c = (_CRC16[7][d[0] ^ c >> 8] ^ _CRC16[6][d[1] ^ c & 255] ^ _CRC16[5][d[2]] ^ _CRC16[4][d[3]] ^ _CRC16[3][d[4]] ^ _CRC16[2][d[5]] ^ _CRC16[1][d[6]] ^ _CRC16[0][d[7]]).astype(np.intp)
        out[part] = c
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < 1 << (6 - len(tail)):
            return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])


def _frame_header(number: int, size: int) -> bytes:
    code, extra = (0xC, b"") if size == BLOCK else (0x6, bytes([size - 1])) if size <= 256 else (0x7, struct.pack(">H", size - 1))
    head = b"\xff\xf8" + bytes([code << 4 | 0x5, 0x02]) + _number(number) + extra  # 16 kHz, mono, 8 bits
    return head + bytes([crc8(head)])


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, dtype=np.int64)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of frames that hold about so many samples together."""
    run = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    return zip(cuts, cuts[1:], strict=False)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """One FLAC file for each payload; none may be empty. Works on runs of frames of about RUN samples."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    file_starts = np.concatenate([[0], np.cumsum(sizes)])
    per_file = -(-sizes // BLOCK)
    file_of = np.repeat(np.arange(len(sizes)), per_file)
    number = np.arange(len(file_of)) - np.repeat(np.cumsum(per_file) - per_file, per_file)
    starts = file_starts[file_of] + number * BLOCK
    ends = np.minimum(starts + BLOCK, file_starts[file_of + 1])
    done = [_encode_frames(joined[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a], number[a:b]) for a, b in _runs(ends - starts, RUN)]
    frames, frame_bytes = b"".join(d[0] for d in done), np.concatenate([d[1] for d in done])
    file_frames, frame_starts, files = np.concatenate([[0], np.cumsum(per_file)]), np.cumsum(frame_bytes) - frame_bytes, []
    for i, size in enumerate(sizes.tolist()):
        a, b = int(file_frames[i]), int(file_frames[i + 1])
        small, large = int(frame_bytes[a:b].min()), int(frame_bytes[a:b].max())
        md5 = hashlib.md5((joined[file_starts[i] : file_starts[i + 1]] ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + small.to_bytes(3, "big") + large.to_bytes(3, "big") + (RATE << 44 | 7 << 36 | size).to_bytes(8, "big") + md5
        points = np.zeros(b - a, _POINT)
        points["s"], points["o"], points["n"] = starts[a:b] - file_starts[i], frame_starts[a:b] - frame_starts[a], (ends - starts)[a:b]
        seek = points.tobytes()
        files.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frames[frame_starts[a] : frame_starts[b - 1] + frame_bytes[b - 1]])
    return files


def _encode_frames(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The frames from ``starts`` to ``ends``, one after the other, and the bytes of each."""
    samples = joined.astype(np.int32) - 128
    n, frame_of = ends - starts, np.repeat(np.arange(len(starts)), ends - starts)
    offset = np.arange(len(samples)) - starts[frame_of]

    # the cost of every kind in bits: plain samples, a constant, fixed predictors
    low, high = np.minimum.reduceat(samples, starts), np.maximum.reduceat(samples, starts)
    best, kind, rice = np.where(low == high, 8, 8 * n), np.where(low == high, -2, -1), np.zeros(len(n), np.int64)
    residuals, difference = [], samples
    for order in range(3):
        if order:
            difference = np.diff(difference, prepend=np.int32(0))
        u = difference << 1 ^ difference >> 31
        u[offset < order] = 0
        residuals.append(u)
        mean = _sums(u, starts) / np.maximum(n - order, 1)
        k = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.7 + 1e-9)), 0, 14).astype(np.int64)
        cost = _sums(u >> k[frame_of].astype(np.int32), starts) + (1 + k) * (n - order) + 8 * order + 10
        better = cost < best
        best, kind, rice = np.where(better, cost, best), np.where(better, order, kind), np.where(better, k, rice)

    headers = [_frame_header(a, b) for a, b in zip(number.tolist(), n.tolist(), strict=True)]
    head = np.array([len(h) for h in headers], np.int64)
    frame_bytes = head + 1 + (best + 7) // 8 + 2
    frame_starts = np.cumsum(frame_bytes) - frame_bytes
    total = int(frame_bytes.sum())

    # Rice codes: ones and remainders end at known bits; those of one 64-bit word are summed
    words = np.zeros(total // 8 + 3, np.uint64)
    coded = kind >= 0
    if coded.any():
        take = coded[frame_of] & (offset >= np.maximum(kind, 0)[frame_of])
        f = frame_of[take]
        u = np.choose(np.maximum(kind, 0)[f], [r[take] for r in residuals]).astype(np.int64)
        k = rice[f]
        length = (u >> k) + 1 + k
        stop = np.cumsum(length)
        first = np.flatnonzero(np.diff(f, prepend=-1))
        begin = (frame_starts + head + 1 + np.maximum(kind, 0)) * 8 + 10
        stop += np.repeat(begin[f[first]] - (stop[first] - length[first]), np.diff(np.append(first, len(f))))
        value = (np.int64(1) << k | u & (np.int64(1) << k) - 1).astype(np.uint64)
        parameter = np.flatnonzero(coded)
        last = stop - 1
        word, shift = last >> 6, (63 - (last & 63)).astype(np.uint64)
        runs = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[runs]] |= np.bitwise_or.reduceat(value << shift, runs)
        over = np.flatnonzero((last & 63) < k)
        np.bitwise_or.at(words, word[over] - 1, value[over] >> (np.uint64(64) - shift[over]))
        last = begin[parameter] - 1
        word, shift = last >> 6, (63 - (last & 63)).astype(np.uint64)
        np.bitwise_or.at(words, word, rice[parameter].astype(np.uint64) << shift)
        over = (last & 63) < 9
        np.bitwise_or.at(words, word[over] - 1, np.where(shift[over] > 0, rice[parameter].astype(np.uint64)[over] >> (np.uint64(64) - np.maximum(shift[over], 1)), 0))
    out = words.astype(">u8").view(np.uint8)[:total]
    raw = (joined ^ 0x80).tobytes()
    view = memoryview(out)
    for i, (at, h, kd, a, b) in enumerate(zip(frame_starts.tolist(), headers, kind.tolist(), starts.tolist(), ends.tolist(), strict=True)):
        body = at + len(h)
        view[at:body] = h
        if kd == -1:
            view[body : body + 1 + b - a] = b"\x02" + raw[a:b]
        elif kd == -2:
            view[body : body + 2] = b"\x00" + raw[a : a + 1]
        else:
            view[body : body + 1 + kd] = bytes([0x10 | kd << 1]) + raw[a : a + kd]
    crc = crc16_many(out, frame_starts, frame_starts + frame_bytes - 2)
    out[frame_starts + frame_bytes - 2], out[frame_starts + frame_bytes - 1] = crc >> 8, crc & 255
    return out.tobytes(), frame_bytes


class FlacError(ValueError):
    """The stored bytes are not the FLAC that this module reads, or a checksum fails."""


def read_header(media: bytes) -> tuple[dict, np.ndarray | None, int]:
    """(stream info, seek points or None, where the frames begin)."""
    if media[:4] != b"fLaC":
        raise FlacError("no FLAC file")
    at, info, points, last = 4, None, None, False
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[2:4], "big"), "rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = np.frombuffer(body, _POINT)
        at += 4 + size
    if info is None or info["channels"] != 1 or info["bits"] != 8:
        raise FlacError("only mono files of 8 bits are read")
    return info, points, at


def _frame(media, at: int) -> tuple[int, int]:
    """(samples, where the subframe begins) of the frame at a place; checks the header's checksum."""
    if media[at] != 0xFF or media[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should be")
    code, rate, lead, i = media[at + 2] >> 4, media[at + 2] & 15, media[at + 4], at + 5
    if media[at + 3] >> 4:
        raise FlacError("only mono files are read")
    while lead & 0xC0 == 0xC0:
        lead, i = lead << 1 & 0xFF, i + 1
    if code == 6:
        size, i = media[i] + 1, i + 1
    elif code == 7:
        size, i = (media[i] << 8 | media[i + 1]) + 1, i + 2
    else:
        size = 192 if code == 1 else 576 << code - 2 if 2 <= code <= 5 else 256 << code - 8
    i += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(bytes(media[at:i])) != media[i]:
        raise FlacError("a frame header's checksum fails")
    return size, i + 1


class _Bits:
    """Reads the same number of codes from many places of a buffer at once."""

    def __init__(self, buffer: np.ndarray):
        b = np.concatenate([buffer, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]

    def read(self, at: np.ndarray, n) -> np.ndarray:
        """n (up to 25) bits from each place, unsigned."""
        x = self.words[at >> 3] << (at & 7).astype(np.uint32)
        return (x >> np.uint32(1)) >> (np.asarray(31 - n).astype(np.uint32))

    def unary(self, at: np.ndarray) -> np.ndarray:
        x = self.words[at >> 3] << (at & 7).astype(np.uint32)
        zeros = _ZEROS[x >> np.uint32(16)].astype(np.int64)
        more = np.flatnonzero(zeros == 16)
        while len(more):
            again = at[more] + zeros[more]
            if int(again.max(initial=0)) >> 3 >= len(self.words):
                raise FlacError("a code runs over the end")
            x = self.words[again >> 3] << (again & 7).astype(np.uint32)
            z = _ZEROS[x >> np.uint32(16)].astype(np.int64)
            zeros[more] += z
            more = more[z == 16]
        return zeros


def _residuals(bits: _Bits, at: np.ndarray, sizes: np.ndarray, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals by place (samples x frames) and where each frame's residual ends.

    Frames come in falling size; all have the same partitions, and if these are several,
    the same size and order.
    """
    method, partitions = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any():
        raise FlacError("a reserved residual coding")
    wide, parts = np.where(method == 1, 5, 4), 1 << int(partitions[0])
    at, out = at + 6, np.zeros((int(sizes[0]), len(sizes)), np.int32)
    first = int(orders.min())
    per = int(sizes[0]) // parts
    k = raw = None
    for i in range(first, int(sizes[0])):
        live = int(np.searchsorted(-sizes, -i, "left"))  # frames longer than i
        if k is None or parts > 1 and i % per == 0:
            k = bits.read(at, wide).astype(np.int64)
            escape = k == (1 << wide) - 1
            raw = np.where(escape, bits.read(at + wide, 5).astype(np.int64), -1)
            at = at + wide + np.where(escape, 5, 0)
            any_raw, deep = bool(escape.any()), int(k.max()) > 8
        a, kk = at[:live], k[:live]
        if any_raw or deep or first < int(orders.max()):
            mine = np.flatnonzero(orders[:live] <= i)
            z = np.where(raw[mine] >= 0, 0, bits.unary(a[mine]))
            here = a[mine] + np.where(raw[mine] >= 0, 0, z + 1)
            n = np.where(raw[mine] >= 0, raw[mine], kk[mine])
            v = bits.read(here, np.minimum(n, 25)).astype(np.int64)
            u = z << n | v
            signed = np.where(n > 0, v - ((v >> np.maximum(n - 1, 0) & 1) << n), 0)
            out[i, mine] = np.where(raw[mine] >= 0, signed, u >> 1 ^ -(u & 1))
            at[mine] = here + n
            continue
        x = bits.words[a >> 3] << (a & 7).astype(np.uint32)
        z = _ZEROS[x >> np.uint32(16)].astype(np.int64)
        if z.max(initial=0) == 16:
            z = bits.unary(a)
            v = bits.read(a + z + 1, kk).astype(np.int64)
        else:
            v = ((x << (z + 1).astype(np.uint32)) >> np.uint32(1) >> (31 - kk).astype(np.uint32)).astype(np.int64)
        u = z << kk | v
        out[i, :live] = u >> 1 ^ -(u & 1)
        at[:live] += z + 1 + kk
    return out, at


def _signed(x: np.ndarray, n: int) -> np.ndarray:
    return x.astype(np.int64) - ((x.astype(np.int64) >> (n - 1) & 1) << n)


def _decode_frames(buffer: np.ndarray, sizes: np.ndarray, bodies: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples (unsigned bytes) and the place of the checksum of each frame."""
    bits, kinds = _Bits(buffer), buffer[bodies] >> 1
    if (buffer[bodies] & 0x81).any():
        raise FlacError("wasted bits are not read")
    out: list = [None] * len(sizes)
    ends = np.zeros(len(sizes), np.int64)
    predicted: dict[tuple, list[int]] = {}
    for i, (kind, n, at) in enumerate(zip(kinds.tolist(), sizes.tolist(), bodies.tolist(), strict=True)):
        if kind == 0:
            out[i], ends[i] = np.full(n, buffer[at + 1] ^ 0x80, np.uint8), at + 2
        elif kind == 1:
            out[i], ends[i] = buffer[at + 1 : at + 1 + n] ^ 0x80, at + 1 + n
        elif 8 <= kind <= 12:
            predicted.setdefault(("fixed", kind - 8), []).append(i)
        elif kind >= 32:
            predicted.setdefault(("lpc", kind - 31), []).append(i)
        else:
            raise FlacError("a reserved subframe")
    for (how, order), frames in predicted.items():
        frames = np.array(frames)
        begin = (bodies[frames] + 1 + order) * 8
        if how == "lpc":
            precision, shift = bits.read(begin, 4).astype(np.int64) + 1, bits.read(begin + 4, 5).astype(np.int64)
            factors = np.zeros((order, len(frames)), np.int64)
            for j in range(order):
                v = bits.read(begin + 9 + j * precision, precision).astype(np.int64)
                factors[j] = v - ((v >> (precision - 1) & 1) << precision)
            begin = begin + 9 + order * precision
        groups: dict[tuple, list[int]] = {}
        for j, p in enumerate(bits.read(begin + 2, 4).tolist()):
            groups.setdefault((p, int(sizes[frames[j]]) if p else 0), []).append(j)
        for members in groups.values():
            members = np.array(members)[np.argsort(-sizes[frames[members]], kind="stable")]
            lanes = frames[members]
            r, stop = _residuals(bits, begin[members].copy(), sizes[lanes], np.full(len(lanes), order))
            ends[lanes] = (stop + 7) // 8
            warm = _signed(buffer[bodies[lanes][None, :] + 1 + np.arange(order)[:, None]], 8)
            if how == "fixed":
                steps = [warm]
                for _ in range(order):
                    steps.append(np.diff(steps[-1], axis=0))
                x = r[order:].astype(np.int64)
                for d in range(order - 1, -1, -1):
                    x = np.concatenate([steps[d][order - 1 - d :], x]) if d == order - 1 else np.concatenate([steps[d][order - 1 - d :][:1], x])
                    x = np.cumsum(x, axis=0)
                    x = x[1:] if d else x
                x = np.concatenate([warm[: order - 1], x]) if order > 1 else x
            else:
                x = np.concatenate([warm, r[order:].astype(np.int64)])
                c, s = factors[:, members], shift[members]
                for i in range(order, len(x)):
                    x[i] += (c * x[i - order : i][::-1]).sum(0) >> s
            x = (x + 128).astype(np.uint8)
            for j, lane in enumerate(lanes.tolist()):
                out[lane] = x[: sizes[lane], j]
    return out, ends


def decode_many(files: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks (first sample, samples as unsigned bytes) of each file, all checksums verified."""
    buffer = np.frombuffer(b"".join(files), np.uint8)
    base, owner, sizes, bodies, heads, firsts, infos = 0, [], [], [], [], [], []
    alone: dict[int, list[tuple[int, bytes]]] = {}
    for i, media in enumerate(files):
        info, points, at = read_header(media)
        infos.append(info)
        places = (at + points["o"].astype(np.int64)).tolist() if points is not None and int(points["n"].astype(np.int64).sum()) == info["samples"] else None
        if places is None:
            alone[i] = _decode_in_order(media, info, at)
        else:
            first = 0
            for place in places:
                n, body = _frame(media, place)
                owner.append(i), sizes.append(n), heads.append(base + place), bodies.append(base + body), firsts.append(first)
                first += n
        base += len(media)
    out: list[list[tuple[int, bytes]]] = [[] for _ in files]
    if owner:
        heads_, sizes_, bodies_ = np.array(heads), np.array(sizes), np.array(bodies)
        for a, b in _runs(sizes_, RUN):
            base = heads[a]
            part = buffer[base : heads[b] if b < len(heads) else len(buffer)]
            samples, ends = _decode_frames(part, sizes_[a:b], bodies_[a:b] - base)
            _verify(part, heads_[a:b] - base, ends)
            for i, first, block in zip(owner[a:b], firsts[a:b], samples, strict=True):
                out[i].append((first, block.tobytes()))
    for i, blocks in alone.items():
        out[i] = blocks
    for blocks, info in zip(out, infos, strict=True):
        pcm = b"".join(b for _, b in blocks)
        if len(pcm) != info["samples"] or any(info["md5"]) and hashlib.md5(pcm.translate(_FLIP)).digest() != info["md5"]:
            raise FlacError("the samples' checksum fails")
    return out


_FLIP = bytes(b ^ 0x80 for b in range(256))


def _verify(buffer: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> None:
    if int(ends.max()) + 2 > len(buffer) or (crc16_many(buffer, heads, ends) != (buffer[ends].astype(np.uint32) << 8 | buffer[ends + 1])).any():
        raise FlacError("a frame's checksum fails")


def _decode_in_order(media: bytes, info: dict, at: int) -> list[tuple[int, bytes]]:
    """For files without a full seek table: a frame's end is known once it is decoded."""
    buffer, first, out = np.frombuffer(media, np.uint8), 0, []
    while first < info["samples"]:
        n, body = _frame(media, at)
        samples, ends = _decode_frames(buffer, np.array([n]), np.array([body]))
        _verify(buffer, np.array([at]), ends)
        out.append((first, samples[0].tobytes()))
        first, at = first + n, int(ends[0]) + 2
    return out


def payload_of(text: bytes | None) -> bytes:
    """The text and zeros up to a positive multiple of 64 bytes."""
    text = text or b""
    return text + bytes(UNIT * max(1, -(-len(text) // UNIT)) - len(text))


def _feature(pcm: bytes) -> str:
    """Exact whole numbers of the samples: sum, sum of squares, peak, sign changes."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    return f"sum={x.sum()};squares={(x * x).sum()};peak={np.abs(x).max()};crossings={np.count_nonzero(np.diff(x < 0))}"


def _groups(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(payload_of(t))
        size += len(part[-1])
        if size >= GROUP:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a FLAC file of the padded text); a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2048):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for first, part in _groups(texts):
                n = [len(t or b"") for t in texts[first : first + len(part)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(n, pa.int64()), pa.array(encode_many(part), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """One row for each block of each file: doc_id, block, first_sample, pcm (unsigned bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2048):
            for i in range(0, batch.num_rows, 256):
                rows = [(i + j, k, first, pcm) for j, blocks in enumerate(decode_many(batch.column(1)[i : i + 256].to_pylist())) for k, (first, pcm) in enumerate(blocks)]
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], ["doc_id", "block", "first_sample", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, block int, first_sample long, pcm binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores every text in a media column in the shared folder, reads the stored bytes back, and describes both; see the columns below.

    A null text is empty; the payload of an empty text is 64 zeros. Equal texts give equal rows, repeated and null ids
    one row for each row, an empty table none. Further columns are left aside.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    stored = materialize(encode_media(docs), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            files, rows = batch.column(2).to_pylist(), []
            for media, blocks in zip(files, decode_many(files), strict=True):
                pcm = b"".join(b for _, b in blocks)
                rows.append((len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), _feature(pcm)))
            columns = [pa.array([r[k] for r in rows], pa.string() if k in (1, 4, 5) else pa.int64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    types = ["long", "long", "string", "long", "long", "string", "string"]
    schema = ", ".join(f"{a} {b}" for a, b in zip(names, [docs.schema["doc_id"].dataType.simpleString(), *types], strict=True))
    return stored.mapInArrow(run, schema)


def op7_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(spread(table(spark, sf_dir, "documents")))
