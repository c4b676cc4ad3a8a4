"""FLAC media columns: streams are decoded to PCM blocks with seekable sample offsets.

The decoder reads Rice residuals and linear predictors, verifies each frame's header and frame
checksums and the stream's MD5, and gives PCM blocks by first sample. All frames of a batch of
streams are decoded side by side: a step takes the next sample of every frame, so the bit work is done
by whole-array operations whatever the number of streams. The encoder makes such streams from raw
8-bit samples: per frame the better of four linear predictors, each with its best Rice parameter, or verbatim.

Both are narrow passes: no shuffle, memory bounded by a piece of streams. Blocks are a column that a
table keeps; ``pcm_range`` reads samples out of it by the blocks that hold them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from .common import add_columns, stored, table

#: Samples of an encoded frame, and the rate that the streams name.
BLOCK, RATE = 1024, 8000
#: Fixed values of the format: block sizes by code, and sample sizes by code.
BLOCK_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
SAMPLE_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
RATE_BYTES = {12: 1, 13: 2, 14: 2}
FIXED_COEFFICIENTS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Streams are worked on together up to about so many bytes, and rows.
CHUNK_BYTES, PIECE = 1 << 20, 2048


def _crc_table(poly: int, bits: int, length: int) -> np.ndarray:
    """Row j: what a byte followed by j zero bytes adds to the checksum."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    row = np.arange(256) << (bits - 8)
    for _ in range(8):
        row = np.where(row & top, (row << 1) ^ poly, row << 1) & mask
    rows = [row]
    for _ in range(length - 1):
        last = rows[-1]
        rows.append(row[(last >> (bits - 8)) & 255] ^ ((last << 8) & mask))
    return np.stack(rows).astype(np.uint16)


_CRC8 = _crc_table(0x07, 8, 1)[0].tolist()
_CRC16_BYTES = 4096
_CRC16 = _crc_table(0x8005, 16, _CRC16_BYTES)
#: What a checksum's two bytes become when _CRC16_BYTES zero bytes follow.
_CRC16_HIGH, _CRC16_LOW = (_crc_table(0x8005, 16, _CRC16_BYTES + 1)[j] for j in (_CRC16_BYTES - 1, _CRC16_BYTES - 2))


def crc8(data: bytes) -> int:
    out = 0
    for b in data:
        out = _CRC8[out ^ b]
    return out


def crc16(data: np.ndarray) -> int:
    """Of bytes, as an array; longer ones go piece by piece."""
    out, n = 0, len(data)
    head = n % _CRC16_BYTES
    if head:
        out = int(np.bitwise_xor.reduce(_CRC16[np.arange(head - 1, -1, -1), data[:head]]))
    for at in range(head, n, _CRC16_BYTES):
        out = int(_CRC16_HIGH[out >> 8] ^ _CRC16_LOW[out & 255])
        out ^= int(np.bitwise_xor.reduce(_CRC16[np.arange(_CRC16_BYTES - 1, -1, -1), data[at : at + _CRC16_BYTES]]))
    return out


def crc16s(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each of the spans of the bytes, all at once; none is empty, and those that are longer than the table go one by one."""
    short = np.flatnonzero(sizes <= _CRC16_BYTES)
    out = np.zeros(len(starts), np.uint16)
    if len(short):
        at, n = starts[short], sizes[short]
        first = np.cumsum(n) - n
        place = np.repeat(at - first, n) + np.arange(int(n.sum()))
        row = np.repeat(at + n - 1, n) - place
        out[short] = np.bitwise_xor.reduceat(_CRC16.ravel()[row << 8 | data[place]], first)
    for j in np.flatnonzero(sizes > _CRC16_BYTES).tolist():
        out[j] = crc16(data[int(starts[j]) : int(starts[j] + sizes[j])])
    return out


def coded_number(n: int) -> bytes:
    """A frame's or sample's number, as UTF-8 codes characters, extended to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size & 0xFF) | n, *reversed(tail)])


def read_coded(data: bytes, at: int) -> tuple[int, int]:
    """The number at ``at``, and where what follows starts."""
    lead = data[at]
    if lead < 0x80:
        return lead, at + 1
    size = 8 - (~lead & 0xFF).bit_length()
    if size < 2 or at + size > len(data):
        raise ValueError("bad frame number")
    n = lead & ((1 << (7 - size)) - 1)
    for b in data[at + 1 : at + size]:
        n = n << 6 | b & 0x3F
    return n, at + size


# --- encoding ---------------------------------------------------------------------------------------------------


#: Predictors that an encoder tries: coefficients at 2**-SHIFT. Averages of the last samples predict text.
SHIFT, PREDICTORS = 6, ((), (64,), (36, 16, 8), (20, 12, 10, 8))
#: Rice parameters that an encoder tries.
PARAMETERS = range(2, 8)
_BYTES = np.uint64(0x00FF00FF00FF00FF)
_PAIRS = np.uint64(0x0000FFFF0000FFFF)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` places from each of ``starts`` on, one span after the other."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


@lru_cache(1 << 14)
def frame_head(n: int, number: int) -> bytes:
    """The header of a frame of ``n`` samples."""
    head = bytes([0xFF, 0xF8, 0x70 if n != BLOCK else 0xA0, 0x02]) + coded_number(number) + ((n - 1).to_bytes(2, "big") if n != BLOCK else b"")
    return head + bytes([crc8(head)])


def _zigzag(x: np.ndarray, coefficients: Sequence[int]) -> np.ndarray:
    """The residuals of 8-bit samples as numbers from 0 to 511; products and sums stay below 2**15."""
    predicted = np.zeros_like(x)
    for j, w in enumerate(coefficients, 1):
        predicted[j:] += w * x[:-j]
    residual = x - (predicted >> SHIFT)
    return ((residual << 1) ^ (residual >> 15)).view(np.uint16)


def _unary_sums(u: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """For each of PARAMETERS the sums of ``u >> k`` by frame. Eight numbers are added in a word, which BLOCK numbers of 7 bits don't overflow."""
    words = (u >> PARAMETERS[0]).astype(np.uint8).view(np.uint64)
    for k in PARAMETERS:
        own = words >> np.uint64(k - PARAMETERS[0]) & np.uint64(0x0101010101010101 * (127 >> k - PARAMETERS[0]))
        sums = np.add.reduceat((own & _BYTES) + (own >> np.uint64(8) & _BYTES), bounds >> 3)
        sums = (sums & _PAIRS) + (sums >> np.uint64(16) & _PAIRS)
        yield ((sums & np.uint64(0xFFFFFFFF)) + (sums >> np.uint64(32))).astype(np.int64)


def _packed(code: np.ndarray, end: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bytes that hold each code, of up to 8 bits, before the bit ``end``; ends rise, and other bits are 0."""
    words = np.zeros(-(-n_bytes // 8), np.uint64)
    last = end - 1
    word, left = last >> 6, (~last & 63).astype(np.uint64)
    code = code.astype(np.uint64)
    first = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
    words[word[first]] = np.bitwise_or.reduceat(code << left, first)
    over = np.flatnonzero(left > 56)
    before = code[over] >> (np.uint64(64) - left[over])
    over = over[before > 0]  # at most one code goes over a word's start
    words[word[over] - 1] |= before[before > 0]
    return words.byteswap().view(np.uint8)[:n_bytes]


def encode(payloads: Sequence[bytes]) -> list[bytes]:
    """A stream for each payload of unsigned 8-bit samples, with a seek point for every frame."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    held = -(-sizes // 8) * 8  # each payload starts a word
    raw = np.frombuffer(b"".join(part for p in payloads for part in (p, bytes(-len(p) % 8))), np.uint8)
    signed = raw ^ 128
    x = signed.view(np.int8).astype(np.int16)
    counts = -(-sizes // BLOCK)
    n_frames = int(counts.sum())
    number = _spans(np.zeros(len(sizes), np.int64), counts)
    bounds = np.repeat(np.cumsum(held) - held, counts) + number * BLOCK
    length = np.minimum(np.repeat(sizes, counts) - number * BLOCK, BLOCK)
    room = -(-length // 8) * 8
    gaps = _spans(bounds + length, room - length)

    best_bits, best, best_k = 8 * length + 8, np.full(n_frames, -1), np.full(n_frames, 7)
    zigzags = []
    for c, coefficients in enumerate(PREDICTORS if n_frames else ()):
        order = len(coefficients)
        u = _zigzag(x, coefficients)
        u[gaps] = 0
        for j in range(order):
            u[bounds + j] = 0
        zigzags.append(u)
        header = 8 + 8 * order + (0 if not order else 4 + 5 + 12 * order) + 6 + 4
        for k, unary in zip(PARAMETERS, _unary_sums(u, bounds), strict=True):
            total = header + unary + (length - order) * (1 + k)
            better = (total < best_bits) & (length > order)
            best_bits = np.where(better, total, best_bits)
            best[better], best_k[better] = c, k

    heads = [frame_head(n, f) for n, f in zip(length.tolist(), number.tolist(), strict=True)]
    head_bytes = np.array([len(h) for h in heads], np.int64)
    frame_bytes = head_bytes + -(-best_bits // 8) + 2
    frame_at = np.cumsum(frame_bytes) - frame_bytes
    body = frame_at + head_bytes

    packed = np.zeros(0, np.uint8)
    if n_frames:
        # A sample's code is what follows the unary zeros: a one and k low bits, or the sample itself where it is stored plainly.
        u = zigzags[0]
        choice = np.repeat(best.astype(np.int8), room)
        for c in range(1, len(PREDICTORS)):
            np.copyto(u, zigzags[c], where=choice == c)
        k = np.repeat(best_k.astype(np.uint16), room)
        one = np.repeat((1 << best_k).astype(np.uint16), room)
        size = (u >> k) + k + np.uint16(1)
        code = (u & (one - np.uint16(1)) | one).astype(np.uint8)
        plain = choice < 0
        np.copyto(size, 8, where=plain)
        np.copyto(code, signed, where=plain)
        size[gaps], code[gaps] = 0, 0
        for c, coefficients in enumerate(PREDICTORS):
            order, frames = len(coefficients), np.flatnonzero(best == c)
            for j in range(order):
                size[bounds[frames] + j], code[bounds[frames] + j] = 8, signed[bounds[frames] + j]
            size[bounds[frames] + order] += (4 + 5 + 12 * order if order else 0) + 6 + 4
        end = np.cumsum(size, dtype=np.int64)
        end += np.repeat(8 * body + 8 - (end[bounds] - size[bounds]), room)
        packed = _packed(code, end, int(frame_bytes.sum()))
        packed[_spans(frame_at, head_bytes)] = np.frombuffer(b"".join(heads), np.uint8)
        packed[body[best < 0]] = 0b00000010
        for c, coefficients in enumerate(PREDICTORS):
            order, frames = len(coefficients), np.flatnonzero(best == c)
            packed[body[frames]] = 0b0010000 if not order else 0b1000000 | (order - 1) << 1
            fields = f"{11:04b}{SHIFT:05b}" + "".join(f"{w:012b}" for w in coefficients) if order else ""
            fields += f"{0:06b}"
            for k in PARAMETERS:
                own = body[frames[best_k[frames] == k]] + 1 + order
                bits = fields + f"{k:04b}"
                for j in range(0, len(bits), 8):
                    packed[own + j // 8] |= int(bits[j : j + 8].ljust(8, "0"), 2)
        sums = crc16s(packed, frame_at, frame_bytes - 2)
        packed[frame_at + frame_bytes - 2], packed[frame_at + frame_bytes - 1] = sums >> 8, sums & 255

    out = []
    first = np.cumsum(counts) - counts
    for p, payload in enumerate(payloads):
        a, n = int(first[p]), int(counts[p])
        own_sizes, own_at = frame_bytes[a : a + n], frame_at[a : a + n]
        signed = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
        most = min(BLOCK, max(16, len(payload)))
        info = (most.to_bytes(2, "big") * 2) + (int(own_sizes.min()) if n else 0).to_bytes(3, "big") + (int(own_sizes.max()) if n else 0).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["n"] = np.arange(n) * BLOCK, length[a : a + n]
        points["offset"] = own_at - (own_at[0] if n else 0)
        head = b"fLaC\x00" + (34).to_bytes(3, "big") + info + b"\x83" + (18 * n).to_bytes(3, "big") + points.tobytes()
        body_bytes = packed[int(own_at[0]) : int(own_at[-1] + own_sizes[-1])].tobytes() if n else b""
        out.append(head + body_bytes)
    return out


# --- decoding ---------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    stream: int
    at: int
    end: int
    body: int
    first: int
    size: int
    channels: int
    mode: int
    bits: int
    pcm: list[np.ndarray] = field(default_factory=list)


def read_info(data: bytes) -> tuple[int, int, int, int, bytes, int]:
    """Where frames start, channels, bits, samples (0: unknown), MD5 and the block size, of a stream's metadata."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info = 4, None
    while True:
        if at + 4 > len(data):
            raise ValueError("the stream ends within its metadata")
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 127 == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 128:
            break
    if info is None or len(info) != 34:
        raise ValueError("the stream has no STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    return at, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), info[18:34], int.from_bytes(info[:2], "big")


def read_frame_head(data: bytes, at: int, block: int, bits: int) -> tuple[int, int, int, int, int, int]:
    """Body, first sample, samples, channels, mode and bits of a frame's header; ValueError if there is none or its checksum is wrong."""
    if len(data) - at < 6:
        raise ValueError("the stream ends within a frame")
    size_code, rate_code, mode, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if not size_code or rate_code == 15 or mode > 10 or bits_code == 3 or data[at + 3] & 1:
        raise ValueError("bad frame header")
    number, p = read_coded(data, at + 4)
    if size_code in (6, 7):
        n = int.from_bytes(data[p : p + size_code - 5], "big") + 1
        p += size_code - 5
    else:
        n = BLOCK_SIZES[size_code]
    p += RATE_BYTES.get(rate_code, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        raise ValueError("a frame header's checksum is wrong")
    first = number if data[at + 1] & 1 else number * block
    return p + 1, first, n, mode + 1 if mode < 8 else 2, mode, SAMPLE_SIZES.get(bits_code, bits)


_MARK = re.compile(rb"\xff(?=[\xf8\xf9])")


def find_marks(streams: Sequence[bytes]) -> list[tuple[list[int], list[int]]]:
    """For each stream where frames may begin, and the checksums of what lies between such a place and the next or the end: 0 for a whole frame."""
    marks = [[m.start() for m in _MARK.finditer(data, read_info(data)[0])] for data in streams]
    counts = np.array([len(m) for m in marks], np.int64)
    lengths = np.array([len(s) for s in streams], np.int64)
    bases = np.cumsum(lengths) - lengths
    starts = np.array([m for own in marks for m in own], np.int64) + np.repeat(bases, counts)
    stops = np.append(starts[1:], 0)
    last = np.cumsum(counts)[counts > 0] - 1
    stops[last] = (bases + lengths)[counts > 0]
    sums = crc16s(np.frombuffer(b"".join(streams), np.uint8), starts, stops - starts).tolist()
    ends = np.cumsum(counts).tolist()
    return [(own, sums[end - len(own) : end]) for own, end in zip(marks, ends, strict=True)]


def find_frames(data: bytes, stream: int, marked: tuple[list[int], list[int]] | None = None) -> tuple[list[Frame], int, int, bytes]:
    """The frames of a stream, each ended where its own checksum is right and the next one's valid header begins or the data ends.

    The header that follows must have the next number; in a stream of unknown length that lacks frames, the next valid one will do.
    ``marked`` is what ``find_marks`` gives for the stream.
    """
    at, _, bits, samples, md5, block = read_info(data)
    raw = np.frombuffer(data, np.uint8)
    marks, sums = marked or find_marks([data])[0]
    frames, k, n_marks = [], 0, len(marks)
    head = None
    while at < len(data):
        if data[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
            raise ValueError("a frame is missing")
        head = head or read_frame_head(data, at, block, bits)
        following = head[1] + (head[2] if data[at + 1] & 1 else block)
        while k < n_marks and marks[k] <= at:
            k += 1
        end = None
        for j in range(k, n_marks + 1):
            stop = marks[j] if j < n_marks else len(data)
            if stop > head[0] + 2 and (sums[j - 1] if j == k else crc16(raw[at:stop])) == 0:
                after = None
                if stop < len(data):
                    try:
                        after = read_frame_head(data, stop, block, bits)
                    except ValueError:  # a mark within the frame
                        continue
                # A checksum that fits at a frame's end fits at the ends of all frames after it too, so the data's end proves little.
                expected = (end is None or samples > 0) if after is None else after[1] == following and data[stop + 1] == data[at + 1]
                if end is None or expected:
                    end, next_head = stop, after
                if expected:
                    break
        if end is None:
            raise ValueError("a frame's checksum is wrong")
        frames.append(Frame(stream, at, end, *head))
        at, head = end, next_head
    return frames, samples, bits, md5


#: Leading zeros of a 16-bit number.
_LEADING_ZEROS = 16 - np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.int64)


class Bits:
    """Reads bits at many places of one buffer at once. ``at`` holds bit positions and moves on."""

    def __init__(self, data: bytes) -> None:
        self.words = np.ndarray(len(data) + 9, ">u8", data + bytes(16), strides=(1,)).astype(np.uint64)  # a word from each byte on
        self.zeros = _LEADING_ZEROS
        self.most = 8 * len(data)

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] << (at & 7).view(np.uint64)

    def read(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of up to 56 bits."""
        size = np.asarray(size, np.int64)
        return np.where(size > 0, self.window(at) >> np.clip(64 - size, 0, 63).astype(np.uint64), 0).astype(np.int64)

    def signed(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        size = np.asarray(size, np.int64)
        return np.where(size > 0, self.window(at).view(np.int64) >> np.clip(64 - size, 0, 63), 0)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        out = self.zeros[(self.window(at) >> np.uint64(48)).astype(np.int64)]
        more = np.flatnonzero(out == 16)
        while len(more):
            if (at[more] + out[more] > self.most).any():
                raise ValueError("a residual runs past the end")
            step = self.zeros[(self.window(at[more] + out[more]) >> np.uint64(48)).astype(np.int64)]
            out[more] += step
            more = more[step == 16]
        return out


def decode_subframes(source: Bits, at: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (row: sample, column: frame) of one subframe of each frame, and where each ends."""
    n = len(at)
    if (source.read(at, 1) != 0).any():
        raise ValueError("bad subframe")
    kind = source.read(at + 1, 6)
    at = at + 8
    wasted = np.zeros(n, np.int64)
    has = np.flatnonzero(source.read(at - 1, 1))
    if len(has):
        zeros = source.unary(at[has])
        wasted[has] = zeros + 1
        at[has] += zeros + 1
    bits = bits - wasted
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise ValueError("reserved kind of subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    most = int(size.max())
    out = np.zeros((most, n), np.int64)

    own = np.flatnonzero(constant)
    if len(own):
        out[:, own] = source.signed(at[own], bits[own])
        at[own] += bits[own]
    own = np.flatnonzero(verbatim)
    if len(own):
        for b in np.unique(bits[own]).tolist():
            same = own[bits[own] == b]
            rows = np.arange(int(size[same].max()))[:, None]
            places = np.minimum(at[same] + rows * b, source.most)  # what lies behind a shorter frame isn't looked at
            out[: len(rows), same] = source.signed(places, b)
            at[same] += size[same] * b

    own = np.flatnonzero(fixed | linear)
    if not len(own):
        return out << wasted, at
    order, p, b, sz = order[own], at[own], bits[own], size[own]
    width = int(order.max())
    warm = np.zeros((width, len(own)), np.int64)
    for j in range(width):
        has = order > j
        warm[j] = np.where(has, source.signed(p, b), 0)
        p = p + np.where(has, b, 0)
    coefficients, down = np.zeros((width, len(own)), np.int64), np.zeros(len(own), np.int64)
    for k in range(1, min(4, width) + 1):
        coefficients[:k, fixed[own] & (order == k)] = np.array(FIXED_COEFFICIENTS[k])[:, None]
    lin = linear[own]
    if lin.any():
        precision = np.where(lin, source.read(p, 4) + 1, 0)
        down = np.where(lin, source.signed(p + 4, 5), 0)
        if (precision == 16).any() or (down < 0).any():
            raise ValueError("bad predictor")
        p = p + np.where(lin, 9, 0)
        for j in range(width):
            has = lin & (order > j)
            coefficients[j] = np.where(has, source.signed(p, precision), coefficients[j])
            p = p + np.where(has, precision, 0)
    method = source.read(p, 2)
    if (method > 1).any():
        raise ValueError("reserved coding of residuals")
    parameter_bits, partitions = 4 + method, np.int64(1) << source.read(p + 2, 4)
    if (sz % partitions).any():
        raise ValueError("uneven partitions of residuals")
    p = p + 6

    # Residuals: longest frames first, so that a step works on the frames that still have samples.
    turn = np.argsort(-sz, kind="stable")
    order, p, sz, partitions, parameter_bits = order[turn], p[turn], sz[turn], partitions[turn], parameter_bits[turn]
    rows = int(sz[0])
    k, raw, one = np.zeros(len(own), np.int64), np.full(len(own), -1), np.ones(len(own), np.int64)
    after, shift = k + 1, np.full(len(own), 63, np.uint64)
    residual = np.zeros((rows, len(own)), np.int64)
    active = np.searchsorted(-sz, -np.arange(1, rows + 1), "right").tolist()
    frame_of = np.repeat(np.arange(len(own)), partitions)
    start_of = (np.arange(len(frame_of)) - np.repeat(np.cumsum(partitions) - partitions, partitions)) * np.repeat(sz // partitions, partitions)
    by_step = np.argsort(start_of, kind="stable")
    frame_of, opened = frame_of[by_step], np.searchsorted(start_of[by_step], np.arange(rows + 1)).tolist()
    some_escape = False
    for i, a in enumerate(active):
        q = p[:a]
        if opened[i] < opened[i + 1]:
            starts = frame_of[opened[i] : opened[i + 1]]
            got = source.read(q[starts], parameter_bits[starts])
            q[starts] += parameter_bits[starts]
            escape = got == (1 << parameter_bits[starts]) - 1
            own_k = np.where(escape, 0, got)
            k[starts], raw[starts], after[starts], one[starts], shift[starts] = own_k, -1, own_k + 1, np.int64(1) << own_k, 63 - own_k
            if escape.any():
                some_escape, e = True, starts[escape]
                raw[e] = source.read(q[e], 5)
                q[e] += 5
        if i >= width and not some_escape:
            window = source.window(q)
            high = source.zeros[(window >> np.uint64(48)).view(np.int64)]
            window <<= high.view(np.uint64)
            if high.max() == 16:  # the one may be outside of the window
                more = np.flatnonzero(high == 16)
                high[more] = source.unary(q[more])
                window[more] = source.window(q[more] + high[more])
            q += high
            q += after[:a]
            high <<= k[:a]
            window >>= shift[:a]  # the one and the low bits
            high += window.view(np.int64)
            high -= one[:a]
            np.bitwise_xor(high >> 1, -(high & 1), out=residual[i, :a])
            continue
        go = np.flatnonzero((order[:a] <= i) & (raw[:a] < 0))
        if len(go):
            high = source.unary(q[go])
            q[go] += high + 1
            u = high << k[go] | source.read(q[go], k[go])
            q[go] += k[go]
            residual[i, go] = (u >> 1) ^ -(u & 1)
        if some_escape:
            e = np.flatnonzero((raw[:a] >= 0) & (order[:a] <= i))
            residual[i, e] = source.signed(q[e], raw[e])
            q[e] += raw[e]
    if (p > source.most).any():
        raise ValueError("a residual runs past the end")

    # Prediction, a sample of every frame at a time.
    warm, coefficients, down = warm[:, turn], coefficients[:, turn], down[turn]
    made = residual
    backwards = np.ascontiguousarray(coefficients[::-1])
    for i, a in enumerate(active if width else ()):
        if i:
            taps = min(width, i)
            made[i, :a] += np.add.reduce(backwards[width - taps :, :a] * made[i - taps : i, :a], axis=0) >> down[:a]
        if i < width:
            made[i, :a] = np.where(order[:a] > i, warm[i, :a], made[i, :a])
    out[:rows, own[turn]] = made
    at[own[turn]] = p
    return out << wasted, at


def decode(streams: Sequence[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream its blocks: (first sample, samples as an array of a row for each channel). Checksums are verified."""
    return [blocks for _, blocks in decode_sized(streams)]


def decode_sized(streams: Sequence[bytes]) -> list[tuple[int, list[tuple[int, np.ndarray]]]]:
    """As ``decode``, each stream's blocks after the bits of its samples, as the stream tells them."""
    data = b"".join(streams)
    frames, per_stream, base = [], [], 0
    for s, (stream, marked) in enumerate(zip(streams, find_marks(streams), strict=True)):
        own, samples, bits, md5 = find_frames(stream, s, marked)
        for f in own:
            f.body += base
            f.end += base
        frames += own
        per_stream.append((own, samples, bits, md5))
        base += len(stream)
    if frames:
        source = Bits(data)
        at = np.array([f.body * 8 for f in frames])
        size, bits = np.array([f.size for f in frames]), np.array([f.bits for f in frames])
        channels, mode = np.array([f.channels for f in frames]), np.array([f.mode for f in frames])
        for c in range(int(channels.max())):
            own = np.flatnonzero(channels > c)
            side = ((mode[own] == 8) | (mode[own] == 10)) & (c == 1) | (mode[own] == 9) & (c == 0)
            got, at[own] = decode_subframes(source, at[own], size[own], bits[own] + side)
            got = np.ascontiguousarray(got.T)
            for j, i in enumerate(own.tolist()):
                frames[i].pcm.append(got[j, : frames[i].size])
        if ((at + 7) // 8 + 2 != np.array([f.end for f in frames])).any():
            raise ValueError("a frame's length is wrong")
    out = []
    for own, samples, bits, md5 in per_stream:
        blocks = []
        for f in own:
            pcm = np.stack(f.pcm) if f.channels > 1 else f.pcm[0][None]
            if f.mode == 8:
                pcm[1] = pcm[0] - pcm[1]
            elif f.mode == 9:
                pcm[0] = pcm[0] + pcm[1]
            elif f.mode == 10:
                middle = pcm[0] << 1 | pcm[1] & 1
                pcm = np.stack([(middle + pcm[1]) >> 1, (middle - pcm[1]) >> 1])
            blocks.append((f.first, pcm))
        if samples and sum(b.shape[1] for _, b in blocks) != samples:
            raise ValueError("samples are missing")
        if any(md5):
            digest = hashlib.md5()
            for _, b in blocks:
                digest.update(signed_bytes(b, bits))
            if digest.digest() != md5:
                raise ValueError("the stream's MD5 is wrong")
        out.append((bits, blocks))
    return out


# --- on Spark ---------------------------------------------------------------------------------------------------


def chunked(items: Sequence[bytes]) -> Iterator[Sequence[bytes]]:
    start, size = 0, 0
    for k, x in enumerate(items):
        size += len(x)
        if size >= CHUNK_BYTES:
            yield items[start : k + 1]
            start, size = k + 1, 0
    if start < len(items):
        yield items[start:]


def padded(text: str | None) -> bytes:
    """UTF-8 bytes of a text (null: none), with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def signed_bytes(samples: np.ndarray, bits: int) -> bytes:
    """A block's samples interleaved, signed and little-endian, in as many bytes as the stream's bits take."""
    if bits <= 8:
        return samples.T.astype(np.int8).tobytes()
    return samples.T.ravel().astype("<i4").view(np.uint8).reshape(-1, 4)[:, : -(-bits // 8)].tobytes()


def pcm_of(samples: np.ndarray, bits: int) -> bytes:
    """A block's samples interleaved, in as many bytes as the stream's bits take: up to 8 unsigned, else signed and little-endian."""
    return (samples.T + 128).astype(np.uint8).tobytes() if bits <= 8 else signed_bytes(samples, bits)


def encode_column(df: DataFrame, payload_col: str, media_col: str = "media", drop: Sequence[str] = ()) -> DataFrame:
    """Every row of ``df`` with the stream of its payload: binary as it is, strings padded as ``padded`` says.

    A null binary payload is an empty one; a payload of any length is one stream. Repeated rows are each
    encoded, alike. A column named ``media_col`` is replaced, those in ``drop`` go; an empty table gives an empty table.
    """
    text = isinstance(df.schema[payload_col].dataType, StringType)

    def start():
        def make(held: pa.Array) -> list[pa.Array]:
            payloads = [padded(x) if text else x or b"" for x in held.to_pylist()]
            return [pa.array([m for part in chunked(payloads) for m in encode(part)], pa.binary())]

        return make

    return add_columns(df, [payload_col], [StructField(media_col, BinaryType())], start, drop, PIECE)


#: Columns that ``decode_column`` can add.
OUTPUTS = {
    "blocks": ArrayType(StructType([StructField("first_sample", LongType()), StructField("n_samples", LongType()), StructField("pcm", BinaryType())])),
    "error": StringType(),
    "samples": LongType(),
    "frames": LongType(),
    "payload_sha256": StringType(),
    "tail_crc32": LongType(),
    "mean_abs": DoubleType(),
    "crossings": LongType(),
}


def decode_column(df: DataFrame, media_col: str = "media", outputs: Iterable[str] = ("blocks",), tail: int = 64, drop: Sequence[str] = ()) -> DataFrame:
    """Every row of ``df`` with the wanted ``OUTPUTS``, from the decoded samples of its stream.

    ``blocks`` are PCM blocks in order, each with its first sample, so that a reader can seek; samples
    are interleaved, in as many bytes as the stream's bits take: up to 8 bits unsigned, others signed and little-endian. The digests are of all blocks' bytes, the
    checksum of the last ``tail``; ``mean_abs`` and ``crossings`` (changes of sign) are of the first channel.
    A null, damaged or foreign stream has nulls and its fault in ``error``. Streams of any length are decoded
    whole, repeated rows each. Columns named as an output, or in ``drop``, go; an empty table gives an empty table.
    """
    wanted = list(outputs)
    if unknown := set(wanted) - set(OUTPUTS):
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    block_kind = pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())]))
    kinds = {"blocks": block_kind, "error": pa.string(), "payload_sha256": pa.string(), "mean_abs": pa.float64()}

    def features(bits: int, blocks: list[tuple[int, np.ndarray]]) -> dict:
        row: dict = {"error": None, "samples": sum(b.shape[1] for _, b in blocks), "frames": len(blocks)}
        raws = [pcm_of(b, bits) for _, b in blocks]
        if "payload_sha256" in wanted or "tail_crc32" in wanted:
            whole = b"".join(raws)
            row["payload_sha256"], row["tail_crc32"] = hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-tail:])
        if "mean_abs" in wanted or "crossings" in wanted:
            first = np.concatenate([b[0] for _, b in blocks]) if blocks else np.zeros(0, np.int64)
            row["mean_abs"] = float(np.abs(first).sum() / max(1, len(first)))
            row["crossings"] = int(np.count_nonzero(np.diff(first < 0)))
        if "blocks" in wanted:
            row["blocks"] = [{"first_sample": f, "n_samples": b.shape[1], "pcm": r} for (f, b), r in zip(blocks, raws, strict=True)]
        return row

    def all_decoded(media: Sequence[bytes | None]) -> Iterator[dict]:
        for part in chunked([m or b"" for m in media]):
            try:
                decoded = decode_sized(part)
            except (ValueError, IndexError):  # then one by one, to tell the damaged ones
                decoded = []
                for m in part:
                    try:
                        decoded += decode_sized([m])
                    except (ValueError, IndexError) as e:
                        decoded.append(str(e))
            for d in decoded:
                yield {"error": d} if isinstance(d, str) else features(*d)

    def start():
        def make(media: pa.Array) -> list[pa.Array]:
            rows = list(all_decoded(media.to_pylist()))
            return [pa.array([r.get(n) for r in rows], kinds.get(n, pa.int64())) for n in wanted]

        return make

    return add_columns(df, [media_col], [StructField(n, OUTPUTS[n]) for n in wanted], start, drop, PIECE)


def pcm_bytes(blocks: Column) -> Column:
    """The bytes of all blocks, one after the other; null for null."""
    return F.unhex(F.array_join(F.transform(blocks, lambda b: F.hex(b["pcm"])), ""))


def pcm_range(blocks: Column, first: Column, n: Column) -> Column:
    """The bytes of the ``n`` samples from ``first`` on, of all channels, read from the blocks that hold any of them and no others."""
    held = F.filter(blocks, lambda b: (b["first_sample"] < first + n) & (b["first_sample"] + b["n_samples"] > first))
    head = F.get(held, F.lit(0))
    wide = F.length(head["pcm"]) / head["n_samples"]
    return F.substring(pcm_bytes(held), ((first - head["first_sample"]) * wide + 1).cast("int"), (n * wide).cast("int"))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's payload as a FLAC stream, decoded to PCM blocks that are written as a table and read back, whole and by sample offset."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.encode("text", "UTF-8")), F.lit(0)).cast("long"))
    media = encode_column(docs, "text", drop=["text"])
    media = media.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    pcm = stored(decode_column(media, "media", ("blocks", "samples", "frames", "mean_abs", "crossings", "error"), drop=["media"]))
    feature = F.format_string("frames=%d;mean_abs=%.6f;crossings=%d", "frames", "mean_abs", "crossings")
    tail = pcm_range(F.col("blocks"), F.col("samples") - 64, F.lit(64))
    return pcm.select(
        "doc_id", "n_bytes", F.col("samples").alias("payload_bytes"), F.sha2(pcm_bytes(F.col("blocks")), 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        "media_bytes", "media_sha256", feature.alias("feature"), "error",
    )
