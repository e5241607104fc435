"""Media columns: a FLAC writer for 8-bit mono samples and a reader for any FLAC stream of up to 24 bits.

The reader finds frames by their sync code and the CRC-8 of their headers, in numbered order, and
checks each frame's CRC-16 and the stream's MD5.  It takes constant, verbatim, fixed and
linear-prediction subframes, wasted bits, both Rice methods with all partition orders and raw
partitions, up to eight channels and the three stereo modes, fixed and variable block sizes.  Frames
of one shape are decoded in step, whatever streams they belong to.  A range of samples is read by the
seek table: only the frames that hold it are looked at (without a table, only their headers are).
The writer picks fixed predictors of order 0 to 2 or a linear predictor of order 2, whichever leaves
the least, for each frame.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.textkit import WIDE_SLICE, batch_of, map_batches, slices, texts_of

UNIT = 192
#: Samples of a frame; streams of over LONG_STREAM samples have the larger frames, so that the seek table fits its block.
BLOCK, LONG_BLOCK, LONG_STREAM = 576, 4608, 1 << 28
RATE = 8000
#: Samples of a PCM block.
PCM_BLOCK = 4096
#: Fixed values of the format: codes of block sizes, and the polynomials of its checksums.
_SIZE_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5}
_CRC8_POLYNOMIAL, _CRC16_POLYNOMIAL = 0x07, 0x8005
_PRECISION, _SHIFT = 10, 8


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    table, top, mask = np.zeros(256, np.uint32), 1 << (bits - 1), (1 << bits) - 1
    for i in range(256):
        value = i << (bits - 8)
        for _ in range(8):
            value = ((value << 1) ^ polynomial if value & top else value << 1) & mask
        table[i] = value
    return table


_CRC8 = _crc_table(_CRC8_POLYNOMIAL, 8).tolist()
_CRC16 = _crc_table(_CRC16_POLYNOMIAL, 16)


def _crc8(data: bytes) -> int:
    value = 0
    for b in data:
        value = _CRC8[value ^ b]
    return value


def _crc16(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """CRC-16 of each range, all ranges in step; ranges end together, since leading zeros don't count."""
    value, size = np.zeros(len(start), np.uint32), stop - start
    order = np.argsort(-size, kind="stable")
    sorted_size = size[order]
    for left in range(int(size.max(initial=0)), 0, -1):
        n = int(np.searchsorted(-sorted_size, -left, side="right"))
        at = order[:n]
        old = value[at]
        value[at] = ((old << 8) & 0xFFFF) ^ _CRC16[(old >> 8) ^ data[stop[at] - left]]
    return value


def _frame_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    out = []
    for more in range(1, 7):
        out.insert(0, 0x80 | n & 0x3F)
        n >>= 6
        if n < 1 << (6 - more):
            return bytes([(0xFF << (7 - more)) & 0xFF | n, *out])
    raise ValueError("the frame number is too large")


_headers: dict[tuple[int, int], bytes] = {}


def _header(number: int, size: int) -> bytes:
    if (found := _headers.get((number, size))) is None:
        if len(_headers) > 100_000:
            _headers.clear()
        code = _SIZE_CODES.get(size, 7)
        head = bytes([0xFF, 0xF8, code << 4 | 4, 1 << 1]) + _frame_number(number) + ((size - 1).to_bytes(2, "big") if code == 7 else b"")
        found = _headers[number, size] = head + bytes([_crc8(head)])
    return found


def _put(fields_end: np.ndarray, value: np.ndarray, total_bits: int) -> np.ndarray:
    """Bytes in which each value, of 17 bits at most, ends at its bit; values don't overlap."""
    shift = -fields_end & 7
    wide = value.astype(np.int64) << shift
    last = (fields_end + shift) // 8 - 1
    size = (total_bits + 7) // 8 + 1
    out = np.bincount(last, (wide & 0xFF).astype(np.float64), size)
    for k in (1, 2):
        part = (wide >> (8 * k)) & 0xFF
        has = part > 0
        out[: size] += np.bincount(last[has] - k, part[has].astype(np.float64), size)[:size]
    return out.astype(np.uint8)[: (total_bits + 7) // 8]


def _subframes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subframes of equally long frames, byte-aligned: (bytes, offsets)."""
    frames, size = x.shape
    x = x.astype(np.int32)
    r0 = (x * x).sum(1).astype(np.float64) + 1
    r1 = (x[:, 1:] * x[:, :-1]).sum(1).astype(np.float64)
    r2 = (x[:, 2:] * x[:, :-2]).sum(1).astype(np.float64)
    det = r0 * r0 - r1 * r1 + 1e-9
    limit = (1 << (_PRECISION - 1)) - 1
    c1 = np.clip(np.rint((r1 * r0 - r1 * r2) / det * (1 << _SHIFT)), -limit, limit).astype(np.int32)
    c2 = np.clip(np.rint((r0 * r2 - r1 * r1) / det * (1 << _SHIFT)), -limit, limit).astype(np.int32)
    lpc = x[:, 2:] - ((c1[:, None] * x[:, 1:-1] + c2[:, None] * x[:, :-2]) >> _SHIFT)
    d1 = np.diff(x, axis=1)
    d2 = np.diff(d1, axis=1)
    costs = np.stack([np.abs(x[:, 2:]).sum(1), np.abs(d1[:, 1:]).sum(1), np.abs(d2).sum(1), np.abs(lpc).sum(1) + 24], 1)
    kind = costs.argmin(1)
    order = np.array([0, 1, 2, 2])[kind]
    kind[constant := (x == x[:, :1]).all(1)] = 4
    e = np.zeros((frames, size), np.int32)
    e[kind == 0] = x[kind == 0]
    for k, residual, skip in ((1, d1, 1), (2, d2, 2), (3, lpc, 2)):
        e[kind == k, skip:] = residual[kind == k]
    u = (e << 1) ^ (e >> 31)
    coded = (np.arange(size) >= order[:, None]) & ~constant[:, None]
    n = np.maximum(coded.sum(1), 1)
    mean = (u * coded).sum(1) / n
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int32)
    length = np.where(coded, (u >> k[:, None]) + 1 + k[:, None], 0)
    head = np.select([constant, kind == 3], [16, 8 + 16 + 9 + 2 * _PRECISION + 10], 8 + 8 * order + 10)
    bits = head + length.sum(1)
    verbatim = ~constant & (bits >= 8 + 8 * size)
    bits = np.where(verbatim, 8 + 8 * size, bits)
    coded &= ~verbatim[:, None]
    length *= ~verbatim[:, None]
    offsets = np.concatenate(([0], np.cumsum((bits + 7) // 8)))
    base = offsets[:-1] * 8
    ends, values = [], []

    def field(which: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        ends.append((base + at)[which])
        values.append(np.broadcast_to(value, (frames,))[which])

    every = np.ones(frames, bool)
    lead = np.select([constant, verbatim, kind == 3], [0, 2, (32 + 1) << 1], (8 + order) << 1)
    field(every, np.full(frames, 8), lead)
    rice = ~constant & ~verbatim
    warm = np.where(constant, 1, np.where(verbatim, 0, order))
    for i in range(2):
        field(warm > i, np.full(frames, 16 + 8 * i), x[:, i] & 0xFF)
    by_lpc = rice & (kind == 3)
    at = np.full(frames, 24)
    for value, width in ((_PRECISION - 1, 4), (_SHIFT, 5), (c1 & ((1 << _PRECISION) - 1), _PRECISION), (c2 & ((1 << _PRECISION) - 1), _PRECISION)):
        at = at + width
        field(by_lpc, at, value)
    field(rice, head, k)
    code_end = (base + head)[:, None] + np.cumsum(length, 1)
    ends.append(code_end[coded])
    values.append(((1 << k[:, None]) | (u & ((1 << k[:, None]) - 1)))[coded])
    if verbatim.any():
        ends.append((base[verbatim, None] + 16 + 8 * np.arange(size)).ravel())
        values.append((x[verbatim] & 0xFF).ravel())
    return _put(np.concatenate(ends), np.concatenate(values), int(offsets[-1]) * 8), offsets


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload: bytes b as samples b - 128, a positive multiple of UNIT of them."""
    lengths = [len(p) for p in payloads]
    if any(n <= 0 or n % UNIT for n in lengths):
        raise ValueError(f"a payload must be a positive multiple of {UNIT} bytes")
    data = np.frombuffer(b"".join(payloads), np.uint8)
    signed = data ^ 0x80
    where: dict[int, list[tuple[int, int]]] = {}  # by size: (stream, start)
    plan: list[list[tuple[int, int]]] = []  # of each stream: (size, number among those of its size)
    start = 0
    for s, n in enumerate(lengths):
        block = LONG_BLOCK if n > LONG_STREAM else BLOCK
        mine = []
        for at in range(0, n, block):
            size = min(block, n - at)
            mine.append((size, len(where.setdefault(size, []))))
            where[size].append((s, start + at))
        plan.append(mine)
        start += n
    bodies = {}
    for size, frames in where.items():
        begin = np.array([a for _, a in frames])
        parts, offsets = [], [np.zeros(1, np.int64)]
        for some in np.array_split(begin, len(begin) * size // (1 << 21) + 1):
            raw, at = _subframes(signed.view(np.int8)[some[:, None] + np.arange(size)])
            parts.append(raw)
            offsets.append(at[1:] + offsets[-1][-1])
        bodies[size] = (b"".join(x.tobytes() for x in parts), np.concatenate(offsets).tolist())
    joined = bytearray()
    edges: list[int] = [0]
    for mine in plan:
        for number, (size, i) in enumerate(mine):
            raw, at = bodies[size]
            joined += _header(number, size)
            joined += raw[at[i] : at[i + 1]]
            edges.append(len(joined))
    at = np.array(edges)
    checks = _crc16(np.frombuffer(bytes(joined), np.uint8), at[:-1], at[1:]).tolist()
    out, f, start = [], 0, 0
    raw = bytes(joined)
    for s, mine in enumerate(plan):
        frames, points, offset, first = [], [], 0, 0
        for size, _ in mine:
            frame = raw[edges[f] : edges[f + 1]] + checks[f].to_bytes(2, "big")
            points.append(first.to_bytes(8, "big") + offset.to_bytes(8, "big") + size.to_bytes(2, "big"))
            frames.append(frame)
            offset, first, f = offset + len(frame), first + size, f + 1
        sizes = [len(x) for x in frames]
        block = mine[0][0]
        packed = RATE << 44 | 0 << 41 | 7 << 36 | lengths[s]
        info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed[start : start + lengths[s]].tobytes()).digest()
        table = b"".join(points)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames))
        start += lengths[s]
    return out


class _Bits:
    """Reads bits at many places in step."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate((data, np.zeros(16, np.uint8)))
        self.end = len(data) * 8

    def word(self, at: np.ndarray) -> np.ndarray:
        """The 32 bits from each place on."""
        d, b = self.data, np.minimum(at, self.end) >> 3
        wide = d[b].astype(np.uint64) << np.uint64(32) | d[b + 1].astype(np.uint64) << np.uint64(24) | d[b + 2].astype(np.uint64) << np.uint64(16) | d[b + 3].astype(np.uint64) << np.uint64(8) | d[b + 4].astype(np.uint64)
        return (wide >> (np.uint64(8) - (at & 7).astype(np.uint64))) & np.uint64(0xFFFFFFFF)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """As many bits as ``width`` says, 32 at most."""
        return (self.word(at) >> (np.uint64(32) - np.asarray(width, np.uint64))).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        value = self.take(at, width)
        return np.where(value >> (np.maximum(width, 1) - 1) & 1, value - (1 << np.asarray(width, np.int64)), value)

    def zeros(self, at: int) -> int:
        """Zeros before the next one."""
        start = at
        while at < self.end and not int(self.data[at >> 3]) >> (7 - (at & 7)) & 1:
            at += 8 if not at & 7 and not self.data[at >> 3] else 1
        if at >= self.end:
            raise ValueError("a code has no end")
        return at - start


def _residuals(bits: _Bits, at: np.ndarray, order: int, size: int, wide: bool, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, where they end) of subframes with one coding: each partition has a parameter of its own, the last one means raw bits."""
    out = np.zeros((len(at), size - order), np.int64)
    width, done = 5 if wide else 4, 0
    if (size // partitions) * partitions != size or size // partitions < order:
        raise ValueError("the partitions don't fit the block")
    for part in range(partitions):
        k = bits.take(at, width)
        at = at + width
        raw = k == (1 << width) - 1
        raw_bits = np.zeros(len(at), np.int64)
        if raw.any():
            raw_bits[raw] = bits.take(at[raw], 5)
            at[raw] += 5
        coded, k = ~raw, np.where(raw, 0, k)
        low = (np.uint64(1) << k.astype(np.uint64)) - np.uint64(1)
        for i in range(done, done + size // partitions - (order if part == 0 else 0)):
            word = bits.word(at)
            zeros = 32 - np.frexp(word.astype(np.float64))[1]
            rest = (word >> np.maximum(31 - zeros - k, 0).astype(np.uint64)) & low
            for j in np.flatnonzero(coded & (zeros + k + 1 > 32)).tolist():  # a code of over 32 bits
                zeros[j] = bits.zeros(int(at[j]))
                rest[j] = np.uint64(bits.take(at[j : j + 1] + zeros[j] + 1, int(k[j]))[0]) if k[j] else np.uint64(0)
            u = (zeros.astype(np.int64) << k) | rest.astype(np.int64)
            value, used = (u >> 1) ^ -(u & 1), zeros + 1 + k
            if raw.any():
                value[raw], used[raw] = np.where(raw_bits[raw] > 0, bits.signed(at[raw], raw_bits[raw]), 0), raw_bits[raw]
            out[:, i] = value
            at = at + used
        done += size // partitions - (order if part == 0 else 0)
    return out, at


def _subframes_read(bits: _Bits, at: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples, where they end) of one channel of equally long frames."""
    lead = bits.take(at, 8)
    if (lead & 0x80).any():
        raise ValueError("a subframe has a bad start")
    kinds, at = lead >> 1, at + 8
    wasted = np.zeros(len(at), np.int64)
    for j in np.flatnonzero(lead & 1).tolist():
        wasted[j] = bits.zeros(int(at[j])) + 1
        at[j] += wasted[j]
    if (wasted >= width).any():
        raise ValueError("a subframe has no bits left")
    out, end = np.zeros((len(at), size), np.int64), at.copy()
    for kind, lost in np.unique(np.stack([kinds, wasted]), axis=1).T.tolist():
        me = np.flatnonzero((kinds == kind) & (wasted == lost))
        p, w = at[me], width - lost
        if kind == 0:
            out[me] = bits.signed(p, w)[:, None]
            end[me] = p + w
        elif kind == 1:
            out[me] = bits.signed((p[:, None] + w * np.arange(size)).ravel(), w).reshape(len(me), size)
            end[me] = p + w * size
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            x = np.zeros((len(me), size), np.int64)
            if order > size:
                raise ValueError("a predictor is longer than its block")
            for i in range(order):
                x[:, i] = bits.signed(p, w)
                p = p + w
            if kind >= 32:
                precision, p = bits.take(p, 4) + 1, p + 4
                shift, p = bits.signed(p, 5), p + 5
                if (precision > 15).any() or (shift < 0).any():
                    raise ValueError("a predictor has a bad precision or shift")
                weights = np.zeros((len(me), order), np.int64)
                for i in range(order):
                    weights[:, i] = bits.signed(p, precision)
                    p = p + precision
            coding = bits.take(p, 6)
            e = np.zeros((len(me), size - order), np.int64)
            for code in np.unique(coding).tolist():
                if code >> 5:
                    raise ValueError("a coding of residuals isn't known")
                some = np.flatnonzero(coding == code)
                e[some], end[me[some]] = _residuals(bits, p[some] + 6, order, size, bool(code >> 4), 1 << (code & 15))
            if kind >= 32:
                for i in range(order, size):
                    guess = (weights * x[:, i - order : i][:, ::-1]).sum(1) >> shift
                    x[:, i] = e[:, i - order] + guess
            else:
                # each order is one more running sum; its first value comes from the warm-up samples
                for level in range(order, 0, -1):
                    seed = np.diff(x[:, :order], level - 1, axis=1)[:, -1]
                    e = seed[:, None] + np.cumsum(e, 1)
                x[:, order:] = e
            out[me] = x << lost
        else:
            raise ValueError(f"a subframe of kind {kind} isn't known")
        if kind <= 1:
            out[me] <<= lost
    return out, end


class Frames(NamedTuple):
    """Frames by column: their stream, bytes, where the header ends, block size, channel code, bits a sample, and first sample."""

    stream: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    body: np.ndarray
    size: np.ndarray
    channels: np.ndarray
    bits: np.ndarray
    first: np.ndarray

    def some(self, which: np.ndarray) -> Frames:
        return Frames(*(x[which] for x in self))


class Info(NamedTuple):
    """What a stream says of itself: where its frames start, and its seek points as (first sample, offset from there)."""

    audio: int
    block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    points: list[tuple[int, int]]


def info_of(stream: bytes) -> Info:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, points, head, last = 4, b"", b"", False
    while not last:
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + n]
        head, points = (block if kind == 0 else head), (block if kind == 3 else points)
        at += 4 + n
    packed = int.from_bytes(head[10:18], "big")
    if len(head) < 34 or (packed >> 36 & 31) + 1 > 24:
        raise ValueError("the stream has no whole description, or over 24 bits a sample")
    seek = [(int.from_bytes(points[i : i + 8], "big"), int.from_bytes(points[i + 8 : i + 16], "big")) for i in range(0, len(points), 18)]
    return Info(at, int.from_bytes(head[:2], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, head[18:34], [x for x in seek if x[0] != (1 << 64) - 1])


#: Fixed values of the format: block sizes and bits a sample by code, 0 where it stands elsewhere, -1 where there is none.
_SIZES = np.array([-1, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768])
_BITS = np.array([0, 8, 12, -1, 16, 20, 24, -1])
_RATE_BYTES = np.array([0] * 12 + [1, 2, 2, -1])
_CRC8_TABLE = np.array(_CRC8, np.uint8)
_MORE = np.array([0] * 128 + [-1] * 64 + [1] * 32 + [2] * 16 + [3] * 8 + [4] * 4 + [5] * 2 + [6, -1])


def _headers_in(data: np.ndarray, low: np.ndarray, high: np.ndarray, infos: list[Info]) -> tuple[Frames, np.ndarray, np.ndarray]:
    """(frames, number, whether numbers count samples) of all true headers in byte ranges; frames have no end yet."""
    d = np.concatenate((data, np.zeros(32, np.uint8)))
    at = np.flatnonzero((data[:-1] == 0xFF) & ((data[1:] & 0xFE) == 0xF8)) if len(data) > 1 else np.zeros(0, np.int64)
    stream = np.searchsorted(low, at, side="right") - 1
    at = at[(stream >= 0) & (at < high[np.maximum(stream, 0)])]
    stream = np.searchsorted(low, at, side="right") - 1
    by_sample = (d[at + 1] & 1) > 0
    size_code, rate_code, channels, bits_code = d[at + 2] >> 4, d[at + 2] & 15, (d[at + 3] >> 4).astype(np.int64), d[at + 3] >> 1 & 7
    more = _MORE[d[at + 4]]
    number = np.where(more > 0, d[at + 4] & (0x3F >> np.maximum(more, 0)), d[at + 4]).astype(np.int64)
    for i in range(1, 7):
        number = np.where(more >= i, number << 6 | (d[at + 4 + i] & 0x3F), number)
    p = at + 5 + np.maximum(more, 0)
    size = _SIZES[size_code].astype(np.int64)
    size = np.where(size_code == 6, d[p].astype(np.int64) + 1, np.where(size_code == 7, (d[p].astype(np.int64) << 8 | d[p + 1]) + 1, size))
    p = p + np.where(size_code == 6, 1, np.where(size_code == 7, 2, 0)) + np.maximum(_RATE_BYTES[rate_code], 0)
    check = np.zeros(len(at), np.uint8)
    for i in range(int((p - at).max(initial=0))):
        check = np.where(at + i < p, _CRC8_TABLE[check ^ d[at + i]], check)
    bits = _BITS[bits_code]
    bits = np.where(bits == 0, np.array([x.bits for x in infos])[stream] if len(at) else bits, bits)
    true = (check == d[p]) & (d[at + 3] & 1 == 0) & (more >= 0) & (size > 0) & (bits > 0) & (channels <= 10) & (_RATE_BYTES[rate_code] >= 0) & (p < high[stream])
    at, p, stream = at[true], p[true], stream[true]
    frames = Frames(stream, at, at, p + 1, size[true], channels[true], bits[true], number[true])
    return frames, number[true], by_sample[true]


def _chained(data: np.ndarray, low: np.ndarray, high: np.ndarray, infos: list[Info], first_sample: list[int]) -> Frames:
    """The frames of byte ranges that start with one: what looks like a header inside a frame is told by number and CRC-16."""
    found, number, by_sample = _headers_in(data, low, high, infos)
    edges = np.searchsorted(found.stream, np.arange(len(low) + 1))
    kept, first, stop = [], [], []
    blocks = np.array([x.block for x in infos])
    sample = np.where(by_sample, number, number * blocks[found.stream] if len(number) else number)
    for s, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)):
        begin, end = int(low[s]), int(high[s])
        if begin == end:
            continue
        if a == b or found.start[a] != begin or sample[a] != first_sample[s]:
            raise ValueError("a frame has a bad header or checksum")
        if (sample[a + 1 : b] == sample[a : b - 1] + found.size[a : b - 1]).all():
            kept.append(np.arange(a, b))
            first.append(sample[a:b])
            stop.append(np.append(found.start[a + 1 : b], end))
            continue
        i = a
        while i is not None:  # the next header of the right number behind which this frame's checksum holds
            due = sample[i] + found.size[i]
            ends = [(int(found.start[j]), j) for j in range(i + 1, b) if sample[j] == due] + [(end, None)]
            for at, j in ends:
                if _crc16(data, found.start[i : i + 1], np.array([at]))[0] == 0:
                    break
            else:
                raise ValueError("a frame fails its checksum")
            kept.append(np.array([i]))
            first.append(sample[i : i + 1])
            stop.append(np.array([at]))
            i = j
    none = np.zeros(0, np.int64)
    which = np.concatenate(kept) if kept else none
    return found.some(which)._replace(stop=np.concatenate(stop) if stop else none, first=np.concatenate(first) if first else none)


def _decoded(data: np.ndarray, frames: Frames) -> list[np.ndarray]:
    """Samples of each frame, one row a channel; ValueError where a checksum fails."""
    wrong = _crc16(data, frames.start, frames.stop) != 0
    if wrong.any():
        raise ValueError(f"{int(wrong.sum())} frames fail their checksum")
    bits = _Bits(data)
    out: list = [None] * len(frames.start)
    for size, code, width in np.unique(np.stack([frames.size, frames.channels, frames.bits]), axis=1).T.tolist():
        me = np.flatnonzero((frames.size == size) & (frames.channels == code) & (frames.bits == width))
        n = code + 1 if code < 8 else 2
        side = {8: 1, 9: 0, 10: 1}.get(code)
        for some in np.array_split(me, len(me) * size * n // (1 << 22) + 1):
            at, channels = frames.body[some] * 8, []
            for c in range(n):
                x, at = _subframes_read(bits, at, size, width + (c == side))
                channels.append(x)
            if (((at + 7) >> 3) + 2 != frames.stop[some]).any():
                raise ValueError("a frame doesn't end where its samples do")
            if code == 8:
                channels[1] = channels[0] - channels[1]
            elif code == 9:
                channels[0] = channels[0] + channels[1]
            elif code == 10:
                mid = channels[0] << 1 | channels[1] & 1
                channels = [(mid + channels[1]) >> 1, (mid - channels[1]) >> 1]
            whole = np.stack(channels, 1)
            for k, i in enumerate(some.tolist()):
                out[i] = whole[k]
    return out


def _pcm(samples: np.ndarray, bits: int) -> bytes:
    """Samples as a WAV file has them: up to 8 bits unsigned, else signed in whole bytes, the lowest first; channels in turn."""
    flat = samples.T.ravel()
    if bits <= 8:
        return (flat + 128).astype(np.uint8).tobytes()
    return np.ascontiguousarray(flat.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, : (bits + 7) // 8].tobytes()


def decode(streams: list[bytes]) -> list[bytes]:
    """The PCM of whole streams, of 8-bit mono ones their payloads; ValueError where a checksum fails."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    infos = [info_of(x) for x in streams]
    base = np.concatenate(([0], np.cumsum([len(x) for x in streams]))).astype(np.int64)
    low = base[:-1] + np.array([x.audio for x in infos], np.int64)
    frames = _chained(data, low, base[1:], infos, [0] * len(streams))
    parts, edges = _decoded(data, frames), np.searchsorted(frames.stream, np.arange(len(streams) + 1)).tolist()
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        samples = np.concatenate(parts[a:b], 1) if a < b else np.zeros((infos[i].channels, 0), np.int64)
        pcm = _pcm(samples, infos[i].bits)
        signed = (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes() if infos[i].bits <= 8 else pcm
        if any(infos[i].md5) and hashlib.md5(signed).digest() != infos[i].md5:
            raise ValueError("the samples don't have the stream's MD5")
        if infos[i].samples not in (0, samples.shape[1]):
            raise ValueError("the stream isn't whole")
        if infos[i].points and not set(infos[i].points) <= set(zip(frames.first[a:b].tolist(), (frames.start[a:b] - low[i]).tolist(), strict=True)):
            raise ValueError("the seek table points beside the frames")
        out.append(pcm)
    return out


def blocks(stream: bytes, block: int = PCM_BLOCK, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(first sample, PCM) of the blocks of samples [start, stop), of which only the frames that hold them are decoded."""
    info = info_of(stream)
    points = sorted({(0, 0), *info.points})
    before = [p for p in points if p[0] <= start][-1]
    behind = next((p for p in points if stop is not None and p[0] >= stop), None)
    low, high = info.audio + before[1], info.audio + behind[1] if behind else len(stream)
    data = np.frombuffer(stream, np.uint8)
    frames = _chained(data, np.array([low]), np.array([high]), [info], [before[0]])
    last = int((frames.first + frames.size).max(initial=0))
    stop = last if stop is None else min(stop, last)
    needed = np.flatnonzero((frames.first < stop) & (frames.first + frames.size > start))
    held, at = np.zeros((info.channels, 0), np.int64), int(frames.first[needed[0]]) if len(needed) else 0
    # frames are decoded as their blocks are asked for, many in step
    for some in np.array_split(needed, len(needed) // 256 + 1):
        held = np.concatenate([held, *_decoded(data, frames.some(some))], 1)
        if at < start:
            held, at = held[:, start - at :], start
        end = min(at + held.shape[1], stop)
        while at < end and (at + block <= end or end == stop):
            size = min(block, end - at)
            yield at, _pcm(held[:, :size], info.bits)
            held, at = held[:, size:], at + size


def feature(payload: bytes) -> str:
    """Level, sign changes and peak of the samples, as whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    return f"rms2={int((x.astype(np.int64) ** 2).sum()) // len(x)},crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())},peak={int(np.abs(x).max())}"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def media_columns(docs: DataFrame, id_column: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """One row per document row: its text as a FLAC stream, read back, with digests, a feature and the number of its PCM blocks.

    Null and empty texts are one unit of blanks.  Equal texts give equal values, so repeated rows do.
    ``media`` holds the stream itself if asked, for ``pcm_blocks`` to cut.  An empty table gives an
    empty result; other columns aren't read.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_blocks", pa.int64())]
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"
    if with_media:
        fields, ddl = [*fields, ("media", pa.binary())], ddl + ", media binary"
    schema = pa.schema(fields)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, _ = texts_of(batch)
            for a, b in slices(offsets, WIDE_SLICE):
                part = batch.slice(a, b - a)
                media = encode([payload_of(x) for x in part.column(1).to_pylist()])
                read = decode(media)
                more = {"media": media} if with_media else {}
                yield batch_of(schema, doc_id=part.column(0), n_bytes=np.diff(offsets[a : b + 1]), payload_bytes=[len(x) for x in read], payload_sha256=[hashlib.sha256(x).hexdigest() for x in read], tail_crc32=[binascii.crc32(x[-16:]) for x in read], media_bytes=[len(x) for x in media], media_sha256=[hashlib.sha256(x).hexdigest() for x in media], feature=[feature(x) for x in read], n_blocks=[-(-len(x) // PCM_BLOCK) for x in read], **more)

    return map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), store, ddl)


def pcm_blocks(media: DataFrame, column: str = "media", id_column: str = "doc_id", block: int = PCM_BLOCK, start: int = 0, stop: int | None = None) -> DataFrame:
    """(doc_id, first_sample, pcm): the PCM blocks of samples [start, stop) of stored streams; null streams have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("first_sample", pa.int64()), ("pcm", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stream is not None:
                    rows = list(blocks(stream, block, start, stop))
                    yield batch_of(schema, doc_id=[i] * len(rows), first_sample=[x for x, _ in rows], pcm=[x for _, x in rows])

    return map_batches(media.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).alias("media")), cut, "doc_id long, first_sample long, pcm binary")
