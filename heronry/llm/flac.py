"""FLAC as a media column: an encoder and a decoder for mono streams of 8-bit samples, many streams at once.

Both work on arrays of frames. Frames of a batch of streams are lanes that step together, sample by sample, so no Python
runs for a sample. A stream's seek table names the start of each of its frames; a stream without a full one is read frame
after frame, in step with the other streams. Memory follows ``LANES`` frames, not the length of a stream.

Samples are bytes less 128. A frame is CONSTANT, VERBATIM, FIXED (orders 0 to 4) or LPC (order 1 to 32), whichever is
smallest; the encoder writes one Rice partition, the decoder reads any number, parameters of 4 or 5 bits, and escapes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.store import small_batches

#: Samples of a frame; the last frame of a stream may be shorter.
BLOCK = 576
#: Frames that one array step handles.
LANES = 2048
#: Bytes of payload that go into one step, unless a single text is longer.
STEP = 4_000_000
#: Payloads are filled up to a multiple of this.
UNIT = 192
RATE = 8000
PRECISION = 10

KINDS = ("constant", "verbatim", "fixed", "lpc")
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_SIZES = {192: 1} | {576 << i: 2 + i for i in range(4)} | {256 << i: 8 + i for i in range(8)}


class BadStream(ValueError):
    """A stream that isn't FLAC, is damaged, or isn't mono with 8-bit samples."""


# --- checksums


def _crc8_table() -> np.ndarray:
    c = np.arange(256)
    for _ in range(8):
        c = np.where(c & 128, (c << 1) ^ 0x07, c << 1) & 0xFF
    return c


def _crc16_table() -> np.ndarray:
    """What 16 bits of register and message become after two bytes."""
    c = np.arange(1 << 16)
    for _ in range(16):
        c = np.where(c & 0x8000, (c << 1) ^ 0x8005, c << 1) & 0xFFFF
    return c.astype(np.int64)


_CRC8, _CRC16 = _crc8_table(), _crc16_table()


def crc8(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-8 of byte spans. Zeros before a span change nothing, so spans are lined up at their ends."""
    out = np.zeros(len(starts), np.int64)
    for back in range(int((ends - starts).max(initial=0)), 0, -1):
        at = ends - back
        out = _CRC8[out ^ np.where(at >= starts, data[np.maximum(at, 0)], 0)]
    return out


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of byte spans, two bytes a step."""
    out = np.zeros(len(starts), np.int64)
    longest = int((ends - starts).max(initial=0))
    for back in range(longest + longest % 2, 0, -2):
        at = ends - back
        high = np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.int64)
        low = np.where(at + 1 >= starts, data[np.maximum(at + 1, 0)], 0)
        out = _CRC16[out ^ (high << 8 | low)]
    return out


# --- encoding


class _Bits:
    """Fields of at most 32 bits, each at its own bit position; none overlap, so words are sums."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray | int]] = []

    def put(self, at: np.ndarray, size: np.ndarray | int, value: np.ndarray) -> None:
        self.parts.append((at, size, value))

    def bytes(self, n_bits: int) -> np.ndarray:
        n = -(-n_bits // 32) + 1
        words = np.zeros(n + 1)
        for at, size, value in self.parts:
            last = at + size - 1
            w, v = last >> 5, value.astype(np.int64) << (31 - (last & 31))
            words[1:] += np.bincount(w, v & 0xFFFFFFFF, minlength=n)
            high = v >> 32
            over = np.flatnonzero(high)
            if len(over):
                words[:-1] += np.bincount(w[over], high[over], minlength=n)
        return words[1:].astype(np.int64).astype(">u4").view(np.uint8)


def _levinson(x: np.ndarray, most: int = 4) -> np.ndarray:
    """Linear predictors of each row: (rows, order) floats, zero where a row has no energy."""
    f = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", f[:, : f.shape[1] - j], f[:, j:]) for j in range(most + 1)])
    a, error = np.zeros((most, len(x))), np.maximum(r[0], 1e-9)
    for i in range(most):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / error
        a[:i] -= k * a[:i][::-1]
        a[i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    return a.T


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameter of each row, and the bits of its codes."""
    mean = u.mean(axis=1) if u.shape[1] else np.zeros(len(u))
    guess = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1e-9))), 0, 13).astype(np.int64)
    bits = [u.shape[1] * (guess + e + 1) + (u >> (guess + e)[:, None]).sum(axis=1) for e in (0, 1)]
    return np.where(bits[0] <= bits[1], guess, guess + 1), np.minimum(*bits)


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _coded_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lanes, 6) bytes of frame numbers, coded as UTF-8 codes code points, and how many count."""
    size = 1 + sum((n >= x).astype(np.int64) for x in (0x80, 0x800, 0x10000, 0x200000, 0x4000000))
    out = np.zeros((len(n), 6), np.int64)
    for s in range(1, 7):
        rows = np.flatnonzero(size == s)
        lead = 0 if s == 1 else (0xFF00 >> s) & 0xFF
        for j in range(s):
            part = n[rows] >> (6 * (s - 1 - j))
            out[rows, j] = (lead | part) if j == 0 else 0x80 | part & 0x3F
    return out, size


def _frames(x: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Frames of equally many samples each; ``x``: (frames, samples)."""
    m, n = x.shape
    x = x.astype(np.int32)
    # predictors: the fixed one with the least residual, or the linear one if that is less
    e, best_cost, best, order = x, None, None, np.zeros(m, np.int64)
    top = min(4, n - 1)
    for o in range(top + 1):
        cost = np.abs(e[:, top - o :]).sum(axis=1)
        if o == 0:
            best_cost, best = cost, e.copy()
        else:
            rows = np.flatnonzero(cost < best_cost)
            best_cost[rows], order[rows] = cost[rows], o
            best[rows, o:] = e[rows]
        e = e[:, 1:] - e[:, :-1]
    kind = np.full(m, 2)
    coefs = np.zeros((m, 4), np.int64)
    shift = np.zeros(m, np.int64)
    if n > 8:
        a = _levinson(x)
        high = np.abs(a).max(axis=1)
        shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(high, 1e-9))).astype(np.int64), 0, 15)
        limit = (1 << (PRECISION - 1)) - 1
        coefs = np.clip(np.rint(a * (1 << shift)[:, None].astype(np.float64)), -limit, limit).astype(np.int64)
        c = coefs.astype(np.int32)
        guess = sum(c[:, j, None] * x[:, 3 - j : n - 1 - j] for j in range(4)) >> shift[:, None].astype(np.int32)
        rest = x[:, 4:] - guess
        rows = np.flatnonzero(np.abs(rest).sum(axis=1) + 4 * 8 < best_cost)
        kind[rows], order[rows] = 3, 4
        best[rows, 4:] = rest[rows]
    u = _fold(best)
    u[np.arange(n)[None] < order[:, None]] = 0  # warm-up samples aren't residuals
    k, bits = _rice(u)
    extra = np.where(kind == 3, 9 + 4 * PRECISION, 0)
    body = 8 + extra + 8 * order + 10 + bits - order * (k + 1)
    kind[body >= 8 + 8 * n] = 1
    kind[(x == x[:, :1]).all(axis=1)] = 0
    body = np.select([kind == 0, kind == 1], [16, 8 + 8 * n], body)
    # header
    code = _SIZES.get(n, 6 if n <= 256 else 7)
    tail = {6: 1, 7: 2}.get(code, 0)
    coded, coded_size = _coded_number(number)
    head_bytes = 4 + coded_size + tail + 1
    size = head_bytes + -(-body // 8) + 2
    start = np.concatenate(([0], np.cumsum(size)))
    first, begin = start[:-1] * 8, (start[:-1] + head_bytes) * 8
    put = _Bits()
    put.put(first, 32, np.full(m, 0xFFF8 << 16 | code << 12 | 4 << 8 | 0 << 4 | 1 << 1))  # 8 kHz, mono, 8 bits
    for j in range(6):
        rows = np.flatnonzero(coded_size > j)
        put.put(first[rows] + 32 + 8 * j, 8, coded[rows, j])
    if tail:
        put.put(first + 32 + 8 * coded_size, 8 * tail, np.full(m, n - 1))
    put.put(begin, 8, np.select([kind == 0, kind == 1, kind == 2], [0, 2, (8 + order) << 1], (32 + order - 1) << 1))
    put.put(begin[kind == 0] + 8, 8, x[kind == 0, 0].astype(np.int64) & 0xFF)
    rows = np.flatnonzero(kind == 1)
    if len(rows):
        put.put((begin[rows, None] + 8 + 8 * np.arange(n)[None]).ravel(), 8, x[rows].ravel().astype(np.int64) & 0xFF)
    for j in range(top):
        rows = np.flatnonzero((kind >= 2) & (order > j))
        put.put(begin[rows] + 8 + 8 * j, 8, x[rows, j].astype(np.int64) & 0xFF)
    at = begin + 8 + 8 * order
    rows = np.flatnonzero(kind == 3)
    put.put(at[rows], 9, (PRECISION - 1) << 5 | shift[rows])
    for j in range(4):
        put.put(at[rows] + 9 + j * PRECISION, PRECISION, coefs[rows, j] & ((1 << PRECISION) - 1))
    at = at + extra
    rows = np.flatnonzero(kind >= 2)
    put.put(at[rows], 10, k[rows])  # method 0, no division, the parameter
    live = (np.arange(n)[None] >= order[rows, None]).ravel()
    q = (u[rows] >> k[rows, None].astype(np.int32)).ravel()[live]
    kk = np.repeat(k[rows], n)[live]
    length = q + kk + 1
    ends = np.cumsum(length)
    counts = n - order[rows]
    lead = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))[:-1]]
    where = ends - length + np.repeat(at[rows] + 10 - lead, counts) + q
    low = u[rows].ravel()[live] & ((1 << kk) - 1)
    put.put(where, kk + 1, low | (1 << kk))
    data = put.bytes(int(start[-1]) * 8)[: start[-1]].copy()
    data[start[:-1] + head_bytes - 1] = crc8(data, start[:-1], start[:-1] + head_bytes - 1)
    check = crc16(data, start[:-1], start[1:] - 2)
    data[start[1:] - 2], data[start[1:] - 1] = check >> 8, check & 0xFF
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def encode(payloads: Sequence[bytes]) -> list[bytes]:
    """A FLAC stream for each non-empty payload of bytes, with a seek point for every frame."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    if (sizes == 0).any():
        raise ValueError("a stream has at least one sample")
    data = np.frombuffer(b"".join(payloads), np.uint8)
    n_frames = -(-sizes // BLOCK)
    stream = np.repeat(np.arange(len(sizes)), n_frames)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(n_frames) - n_frames, n_frames)
    first = np.repeat(np.cumsum(sizes) - sizes, n_frames) + number * BLOCK
    length = np.minimum(BLOCK, sizes[stream] - number * BLOCK)
    frames: list[bytes] = [b""] * len(stream)
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        for part in range(0, len(rows), LANES):
            some = rows[part : part + LANES]
            x = data[first[some][:, None] + np.arange(n)[None]].astype(np.int16) - 128
            for r, f in zip(some.tolist(), _frames(x, number[some]), strict=True):
                frames[r] = f
    out, at = [], 0
    for p, count in zip(payloads, n_frames.tolist(), strict=True):
        own = frames[at : at + count]
        lens = np.array([len(f) for f in own])
        starts = np.cumsum(lens) - lens
        block = min(BLOCK, len(p)) if count == 1 else BLOCK
        block = max(block, 16)
        info = block.to_bytes(2, "big") * 2 + int(lens.min()).to_bytes(3, "big") + int(lens.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(bytes(np.frombuffer(p, np.uint8) ^ 0x80)).digest()
        points = np.zeros(count, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
        points["s"], points["o"], points["n"] = np.arange(count) * BLOCK, starts, [BLOCK] * (count - 1) + [len(p) - BLOCK * (count - 1)]
        table = points.tobytes()
        head = b"fLaC\x00" + len(info).to_bytes(3, "big") + info
        # a metadata block has at most 2^24 - 1 bytes; a longer stream goes without seek points and is read in order
        head = head + b"\x83" + len(table).to_bytes(3, "big") + table if len(table) < 1 << 24 else b"fLaC\x80" + head[5:]
        out.append(head + b"".join(own))
        at += count
    return out


# --- decoding


@dataclass
class Decoded:
    """What a stream holds; ``error`` says why there is no more."""

    pcm: list[bytes] = field(default_factory=list)
    first: list[int] = field(default_factory=list)  # sample
    offset: list[int] = field(default_factory=list)  # byte of the stream
    size: list[int] = field(default_factory=list)  # bytes
    kind: list[int] = field(default_factory=list)
    error: str | None = None

    @property
    def payload(self) -> bytes:
        return b"".join(self.pcm)


@dataclass
class _Head:
    audio: int  # where the first frame begins
    block: int
    total: int
    md5: bytes
    points: dict[int, int]  # first sample: byte offset


def _head(s: bytes) -> _Head:
    if s[:4] != b"fLaC":
        raise BadStream("no FLAC marker")
    at, info, points, last = 4, None, {}, False
    while not last:
        if at + 4 > len(s):
            raise BadStream("cut short in its metadata")
        last, kind, size = bool(s[at] & 128), s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
        body = s[at + 4 : at + 4 + size]
        if len(body) < size:
            raise BadStream("cut short in its metadata")
        if kind == 0:
            info = body
        elif kind == 3:
            for j in range(0, size - 17, 18):
                sample = int.from_bytes(body[j : j + 8], "big")
                if sample != (1 << 64) - 1:  # a placeholder
                    points[sample] = int.from_bytes(body[j + 8 : j + 16], "big")
        at += 4 + size
    if info is None or len(info) < 34:
        raise BadStream("no stream information")
    bits = int.from_bytes(info[10:18], "big")
    if bits >> 41 & 7 or (bits >> 36 & 31) != 7:
        raise BadStream("not mono with 8-bit samples")
    return _Head(at, int.from_bytes(info[2:4], "big"), bits & ((1 << 36) - 1), info[18:34], points)


class _Reader:
    """Bits of one buffer at many positions."""

    def __init__(self, data: bytes) -> None:
        self.raw = data + bytes(16)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.words = np.ndarray(len(data) + 8, "<u8", self.raw, strides=(1,))
        self.n_bits = len(data) * 8

    def window(self, pos: np.ndarray) -> np.ndarray:
        """64 bits from ``pos`` on, of which the first 57 are valid."""
        pos = np.minimum(pos, self.n_bits)
        return self.words[pos >> 3].byteswap() << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, size: np.ndarray | int, signed: bool = False) -> np.ndarray:
        """Numbers of at most 32 bits; of 0 bits, 0."""
        size = np.broadcast_to(np.asarray(size, np.int64), pos.shape)
        v = ((self.window(pos) >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
        return np.where((size > 0) & (v >> np.maximum(size - 1, 0) & 1 == 1), v - (1 << size), v) if signed else v

    def unary(self, pos: np.ndarray) -> np.ndarray:
        """How many zeros stand before the next one."""
        out = np.zeros(len(pos), np.int64)
        rows = np.arange(len(pos))
        while len(rows):
            top = (self.window(pos[rows] + out[rows]) >> np.uint64(11)).astype(np.int64)
            none = top == 0
            out[rows] += np.where(none, 53, 1075 - (top.astype(np.float64).view(np.int64) >> 52))
            rows = rows[none]
            rows = rows[pos[rows] + out[rows] < self.n_bits]
        return out


def _decode_frames(r: _Reader, at: np.ndarray, limit: np.ndarray) -> tuple[list[bytes | None], np.ndarray, np.ndarray, list[str | None]]:
    """Samples, end, kind and error of the frames that begin at the bytes ``at`` and end before ``limit``."""
    m = len(at)
    error: list[str | None] = [None] * m
    bad = np.zeros(m, bool)

    def fail(where: np.ndarray, why: str) -> None:
        for i in np.flatnonzero(where & ~bad).tolist():
            error[i] = why
        np.logical_or(bad, where, out=bad)

    byte = lambda p: r.data[np.minimum(p, len(r.data) - 1)].astype(np.int64)
    b1, b2, b3 = byte(at + 1), byte(at + 2), byte(at + 3)
    fail((byte(at) != 0xFF) | (b1 & 0xFE != 0xF8), "no frame where one should begin")
    lead = byte(at + 4)
    extra = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 0, 1, 2, 3, 4, 5], 6)
    code, rate = b2 >> 4, b2 & 15
    pos = at + 5 + extra
    n = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8], [192, 576 << np.clip(code - 2, 0, 3), byte(pos) + 1, (byte(pos) << 8 | byte(pos + 1)) + 1, 256 << np.clip(code - 8, 0, 7)], 0)
    pos = pos + np.where(code == 6, 1, 0) + np.where(code == 7, 2, 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    fail((n == 0) | (rate == 15) | (b3 >> 4 != 0) | ~np.isin(b3 >> 1 & 7, (0, 1)) | (b3 & 1 != 0), "a frame header that isn't mono with 8-bit samples")
    fail(pos + 1 > limit, "cut short")
    pos = np.where(bad, at, pos)
    fail((crc8(r.data, at, pos) != byte(pos)) & ~bad, "wrong checksum of a frame header")
    head = byte(pos + 1)
    kind_code = head >> 1 & 63
    kind = np.select([kind_code == 0, kind_code == 1, (kind_code >= 8) & (kind_code <= 12), kind_code >= 32], [0, 1, 2, 3], -1)
    order = np.select([kind == 2, kind == 3], [kind_code - 8, kind_code - 31], 0)
    fail((kind < 0) | (head & 129 != 0) | (order > n), "a subframe of an unknown kind")
    bits = (pos + 2) * 8
    samples: list[bytes | None] = [None] * m
    end = np.where(kind == 0, bits + 8, bits + 8 * n)
    for i in np.flatnonzero(~bad & (kind == 0)).tolist():
        samples[i] = bytes([int(byte(bits[i : i + 1] >> 3)[0]) ^ 0x80]) * int(n[i])
    for i in np.flatnonzero(~bad & (kind == 1)).tolist():
        a = int(bits[i]) >> 3
        samples[i] = (r.data[a : a + int(n[i])] ^ 0x80).tobytes()
    rows = np.flatnonzero(~bad & (kind >= 2))
    if len(rows):
        rows = rows[np.argsort(-n[rows], kind="stable")]
        got, stop, why = _predicted(r, bits[rows], n[rows], order[rows], kind[rows] == 3, limit[rows] * 8)
        end[rows] = stop
        for j, i in enumerate(rows.tolist()):
            if why[j]:
                error[i], bad[i] = why[j], True
            else:
                samples[i] = got[: int(n[i]), j].tobytes()
    end = -(-end // 8)
    fail(end + 2 > limit, "cut short")
    ok = np.flatnonzero(~bad)
    wrong = np.zeros(m, bool)
    wrong[ok] = crc16(r.data, at[ok], end[ok]) != (byte(end[ok]) << 8 | byte(end[ok] + 1))
    fail(wrong, "wrong checksum of a frame")
    return [None if b else s for b, s in zip(bad, samples, strict=True)], end + 2, kind, error


def _predicted(r: _Reader, pos: np.ndarray, n: np.ndarray, order: np.ndarray, linear: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """(samples x lanes) bytes of FIXED and LPC frames, longest first; where each ends; what is wrong with it."""
    m, longest, most = len(pos), int(n[0]), int(order.max())
    why: list[str | None] = [None] * m
    x = np.zeros((longest, m), np.int64)
    for t in range(most):
        rows = np.flatnonzero(order > t)
        x[t, rows] = r.read(pos[rows] + 8 * t, 8, signed=True)
    pos = pos + 8 * order
    coefs, shift = np.zeros((max(most, 1), m), np.int64), np.zeros(m, np.int64)
    for o in range(1, min(most, 4) + 1):
        rows = np.flatnonzero(~linear & (order == o))
        coefs[:o, rows] = np.array(_FIXED[o])[:, None]
    rows = np.flatnonzero(linear)
    if len(rows):
        precision = r.read(pos[rows], 4) + 1
        shift[rows] = r.read(pos[rows] + 4, 5, signed=True)
        for j in range(most):
            some = np.flatnonzero(order[rows] > j)
            coefs[j, rows[some]] = r.read(pos[rows[some]] + 9 + j * precision[some], precision[some], signed=True)
        for i in rows[(precision == 16) | (shift[rows] < 0)].tolist():
            why[i] = "a predictor that isn't allowed"
        shift = np.maximum(shift, 0)
        pos[rows] += 9 + order[rows] * precision
    method, division = r.read(pos, 2), r.read(pos + 2, 4)
    part = n >> division
    for i in np.flatnonzero((method > 1) | (part << division != n) | (part < order)).tolist():
        why[i] = why[i] or "residuals of an unknown form"
    part = np.where([w is not None for w in why], n, part)  # such a lane runs on, bounded, and is thrown away
    pos = pos + 6
    k, raw = np.zeros(m, np.int64), np.full(m, -1)
    starts = {0, *np.unique(order).tolist(), *(t for p in np.unique(part).tolist() if p < longest for t in range(p, longest, p))}
    width = np.where(method == 1, 5, 4)
    count = np.searchsorted(-n, -np.arange(longest), "left")  # lanes that are longer than t
    for t in range(longest):
        c = int(count[t])
        if t in starts:
            new = np.flatnonzero((t == order[:c]) | (t > order[:c]) & (t % part[:c] == 0))
            if len(new):
                k[new] = r.read(pos[new], width[new])
                pos[new] += width[new]
                free = k[new] == (1 << width[new]) - 1
                raw[new] = np.where(free, r.read(pos[new], 5), -1)
                pos[new] += np.where(free, 5, 0)
        lanes = slice(0, c) if t >= most else np.flatnonzero(order[:c] <= t)
        p, kk = pos[lanes], k[lanes]
        q = r.unary(p)
        after = p + q + 1
        u = q << kk | r.read(after, kk)
        e = u >> 1 ^ -(u & 1)
        after = after + kk
        if (raw[lanes] >= 0).any():
            w = raw[lanes]
            e, after = np.where(w >= 0, r.read(p, np.maximum(w, 0), signed=True), e), np.where(w >= 0, p + w, after)
        pos[lanes] = np.minimum(after, limit[lanes] + 8)
        guess = np.zeros(len(p), np.int64)
        for j in range(min(most, t)):
            guess += coefs[j, lanes] * x[t - 1 - j, lanes]
        x[t, lanes] = e + (guess >> shift[lanes])
    for i in np.flatnonzero((np.abs(x) > 128).any(axis=0)).tolist():
        why[i] = why[i] or "samples of more than 8 bits"
    return ((x + 128) & 0xFF).astype(np.uint8), pos, why


def decode(streams: Sequence[bytes | None]) -> list[Decoded]:
    """Blocks of each stream, up to the first fault. Frame checksums, sample counts and the whole's MD5 are verified."""
    out = [Decoded() for _ in streams]
    heads: dict[int, _Head] = {}
    for i, s in enumerate(streams):
        try:
            heads[i] = _head(s or b"")
        except BadStream as e:
            out[i].error = str(e)
    base = np.cumsum([0, *[len(s or b"") for s in streams]])
    r = _Reader(b"".join(s or b"" for s in streams))
    todo, results = [], {}  # (stream, first sample, byte, whether its end is the next frame's start)
    for i, h in heads.items():
        seekable = h.block and h.total and sorted(h.points) == list(range(0, h.total, h.block)) and max(h.points.values()) < base[i + 1] - base[i] - h.audio
        todo += [(i, s, int(base[i]) + h.audio + o, False) for s, o in h.points.items()] if seekable else [(i, 0, int(base[i]) + h.audio, True)]
    while todo:
        now, todo = todo[:LANES], todo[LANES:]
        at = np.array([x[2] for x in now])
        limit = np.array([base[x[0] + 1] for x in now])
        samples, ends, kinds, errors = _decode_frames(r, at, limit)
        for (i, first, begin, follow), s, end, kind, error in zip(now, samples, ends.tolist(), kinds.tolist(), errors, strict=True):
            results[i, first] = (s, begin - int(base[i]), end - begin, kind, error)
            if follow and s is not None and end < base[i + 1] and (not heads[i].total or first + len(s) < heads[i].total):
                todo.append((i, first + len(s), end, True))
    for (i, first), (s, begin, size, kind, error) in sorted(results.items()):
        d = out[i]
        if d.error:
            continue
        if s is None or first != (d.first[-1] + len(d.pcm[-1]) if d.first else 0):
            d.error = error or "samples are missing"
            continue
        for into, value in zip((d.pcm, d.first, d.offset, d.size, d.kind), (s, first, begin, size, kind), strict=True):
            into.append(value)
    for i, h in heads.items():
        d = out[i]
        if not d.error and h.total and sum(map(len, d.pcm)) != h.total:
            d.error = "samples are missing"
        if not d.error and any(h.md5) and hashlib.md5(bytes(np.frombuffer(d.payload, np.uint8) ^ 0x80)).digest() != h.md5:
            d.error = "wrong checksum of the whole"
    return out


# --- columns


def padded(text: bytes) -> bytes:
    """The bytes, filled with blanks up to a positive multiple of UNIT."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _steps(values: pa.Array, size: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one row."""
    lens = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in values], np.int64)
    ends = np.cumsum(lens)
    at = 0
    while at < len(lens):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, stop
        at = stop


def _appended(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])


def to_media(docs: DataFrame, *, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """The rows without their text, and ``media``: the text's bytes, padded, as a FLAC stream.

    Defined cases: a null or empty text is one unit of blanks; every row is stored by its own text, so repeated rows and
    ids give equal streams; an empty table gives an empty table; other columns pass through, and one that is named as
    the result is an error.
    """
    if media_col in docs.columns and media_col != text_col:
        raise ValueError(f"column {media_col!r} is there already")
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    raw = docs.select(*rest, F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("__raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(len(rest))
            for a, b in _steps(raw):
                media = encode([padded(v.as_py()) for v in raw[a:b]])
                yield _appended(batch.slice(a, b - a).select(rest), {media_col: pa.array(media, pa.binary())})

    schema = docs.select(*rest).withColumn(media_col, F.lit(b"")).schema
    return raw.mapInArrow(run, schema)


def pcm_blocks(table: DataFrame, *, media_col: str = "media", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """PCM blocks of FLAC streams: the keys, block, first_sample, n_samples, byte_offset, n_bytes, kind, pcm, error.

    A block is a frame: ``first_sample`` and ``byte_offset`` say where to seek. ``pcm`` has a byte a sample, 128 for zero.
    A stream that is damaged, cut short, null or no mono 8-bit FLAC keeps the blocks before the fault, and one row more
    without samples says what is wrong. Rows with equal keys give blocks each; an empty table gives an empty table.
    """
    small_batches(table.sparkSession)
    narrow = table.select(*keys, F.col(media_col).alias("__media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(len(keys))
            for a, b in _steps(media):
                rows, cols = [], {c: [] for c in ("block", "first_sample", "n_samples", "byte_offset", "n_bytes", "kind", "pcm", "error")}
                for i, d in enumerate(decode([v.as_py() for v in media[a:b]])):
                    found = [(j, f, len(p), o, s, KINDS[k], p, None) for j, (f, p, o, s, k) in enumerate(zip(d.first, d.pcm, d.offset, d.size, d.kind, strict=True))]
                    found += [(len(found), None, None, None, None, None, None, d.error)] if d.error else []
                    rows += [a + i] * len(found)
                    for values, c in zip(zip(*found, strict=True), cols, strict=True):
                        cols[c] += values
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
                own = batch.select(list(range(len(keys)))).take(pa.array(rows, pa.int64()))
                yield _appended(own, {c: pa.array(v, t) for (c, v), t in zip(cols.items(), kinds, strict=True)})

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{types}, block long, first_sample long, n_samples long, byte_offset long, n_bytes long, kind string, pcm binary, error string")


def _feature(d: Decoded) -> str:
    """Frames of each kind, mean, energy and sign changes of the samples, in whole numbers."""
    x = np.frombuffer(d.payload, np.uint8).astype(np.int64) - 128
    counts = np.bincount(np.array(d.kind, np.int64), minlength=4).tolist()
    return ":".join(map(str, (len(d.kind), *counts, int(x.sum()), int((x * x).sum()), int(((x[1:] < 0) != (x[:-1] < 0)).sum()))))


def read_back(table: DataFrame, *, media_col: str = "media") -> DataFrame:
    """The rows with digests instead of ``media``: payload_bytes, payload_sha256, tail, feature, error.

    ``tail`` is the last 16 bytes. A stream with a fault has nulls and its error.
    """
    rest = [c for c in table.columns if c != media_col]
    narrow = table.select(*rest, media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(len(rest))
            for a, b in _steps(media):
                found = [(None, None, None, None, d.error) if d.error else (len(p := d.payload), hashlib.sha256(p).hexdigest(), p[-16:], _feature(d), None) for d in decode([v.as_py() for v in media[a:b]])]
                kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail": pa.binary(), "feature": pa.string(), "error": pa.string()}
                yield _appended(batch.slice(a, b - a).select(rest), {c: pa.array(v, t) for (c, t), v in zip(kinds.items(), zip(*found, strict=True), strict=True)})

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{types + ', ' if types else ''}payload_bytes long, payload_sha256 string, tail binary, feature string, error string")


def media_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored as FLAC, read back, and told in digests; see the query ``op13_flac_media``."""
    sha = lambda c: F.sha2(c, 256)
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stored = to_media(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")))
    stored = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", sha(F.col("media")))
    back = read_back(stored)
    return back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", F.crc32("tail").alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "error")
