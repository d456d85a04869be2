"""Array kernels over the raw UTF-8 of many documents at once.

Texts reach Python as Arrow batches. :func:`pieces` hands them out as one byte buffer with document offsets, without a
Python string per row; everything else works on that buffer. Words are maximal runs of bytes other than the six ASCII
white-space characters (``[^\\x20\\x09-\\x0D]+``), which bytes beyond ASCII never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one array step handles. A longer document is a step of its own.
STEP_BYTES = 250_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all 64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, len(self.up) * 2)
            self.up, self.down = (np.concatenate((np.ones(1, _U), np.cumprod(np.full(size - 1, b, _U), dtype=_U))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_IN_WORD = _Powers(0x9E3779B97F4A7C15 | 1)
_IN_WINDOW = (_Powers(0xD1342543DE82EF95), _Powers(0xAF251AF3B0F025B5))


def pieces(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of steps of a string array; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word of the buffer, in order. No word spans two documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~_SPACE[data]
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    before[edges] = False
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; the same on every machine."""
    up, down = _IN_WORD.get(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


class Windows:
    """Hashes of any run of words, from the words' own hashes, in constant time each."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sums = []
        for powers in _IN_WINDOW:
            up, self_down = powers.get(len(hashes) + 1)
            s = np.zeros(len(hashes) + 1, _U)
            np.cumsum(hashes * up[: len(hashes)], out=s[1:])
            self.sums.append((s, self_down))

    def get(self, starts: np.ndarray, length: np.ndarray | int, lane: int = 0) -> np.ndarray:
        s, down = self.sums[lane]
        return mix((s[starts + length] - s[starts]) * down[starts] + _U(lane + 1))


def whole_windows(doc: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of ``length`` words that lie in one document."""
    if len(doc) < length:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[: len(doc) - length + 1] == doc[length - 1 :])


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of every code point."""
    return (data & 0xC0) != 0x80


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a window that begins at one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:n]) > 0
