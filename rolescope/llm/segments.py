"""Windows of a fixed width, grouped by an anchor that only their own content decides.

A window's anchor is its gram with the least hash (the first one among equals). Equal windows have equal
anchors at equal offsets, wherever they stand. Neighbouring windows mostly share an anchor and form a
segment. A segment's block is the stretch that all its windows have in common, at least about half a
window; its hash is the key. So equal windows always lie in segments of equal keys, and a sequence of n
elements has about 2n / (width - gram) segments instead of n windows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U = np.uint64
CHUNK = 1 << 18  # elements hashed at once
LOW = U((1 << 20) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
SIDE = U(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


POW = _powers(BASE, CHUNK + 4096)
IPOW = _powers(pow(BASE, -1, 1 << 64), CHUNK + 4096)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=U) * U(BASE))


class Shape(NamedTuple):
    width: int
    gram: int

    @property
    def half(self) -> int:
        return (self.width - self.gram - 1) // 2

    @property
    def block(self) -> int:
        """The least length of a block."""
        return min(self.width - self.half, self.half + 1 + self.gram)


class Segments(NamedTuple):
    row: np.ndarray  # index of the sequence
    first: np.ndarray  # first window's start in the sequence
    last: np.ndarray  # last window's start
    start: np.ndarray  # block's start, not before the last window's start
    key: np.ndarray  # hash of the block


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size: width - size + n])


def _chunk(elements: np.ndarray, ends: np.ndarray, lengths: np.ndarray, shape: Shape):
    """Segments of windows within sequences laid end to end; positions count from the chunk's start."""
    n, (width, gram), half = len(elements), shape, shape.half
    sums = np.zeros(n + 1, U)
    np.cumsum(elements * POW[:n], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * IPOW[: n - gram + 1])
    packed = (grams & ~LOW) | np.arange(n - gram + 1, dtype=U)
    anchor = (_sliding_min(packed, width - gram + 1) & LOW).astype(np.int64)
    at = np.arange(n - width + 1)
    whole = np.repeat(ends, lengths)[: n - width + 1] - at >= width
    code = np.where(whole, anchor * 2 + (anchor - at <= half), -1)
    first = np.flatnonzero(np.diff(code, prepend=-2))
    last = np.append(first[1:], n - width + 1) - 1
    kept = code[first] >= 0
    first, last = first[kept], last[kept]
    right = (code[first] & 1).astype(bool)
    start = anchor[first] - np.where(right, 0, half + 1)
    stop = np.where(right, start + width - half, anchor[first] + gram)
    key = mix(((sums[stop] - sums[start]) * IPOW[start]) ^ np.where(right, SIDE, U(0)))
    return first, last, start, key


def segments(elements: np.ndarray, offsets: np.ndarray, shape: Shape, hashed=lambda x: x) -> Segments:
    """Of every sequence elements[offsets[i]:offsets[i + 1]]; hashed makes 64-bit hashes of a stretch.

    Sequences shorter than a window have none. A sequence of any length is walked in stretches that
    overlap by a window less one, so no window is lost.
    """
    lengths = np.diff(offsets)
    parts, width = [], shape.width
    rows = np.flatnonzero(lengths >= width)
    i = 0
    while i < len(rows):
        row = rows[i]
        if lengths[row] > CHUNK:
            step = CHUNK - width + 1
            for lo in range(0, int(lengths[row]) - width + 1, step):
                size = min(CHUNK, int(lengths[row]) - lo)
                piece = hashed(elements[offsets[row] + lo: offsets[row] + lo + size])
                first, last, start, key = _chunk(piece, np.array([size]), np.array([size]), shape)
                parts.append((np.full(len(first), row), first + lo, last + lo, start + lo, key))
            i += 1
            continue
        j = i + int(np.searchsorted(np.cumsum(lengths[rows[i: i + CHUNK // width + 1]]), CHUNK, "right"))
        own = rows[i:j]
        if own[-1] - own[0] == len(own) - 1:
            piece = elements[offsets[own[0]]: offsets[own[-1] + 1]]
        else:
            piece = np.concatenate([elements[offsets[r]: offsets[r + 1]] for r in own])
        ends = np.cumsum(lengths[own])
        first, last, start, key = _chunk(hashed(piece), ends, lengths[own], shape)
        which = np.searchsorted(ends, first, "right")
        base = ends[which] - lengths[own][which]
        parts.append((own[which], first - base, last - base, start - base, key))
        i = j
    if not parts:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, np.zeros(0, U))
    return Segments(*(np.concatenate(x) for x in zip(*parts)))
