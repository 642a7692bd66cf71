"""Words of whole texts as 64-bit hashes, computed with NumPy over UTF-8 bytes.

A word is a run of bytes other than ``\\x20 \\x09-\\x0D``.  The hash of a word is a
polynomial of random per-byte values modulo 2**64, taken from running sums, so
the cost per word does not depend on Python.  Runs of words (shingles, anchors,
windows) are hashed the same way over the word hashes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def _values(fold: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
    if fold:
        values[65:91] = values[97:123]
    return values


_BYTES = {fold: _values(fold) for fold in (False, True)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept per worker up to 4M entries."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.cumprod(np.concatenate(([U(1)], np.full(size - 1, b, U)))) for b in (base, inverse))
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def word_hashes(data: np.ndarray, fold: bool = False, step: int = 1 << 16):
    """(hash, start, end) of the words of a byte array; ``fold`` lower-cases A-Z.

    Works through the bytes in steps that end at white space, so temporaries
    stay small whatever the length of the text.
    """
    parts, n, a, values = [], len(data), 0, _BYTES[fold]
    while a < n:
        b = min(n, a + step)
        while b < n and not _SPACE[data[b - 1]]:  # rarely more than one word further
            ahead = np.flatnonzero(_SPACE[data[b:b + step]])
            b = b + int(ahead[0]) + 1 if len(ahead) else min(n, b + step)
        piece = data[a:b]
        blank = _SPACE[piece]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            p, inv = powers(_BASE, len(piece))
            total = np.empty(len(piece) + 1, U)
            total[0] = 0
            np.cumsum(values[piece] * p, out=total[1:])
            parts.append((mix((total[ends] - total[starts]) * inv[starts]), starts + a, ends + a))
        a = b
    if not parts:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*parts))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Hash of the bytes start..end-1 of ascending spans that do not overlap."""
    out, a, n = np.empty(len(starts), U), 0, len(starts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + step, "right")))
        base = int(starts[a])
        piece = data[base:int(ends[b - 1])]
        p, inv = powers(_BASE, len(piece) + 1)
        total = np.empty(len(piece) + 1, U)
        total[0] = 0
        np.cumsum(_BYTES[False][piece] * p[:-1], out=total[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        out[a:b] = mix((total[e] - total[s]) * inv[s] + (e - s).astype(U))
        a = b
    return out


def run_sums(hashes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which ``runs`` takes the hash of any run of words."""
    p, inv = powers(base, len(hashes) + 1)
    total = np.empty(len(hashes) + 1, U)
    total[0] = 0
    np.cumsum(hashes * p[:-1], out=total[1:])
    return total, inv


def runs(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words start..end-1 for each pair."""
    total, inv = sums
    return mix((total[end] - total[start]) * inv[start] + (end - start).astype(U))


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` consecutive values, the first of equal ones."""
    at, span = np.arange(len(values)), 1
    while 2 * span <= width:
        right = at[span:]
        left = at[:len(right)]
        at, span = np.where(values[right] < values[left], right, left), 2 * span
    if span < width:
        right = at[width - span:]
        left = at[:len(right)]
        at = np.where(values[right] < values[left], right, left)
    return at


def joined(texts, fold_none: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array with a line end after each text, and the offset of each text."""
    raw = [t.as_buffer().to_pybytes() if t.is_valid else fold_none for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), offsets


def words_of(texts, fold: bool = False):
    """(hashes, starts, ends, first word of each text and the end, bytes, byte offsets) of an Arrow string array."""
    data, offsets = joined(texts)
    hashes, starts, ends = word_hashes(data, fold)
    return hashes, starts, ends, np.searchsorted(starts, offsets), data, offsets
