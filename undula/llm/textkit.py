"""Vectorised splitting and hashing of words over Arrow string arrays.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``, compared with A-Z lower-cased. A word is named by a 64-bit
hash; two different words of a table of a billion words agree with a chance of about 3 %, and then only as two words
among the billion.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_ROLL = [pow(0xD6E8FEB86659FD93, k, 2**64) for k in range(1, 9)]
#: Bytes hashed at a time; a longer text is hashed alone. Words of more than LONG bytes are hashed one by one, as the polynomial
#: of shorter ones gives long words of two alternating blocks the same value.
SLICE, LONG = 1 << 20, 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LETTER[65:91] = _LETTER[97:123]
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        n = max(n, SLICE + 1)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _tables["up"], _tables["down"] = np.cumprod(up, out=up), np.cumprod(down, out=down)
    return _tables["up"], _tables["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and ``len(texts) + 1`` offsets into them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each."""
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data`` and, for each text, the number of its first word (and the total)."""
    black = ~SPACE[data]
    edge = off[(off > 0) & (off < len(data))]
    start = black.copy()
    start[1:] &= ~black[:-1]
    start[edge] = black[edge]
    end = black.copy()
    end[:-1] &= ~black[1:]
    end[edge - 1] = black[edge - 1]
    start = np.flatnonzero(start)
    return start, np.flatnonzero(end) + 1, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h += (end - start).astype(np.uint64) * _U(0xA24BAED4963EE407)
    mix(h)
    for i in np.flatnonzero(end - start > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes().lower())  # lowers A-Z only
    return h


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and for each text the number of its first word (and the total)."""
    data, off = buffers(texts)
    words, firsts, n = [], [np.zeros(1, np.int64)], 0
    for a, b in slices(off):
        part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        start, end, first = spans(part, o)
        words.append(word_hashes(part, start, end))
        firsts.append(first[1:] + n)
        n += len(start)
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)), np.concatenate(firsts)


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles, one text after the other, and where each begins.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    n = len(first) - 1
    if len(words) >= k:
        g = words[: len(words) - k + 1] * _U(_ROLL[0])
        for j in range(1, k):
            g += words[j : len(words) - k + 1 + j] * _U(_ROLL[j])
        mix(g)
    sets, sizes = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            s = g[a : b - k + 1].copy()
            s.sort()
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = mix((words[a:b] * np.array(_ROLL[: b - a], np.uint64)).sum(keepdims=True, dtype=np.uint64) + _U(b - a))
        else:
            continue
        sets.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)


def binary(parts: list) -> pa.Array:
    return pa.array([p.tobytes() if isinstance(p, np.ndarray) else p for p in parts], pa.binary())


def release() -> None:
    """Give unused memory of this worker back, as workers live on and wait beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
