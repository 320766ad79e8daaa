"""Words and shingles of UTF-8 texts as 64-bit hashes, whole Arrow columns at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
STEP = 1 << 19
LONG_WORD = 32

_SPACE = np.isin(np.arange(256), list(SPACES))
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BASE, STEP + 1), _powers(BACK, STEP + 1)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word."""
    letter = ~_SPACE[data]
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = letter[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = letter[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """One hash a word, with A-Z as a-z if ``lower``; works through the bytes in short steps.

    Words of up to 32 bytes are hashed together, by a polynomial that can't vanish at that length
    for words made to agree; longer ones, which could be so made, one by one.
    """
    found = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        at = starts[k]
        n = max(int(np.searchsorted(ends, at + STEP, "right")) - k, 1)
        to = ends[k + n - 1]
        piece = data[at:to]
        piece = _LOWER[piece] if lower else piece
        up, down = (_UP, _DOWN) if len(piece) <= STEP else (_powers(BASE, len(piece) + 1), _powers(BACK, len(piece) + 1))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUE[piece] * up[: len(piece)], out=total[1:])
        s, e = starts[k : k + n] - at, ends[k : k + n] - at
        found[k : k + n] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        k += n
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        word = data[starts[k] : ends[k]]
        found[k] = int.from_bytes(hashlib.blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
    return found


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one after another, and their offsets.

    A row with words, but fewer than ``width``, has its whole sequence as the one shingle.
    """
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends, lower)
    n = len(words)
    grams = np.zeros(n, np.uint64)
    for j in range(width):
        grams[: max(n - width + 1, 0)] = grams[: max(n - width + 1, 0)] * np.uint64(BASE) + words[j : max(n - width + 1, 0) + j]
    grams = mixed(grams)
    sets, at = [], np.zeros(len(offsets), np.int64)
    for row in range(len(offsets) - 1):
        a, b = int(first[row]), int(first[row + 1])
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = np.uint64((int(whole) * BASE + int(w)) % (1 << 64))
            own = mixed(np.array([whole]))
        else:
            own = words[:0]
        sets.append(own)
        at[row + 1] = at[row] + len(own)
    return (np.concatenate(sets) if sets else words[:0]), at


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows holding at most ``most`` bytes, or one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1, row + 1)
        yield row, to
        row = to
