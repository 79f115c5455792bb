"""Vectorised scanning of Arrow string columns as UTF-8 bytes.

Everything here works on the concatenated bytes of a column, so a batch of documents is
tokenised and hashed by a handful of numpy passes instead of a Python loop per word. Work is
done in segments of about ``SEGMENT`` bytes that end between words, so the memory used besides
the results does not grow with the longest text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Hand freed memory back to the system: a worker lives on between stages, and keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()


def byte_class(keep) -> np.ndarray:
    """256 booleans from a predicate on the (already lower-cased) byte value."""
    return np.array([bool(keep(int(LOWER[b]))) for b in range(256)])


#: everything but space, tab, newline, vertical tab, form feed and carriage return
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ASCII letters and digits, and every byte of a non-ASCII character
WORDLIKE = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is one of no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (in place when possible)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


class _Powers:
    """r**i and r**-i modulo 2**64, made once per process and extended when a segment needs more."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            r = int(_ODD) | 1
            inverse = pow(r, -1, 2**64)
            self.up, self.down = (self._grow(x, n) for x in (r, inverse))
            self.n = n
        return self.up, self.down

    @staticmethod
    def _grow(r: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        have = 1
        while have < n:
            step = np.uint64(pow(r, have, 2**64))
            more = min(have, n - have)
            out[have : have + more] = out[:more] * step
            have += more
        return out


_powers = _Powers()
_byte_codes = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)[LOWER] | np.uint64(1)


def _segments(data: np.ndarray, is_word: np.ndarray):
    """Cut [0, n) after non-word bytes into pieces of about SEGMENT bytes."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n:
            gaps = np.flatnonzero(~is_word[data[max(at, end - 65536) : end]])
            if len(gaps):
                end = max(at, end - 65536) + int(gaps[-1]) + 1
                break
            end = min(n, end + SEGMENT)
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Maximal runs of word bytes inside each text.

    Returns (start, end, hash, first): byte spans of all words in order, a 64-bit hash of each
    lower-cased word, and for every text the index of its first word (one more entry at the end).
    """
    starts, ends, hashes = [], [], []
    for a, b in _segments(data, is_word):
        piece = data[a:b]
        w = is_word[piece]
        s, e = w.copy(), w.copy()
        s[1:] &= ~w[:-1]
        e[:-1] &= ~w[1:]
        lo, hi = np.searchsorted(offsets, [a, b])
        edge = offsets[lo:hi] - a
        edge = edge[(edge >= 0) & (edge < b - a)]
        s[edge] = w[edge]
        before = edge[edge > 0] - 1
        e[before] = w[before]
        if b in offsets[lo : hi + 1]:
            e[-1] = w[-1]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        up, down = _powers.upto(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_byte_codes[piece] * up[: b - a], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + a)
        ends.append(e + a)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, offsets)


def word_ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs inside each text and the text index of each."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    total = max(len(h) - n + 1, 0)
    if not total or not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    combined = h[:total].copy()
    for k in range(1, n):
        combined = combined * _ODD + h[k : total + k]
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][text]
    return mix(combined[at]), text
