"""Vectorised word and shingle hashing over Arrow text columns."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_table() -> np.ndarray:
    lut = np.zeros(256, dtype=np.uint8)
    for lo, hi in ((48, 57), (97, 122), (95, 95)):
        lut[lo : hi + 1] = np.arange(lo, hi + 1)
    lut[65:91] = np.arange(97, 123)
    return lut


_LUT = _word_table()


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def ascii_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word: longest runs of ASCII letters, digits and ``_``, lower-cased."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return none
    low = _LUT[data]
    inside = low > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < len(data)]
    first[row_starts] = inside[row_starts]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    begin = np.searchsorted(at, starts)
    length = np.diff(np.append(begin, len(at)))
    where = np.arange(len(at)) - np.repeat(begin, length)
    value = low[at].astype(np.uint64) * _powers(int(length.max()))[where]
    return mix(np.add.reduceat(value, begin) + length.astype(np.uint64)), np.searchsorted(offsets, starts, "right") - 1


_ANY_WORD = re.compile(r"[^\W_]+")


_WORD_SEEN: dict[str, int] = {}


def unicode_words(text: str | None) -> list[str]:
    """Longest runs of letters and digits of any script, case-folded."""
    return [w.casefold() for w in _ANY_WORD.findall(text)] if text else []


def _hash_of(word: str) -> int:
    if len(_WORD_SEEN) > 500_000:
        _WORD_SEEN.clear()
    h = _WORD_SEEN[word] = xxhash.xxh3_64_intdigest(word.casefold())
    return h


def unicode_word_hashes(text: str | None) -> list[int]:
    """64-bit hashes of ``unicode_words``, equal on every machine."""
    if not text:
        return []
    seen = _WORD_SEEN.get
    return [h if (h := seen(w)) is not None else _hash_of(w) for w in _ANY_WORD.findall(text)]


def grams(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word's index of every ``k`` consecutive words of one row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j, p in enumerate(_powers(k, _U(0xD6E8FEB86659FD93))):
        h += words[j : j + n] * p
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(h[at]), rows[at], at


def row_sets(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ordered by row and value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]


def minhash(values: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` 32-bit minima per segment that begins at ``starts``."""
    out = np.empty((len(starts), coordinates), np.uint32)
    for c in range(coordinates):
        seed = mix(np.array([c + 1], np.uint64) * _BASE)[0]
        scrambled = (values ^ seed) * _M1
        scrambled ^= scrambled >> _U(29)
        scrambled *= _M2
        out[:, c] = np.minimum.reduceat((scrambled >> _U(32)).astype(np.uint32), starts)
    return out


def winnow(hashes: np.ndarray, rows: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the fingerprints: the rightmost least hash of every ``window`` neighbours of one row.

    A row with fewer hashes than a window keeps its least one.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    best, value = np.arange(n), hashes.copy()
    end = np.searchsorted(rows, rows, "right")
    size = np.minimum(window, end - np.arange(n))
    for j in range(1, window):
        at = np.arange(n - j)
        better = (size[: n - j] > j) & (hashes[j:] <= value[: n - j])
        best[at[better]] = at[better] + j
        value[at[better]] = hashes[at[better] + j]
    first = np.searchsorted(rows, rows, "left") == np.arange(n)
    return np.unique(best[(size == window) | first])
