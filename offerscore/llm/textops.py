"""Vectorised text helpers that run inside Arrow-batched tasks.

All of them work on the raw UTF-8 buffer of a batch of texts: one pass finds
the words, one pass hashes them, and no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M64 = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64): spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = (_splitmix(256, 1), _splitmix(256, 2))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, seed: int) -> np.ndarray:
    have = _POWERS.get(seed)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        base = np.full(size, _ODD[seed], dtype=np.uint64)
        base[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(base)
        _POWERS[seed] = have
    return have[:n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    return _LOWER[data]


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte offsets) of the words ``[^\\x20\\x09-\\x0D]+`` of
    back-to-back texts that end at ``ends``, and the words before each text's end."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(ends), dtype=np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = ends[(ends > 0) & (ends < len(data))]
    first[inner] = word[inner]            # a text boundary also starts a word
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends, side="left")


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span ``data[start:end]``: a polynomial over random
    byte values, shifted to the span's own origin, then mixed with its length."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[seed][data] * _powers(n, seed), out=sums[1:])
        # multiplying by r^(n-start) aligns all spans to the same power
        value = (sums[ends] - sums[starts]) * _powers(n + 1, seed)[n - starts]
        return mix(value * _back(n, seed) ^ (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _back(n: int, seed: int) -> np.uint64:
    """r^-n modulo 2^64, so that a span's hash does not depend on the buffer's length."""
    return np.uint64(pow(pow(_ODD[seed], n, 1 << 64), -1, 1 << 64))


def window_hash(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes (windows may cross texts; mask them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        factors = _splitmix(size, 7 + seed) | np.uint64(1)
        total = words[:n] * factors[0]
        for j in range(1, size):
            total += words[j:j + n] * factors[j]
        return mix(total)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and end offsets of a string or binary Arrow column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if raw[2] is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column), dtype=np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets[1:] - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20):
    """(first row, end row) pieces of a column with about ``most`` bytes each; a
    longer text is a piece of its own, never cut."""
    _, ends = buffers(column)
    row = 0
    while row < len(ends):
        base = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield row, min(stop, len(ends))
        row = stop


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Boolean mask of length ``n``: positions inside some ``[start, start + size)``."""
    if not len(starts):
        return np.zeros(n, dtype=bool)
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + size, n), -1)
    return np.cumsum(steps[:-1]) > 0


def winnow(grams: np.ndarray, ends: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers.  ``grams``: a hash for the ``gram`` bytes that start at each
    position; ``ends``: text ends.  For every run of ``window`` consecutive gram
    starts inside one text the leftmost smallest gram is its anchor, so equal byte
    strings have the same anchor.  Returns anchor position, first and last run start."""
    none = np.zeros(0, dtype=np.int64)
    n = len(grams)
    if n < window:
        return none, none, none
    index_bits = np.uint64((1 << 40) - 1)
    # order by hash (24 bits), then by position: the leftmost of equal grams
    keyed = (grams & ~index_bits) | np.arange(n, dtype=np.uint64)
    # smallest of ``window`` neighbours, by doubling
    span = 1
    while 2 * span <= window:
        keyed = np.minimum(keyed[:-span], keyed[span:])
        span *= 2
    runs = n - window + 1
    best = (np.minimum(keyed[:runs], keyed[window - span:window - span + runs]) & index_bits).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(runs, dtype=bool)
    for_all = ends - starts >= gram + window - 1
    steps = np.zeros(runs + 1, dtype=np.int32)
    np.add.at(steps, starts[for_all], 1)
    np.add.at(steps, np.minimum(ends[for_all] - (gram + window - 1) + 1, runs), -1)
    inside = np.cumsum(steps[:-1]) > 0
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none, none
    pick = best[at]
    cut = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.concatenate([cut[1:], [len(at)]]) - 1
    return pick[cut], at[cut], at[last]
