"""Runs of bytes of a class in batches of texts (the terms and words of lexical search and phrase mining)."""

from __future__ import annotations

import numpy as np


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """A byte class as 256 booleans, from inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


def runs(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of the class ``inside`` in back-to-back texts that end at ``ends``.

    Returns starts and ends of the runs and the number of the text that each lies in."""
    none = np.zeros(0, dtype=np.int64)
    if not len(data):
        return none, none, none
    word = np.concatenate([[False], inside[data], [False]])
    first = word[1:-1] & ~word[:-2]
    last = word[1:-1] & ~word[2:]
    inner = ends[(ends > 0) & (ends < len(data))]      # a run does not cross texts
    first[inner] = word[1:-1][inner]
    last[inner - 1] = word[1:-1][inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(ends, starts, side="right")


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    if not len(values):
        return values, np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[at], np.diff(np.concatenate([at, [len(values)]]))
