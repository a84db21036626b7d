"""One-permutation minimum sketches of the sets of a block of documents."""

from __future__ import annotations

import numpy as np

from sievewright.functions.units import mix64

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def minima(hashes: np.ndarray, doc: np.ndarray, n_docs: int, bins: int, seed: int = 0) -> np.ndarray:
    """(n_docs, bins): the least rehash that falls in each bin; an empty bin takes the next filled one's, marked.

    Of two sets a bin agrees with the probability of their Jaccard similarity; documents without elements have TOP.
    """
    mixed = mix64(hashes + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    cell = doc * bins + (mixed >> np.uint64(48)).astype(np.int64) % bins
    out = np.full(n_docs * bins, TOP, dtype=np.uint64)
    np.minimum.at(out, cell, mix64(mixed))
    out = out.reshape(n_docs, bins)
    empty = out == TOP
    for _ in range(bins - 1):
        if not empty.any():
            break
        moved = np.roll(out, -1, axis=1)
        take = empty & (moved != TOP)
        if not take.any():
            break
        out[take] = moved[take] + np.uint64(0x632BE59BD9B4E019)
        empty = out == TOP
    return out
