"""Dedup units (NFKC, casefold, runs of letters and digits, CJK characters one by one) over whole batches.

A batch of texts is joined, normalised once, viewed as an array of code points and split, hashed and
combined into k-runs by array arithmetic; no Python object is made per word.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# The code points that count as CJK.
CJK_RANGES = (
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF),
    (0x3040, 0x30FF),
    (0xAC00, 0xD7AF),
)

OTHER, ALNUM, MARK, CJK = 0, 1, 2, 3
SEPARATOR = "￿"
BLOCK_CHARS = 1 << 19
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalnum():
            table[code] = ALNUM
        elif unicodedata.category(char)[0] == "M":
            table[code] = MARK
    for low, high in CJK_RANGES:
        table[low : high + 1] = CJK
    return table


@lru_cache(maxsize=1)
def _char_values() -> np.ndarray:
    return mix64(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * _PRIME)


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _PRIME), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass
class Units:
    """Units of a block of documents: hash, first and last+1 character, and document of each."""

    text: str
    points: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def words(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]


def _join(texts: Sequence[str | None]) -> str:
    return SEPARATOR.join(t.replace(SEPARATOR, " ") if t and SEPARATOR in t else t or "" for t in texts)


def split_units(texts: Sequence[str | None], normalise: bool = True) -> Units:
    text = _join(texts)
    if normalise:
        text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold()
    points = code_points(text)
    classes = char_classes()[points]
    cuts = np.flatnonzero(points == ord(SEPARATOR))
    firsts = np.concatenate(([0], cuts + 1))
    cjk = classes == CJK
    inside = classes == ALNUM
    marks = np.flatnonzero(classes == MARK)
    if len(marks):
        hit = np.zeros(len(firsts), dtype=bool)
        hit[np.searchsorted(firsts, np.flatnonzero(cjk), side="right") - 1] = True
        inside[marks] = hit[np.searchsorted(firsts, marks, side="right") - 1]
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    start = np.flatnonzero((inside & ~before) | cjk)
    end = np.flatnonzero((inside & ~after) | cjk) + 1
    up, down = _powers(max(10, int(len(points) + 1).bit_length()))
    running = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(_char_values()[points] * up[: len(points)], out=running[1:])
    hashes = mix64((running[end] - running[start]) * down[start])
    offsets = np.concatenate((np.searchsorted(start, firsts), [len(start)]))
    doc = np.repeat(np.arange(len(firsts), dtype=np.int64), np.diff(offsets))
    return Units(text, points, hashes, start, end, doc, offsets)


def unit_blocks(texts: Sequence[str | None], normalise: bool = True, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int, Units]]:
    """(first row, last row + 1, units) of blocks of about `block_chars` characters; a longer text has its own block."""
    low = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > low and size + n > block_chars:
            yield low, i, split_units(texts[low:i], normalise)
            low, size = i, 0
        size += n + 1
    if len(texts) > low:
        yield low, len(texts), split_units(texts[low:], normalise)


_MULTIPLIERS = mix64(np.arange(1, 65, dtype=np.uint64) * _PRIME) | np.uint64(1)


def run_hashes(units: Units, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k consecutive units inside one document, and the index of its first unit."""
    n = len(units.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(units.doc[:n] == units.doc[k - 1 :])
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += units.hashes[j : j + n] * _MULTIPLIERS[j % 64]
    return mix64(total[at] + np.uint64(k)), at


def sequence_hashes(units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's sequence of units, both 0 without units."""
    rank = np.arange(len(units.hashes)) - units.offsets[units.doc]
    salted = mix64(units.hashes + mix64(rank.astype(np.uint64) + np.uint64(1)))
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (salted, mix64(salted + np.uint64(77)))]
    first, last = units.offsets[:-1], units.offsets[1:]
    return sums[0][last] - sums[0][first], sums[1][last] - sums[1][first]


def distinct_by_document(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document one after another, and where each document's begin."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=n_docs))))


def shingle_sets(units: Units, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-unit shingles of each document; fewer units give one shingle, none no shingle."""
    hashes, at = run_hashes(units, n)
    doc = units.doc[at]
    counts = units.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        inside = np.flatnonzero((counts[units.doc] < n))
        rank = inside - units.offsets[units.doc[inside]]
        parts = units.hashes[inside] * _MULTIPLIERS[rank % 64]
        starts = np.flatnonzero(rank == 0)
        whole = mix64(np.add.reduceat(parts, starts) + counts[short].astype(np.uint64))
        hashes, doc = np.concatenate((hashes, whole)), np.concatenate((doc, short))
    return distinct_by_document(hashes, doc, len(counts))


# --- the same units one text at a time, for tests and for exact comparisons ---


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern[str], re.Pattern[str], re.Pattern[str]]:
    cjk = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES) + "]"
    marks = np.flatnonzero(char_classes() == MARK)
    groups = np.split(marks, np.flatnonzero(np.diff(marks) > 1) + 1)
    ranges = "".join(f"\\U{int(g[0]):08x}-\\U{int(g[-1]):08x}" for g in groups)
    return re.compile(cjk), re.compile(r"[^\W_]+"), re.compile(rf"(?:[^\W_]|[{ranges}])+")


def normalized_words(text: str | None) -> list[str]:
    """The units of one text, as strings."""
    if not text:
        return []
    cjk, plain, marked = _patterns()
    folded = unicodedata.normalize("NFKC", text).casefold()
    if cjk.search(folded) is None:
        return plain.findall(folded)
    return marked.findall(cjk.sub(r" \g<0> ", folded))
