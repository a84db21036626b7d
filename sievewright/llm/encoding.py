"""Problem 8: ids of every text by a public byte-level BPE vocabulary.

Text is cut into pieces by the vocabulary's published pattern. Each distinct piece of a batch is merged
once: pieces lie in padded numpy matrices by length bucket, each round every row merges its leftmost pair
of minimum rank, found in a hashed pair table, and the rows are compacted. Results are kept per worker.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievewright.llm.arrow import column, list_column, map_batches, values

VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: the published pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_PIECE = 512
CACHE_PIECES = 400_000
ROWS_PER_MATRIX = 1 << 16
_NONE = np.int32(1 << 30)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id that their bytes have; the id is the rank."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, found = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 20) | right)
                    found.append(rank)
        self.bits = max(4, (2 * max(1, len(keys))).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        wanted, ranked = np.array(keys, dtype=np.int64), np.array(found, dtype=np.int32)
        slot = self._slot(wanted)
        while len(wanted):
            empty = self.keys[slot] == -1
            self.keys[slot[empty]] = wanted[empty]  # of several rows for a slot the last one stays
            placed = self.keys[slot] == wanted
            self.ranks[slot[placed]] = ranked[placed]
            wanted, ranked, slot = wanted[~placed], ranked[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.full(keys.shape, _NONE, dtype=np.int32)
        seen = self.keys[slot]
        hit = seen == keys
        out[hit] = self.ranks[slot[hit]]
        open_ = np.flatnonzero(~hit & (seen != -1) & (keys != -2))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.bytes_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge_matrix(self, rows: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces of similar length: one matrix, padded by -1, one merge in each row a round."""
        width = max(map(len, rows))
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.full((len(rows), width), -1, dtype=np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.bytes_ids[np.frombuffer(b"".join(rows), dtype=np.uint8)]
        out: list[tuple[int, ...]] = [()] * len(rows)
        live = np.arange(len(rows))
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(live):
            if ids.shape[1] > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(live)), at]
            else:
                at, best = np.zeros(len(live), np.int64), np.full(len(live), _NONE)
            done = best == _NONE
            if done.any():
                for row, cells in zip(live[done].tolist(), ids[done]):
                    out[row] = tuple(cells[cells >= 0].tolist())
                keep = ~done
                live, ids, ranks, at, best = live[keep], ids[keep], ranks[keep], at[keep], best[keep]
                if not len(live):
                    break
            n, here = len(live), np.arange(len(live))
            ids[here, at] = best
            right = np.arange(ids.shape[1] - 1) > at[:, None]  # the cells behind the merged pair move one to the left
            ids[:, :-1] = np.where(right, ids[:, 1:], ids[:, :-1])
            moved = np.full((n, ranks.shape[1]), _NONE, dtype=np.int32)
            moved[:, :-1] = ranks[:, 1:]
            ranks = np.where(np.arange(ranks.shape[1]) > at[:, None], moved, ranks)
            ids, ranks = ids[:, :-1], ranks[:, :-1]
            last = ids.shape[1] - 1
            if last >= 1:
                for pos in (at - 1, at):
                    ok = np.flatnonzero((pos >= 0) & (pos < last))
                    p = pos[ok]
                    ranks[ok, p] = self.pairs.get(ids[ok, p], ids[ok, p + 1])
        return out

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same result for one long piece in n log n: a heap of pairs over a linked list."""
        ids = [int(self.bytes_ids[b]) for b in piece]
        nxt, prev = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        token = [bytes([b]) for b in piece]
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] < len(ids):
                both = token[i] + token[nxt[i]]
                if (rank := self.ranks.get(both)) is not None:
                    heapq.heappush(heap, (rank, i, both))

        for i in range(len(ids)):
            offer(i)
        while heap:
            rank, i, both = heapq.heappop(heap)
            if not token[i] or nxt[i] >= len(ids) or token[i] + token[nxt[i]] != both:
                continue
            j = nxt[i]
            token[i], token[j], ids[i] = both, b"", rank
            nxt[i] = nxt[j]
            if nxt[i] < len(ids):
                prev[nxt[i]] = i
            offer(prev[i])
            offer(i)
        return tuple(x for x, t in zip(ids, token) if t)

    def learn(self, pieces: set[str]) -> None:
        """Merge the pieces that are not known yet."""
        if len(self.known) + len(pieces) > CACHE_PIECES:
            self.known.clear()
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            if piece in self.known:
                continue
            raw = piece.encode("utf-8", "replace")
            if len(raw) == 1:
                self.known[piece] = (int(self.bytes_ids[raw[0]]),)
            elif len(raw) > LONG_PIECE:
                self.known[piece] = self.merge_long(raw)
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, bucket in buckets.items():
            step = max(1, ROWS_PER_MATRIX >> bits)
            for low in range(0, len(bucket), step):
                part = bucket[low : low + step]
                for (piece, _), found in zip(part, self.merge_matrix([raw for _, raw in part])):
                    self.known[piece] = found

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin."""
        pieces = [self.split(t) if t else [] for t in texts]
        distinct = set()
        distinct.update(*pieces)
        self.learn(distinct)
        get = self.known.__getitem__
        parts = [list(chain.from_iterable(map(get, p))) for p in pieces]
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        flat = np.fromiter(chain.from_iterable(parts), np.int32, int(offsets[-1]))
        return flat, offsets


@lru_cache(maxsize=2)
def parsed(vocabulary: bytes) -> Encoder:
    """The encoder of the content of a vocabulary file; a worker makes it once."""
    return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())})


def load_encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return parsed(f.read())


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    return os.path.join(folder or VOCABULARY_DIR, f"{name}.tiktoken")


def _batches(texts: list[str | None], chars: int = 1 << 20):
    low = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > chars:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids) of every row. Null and empty texts give an empty list; strings of special tokens are plain text;
    repeated rows stay repeated; other columns are not carried on; an empty table gives an empty one."""
    return _encoded(df, id_col, text_col, path or vocabulary_path(), "ids array<int>", lambda flat, offsets: {"ids": list_column(flat, offsets, pa.int32())})


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns of `keep`, n_tokens bigint) of every row, 0 for null and empty texts."""
    return _encoded(df, id_col, text_col, path or vocabulary_path(), "n_tokens bigint", lambda flat, offsets: {"n_tokens": np.diff(offsets)}, keep)


def _encoded(df: DataFrame, id_col: str, text_col: str, path: str, result: str, shape: Callable, keep: tuple[str, ...] = ()) -> DataFrame:
    carried = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried)
    with open(path, "rb") as f:  # a fixed file of under a megabyte, which the workers get from the driver
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())

    def kernel(batch: pa.RecordBatch):
        texts = column(batch, text_col)
        encoder = parsed(vocabulary.value)
        for low, high in _batches(texts):
            flat, offsets = encoder.encode_batch(texts[low:high])
            yield {**{c: values(batch, c).slice(low, high - low) for c in carried}, **shape(flat, offsets)}

    return map_batches(df.select(*carried, text_col), kernel, f"{kinds}, {result}")
