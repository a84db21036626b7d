"""Exact and near duplicates of documents: minimum hashes, banded candidates, verified pairs, clusters."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions import text as tx
from sievewright.functions.units import mix64
from sievewright.operators.components import connected_components
from sievewright.operators.joins import bucket_pairs, met
from sievewright.operators.ordered import keep_first
from sievewright.session import cut


def _hash8(payload: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(payload, digest_size=8).digest(), "little")


@lru_cache(maxsize=8)
def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the n hash functions, from seeds 0 .. n - 1."""
    seeds = [i.to_bytes(4, "little") for i in range(n)]
    return np.array([_hash8(s + b"a") | 1 for s in seeds], np.uint64), np.array([_hash8(s + b"b") for s in seeds], np.uint64)


def signature(shingles: list[str], n: int) -> np.ndarray:
    """Least (h * a + b) mod 2^64 for each hash function; zeros without shingles."""
    a, b = coefficients(n)
    if not len(shingles):
        return np.zeros(n, np.uint64)
    h = np.array([_hash8(s.encode("utf-8")) for s in shingles], np.uint64)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(h, max(1, len(h) // 4096)):
        np.minimum(low, (part[:, None] * a + b).min(axis=0), out=low)
    return low


def signatures(flat: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) least values of many sets of 64-bit shingle hashes at once; zeros for empty sets."""
    a, b = coefficients(n)
    out = np.zeros((len(offsets) - 1, n), np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        for i in range(n):
            out[full, i] = np.minimum.reduceat(flat * a[i] + b[i], offsets[full])
    return out


def band_keys(n: int, bands: int):
    """Arrow UDF from arrays of shingle hashes to `bands` keys, each a hash of the band and its n / bands least values."""

    def sign(sets: pa.Array) -> pa.Array:
        sets = sets.fill_null([]) if sets.null_count else sets
        flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        offsets = np.asarray(sets.offsets.to_numpy(), dtype=np.int64)
        least = signatures(flat, offsets - offsets[0], n).reshape(len(sets), bands, n // bands)
        keys = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sets), bands))
        for i in range(n // bands):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, :, i])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(np.ascontiguousarray(keys).ravel().view(np.int64)))

    return F.arrow_udf(sign, T.ArrayType(T.LongType()))


def exact_dedup(df: DataFrame, text_col: str, profile_col: str, order: list[str]) -> DataFrame:
    """The first row in `order` of each canonical text. Null and empty texts are one text; order must be unique."""
    return keep_first(df, [tx.canonical_key(F.col(profile_col), F.col(text_col))], order)


def verified_pairs(pairs: DataFrame, shingled: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the materialised pairs whose shingle sets (ord, shingles), both not empty, are similar
    enough. Only the sets of rows that stand in a pair are shuffled."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("ord")).distinct())
    full = met(shingled.filter(F.size("shingles") > 0), ids, ["ord"], "ord", "left_semi")
    joined = pairs.join(full.select(F.col("ord").alias("a"), F.col("shingles").alias("sa")), "a").join(full.select(F.col("ord").alias("b"), F.col("shingles").alias("sb")), "b")
    return joined.select("a", "b", tx.jaccard(F.col("sa"), F.col("sb")).alias("similarity")).filter(F.col("similarity") >= threshold)


def set_copies(shingled: DataFrame) -> DataFrame:
    """(a, b): of each set that several rows (ord, shingles) have, its least row a with every other one b. Materialised.

    Sets are compared by 128 bits of hashes, counted with pre-aggregation.
    """
    named = shingled.select("ord", F.xxhash64("shingles").alias("w1"), F.xxhash64(F.lit(7), "shingles").alias("w2"))
    heads = cut(named.groupBy("w1", "w2").agg(F.min("ord").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    if heads.isEmpty():
        return heads.select("a", F.col("a").alias("b"))
    return cut(met(named, heads, ["w1", "w2"], "ord").filter("ord <> a").select("a", F.col("ord").alias("b")))


def near_duplicate_pairs(df: DataFrame, shingles: str, ord_col: str, threshold: float, num_hashes: int, num_bands: int) -> DataFrame:
    """(a, b), a < b: links between rows of similar enough shingle sets. Materialised.

    Rows of one set are a star around the least of them, which alone meets the other sets, so copies are not expanded.
    Two other rows are compared if their signatures agree in a whole band. ord must be unique; `df` is read several
    times, so it should be materialised, and equal sets must be in equal order, as shingle_hashes gives them.
    """
    if num_hashes % num_bands:
        raise ValueError("num_hashes must be a multiple of num_bands")
    sets = df.select(F.col(ord_col).alias("ord"), F.col(shingles).alias("shingles")).filter(F.size("shingles") > 0)
    copies = set_copies(sets)
    own = met(sets, copies.select(F.col("b").alias("ord")), ["ord"], "ord", "left_anti")
    keyed = cut(own.select("ord", band_keys(num_hashes, num_bands)("shingles").alias("keys")))
    pairs = cut(bucket_pairs(keyed.select("ord", F.explode("keys").alias("key")), "key", "ord"))
    return cut(verified_pairs(pairs, sets, threshold).select("a", "b").unionByName(copies))


def near_duplicates(df: DataFrame, shingles: str, ord_col: str, threshold: float, num_hashes: int, num_bands: int) -> DataFrame:
    """(ord, root, links) of rows with arrays of `shingles` hashes: rows of clusters of verified pairs with the least row of their cluster and their links.

    Rows of equal shingle sets are linked to the first of them, which stands for them. Null and empty sets are never
    linked. ord must be unique.
    """
    pairs = near_duplicate_pairs(df, shingles, ord_col, threshold, num_hashes, num_bands)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    return connected_components(pairs).join(ends, "node").select(F.col("node").alias(ord_col), "root", "links")


def near_dedup(df: DataFrame, shingles: str, ord_col: str, threshold: float = 0.9, num_hashes: int = 64, num_bands: int = 8) -> DataFrame:
    """Rows that are alone or the first of their cluster."""
    found = near_duplicates(df, shingles, ord_col, threshold, num_hashes, num_bands)
    return df.join(found.filter(F.col(ord_col) != F.col("root")).select(ord_col), ord_col, "left_anti")
