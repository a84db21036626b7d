"""Problem 2: spans placed whole into windows of fixed capacity, with certified bin counts.

Items of one container set are hashed into partitions of bounded size; each is packed by best-fit decreasing and
compared with a lower bound from dual feasible functions. Partitions that meet their bound are final. Of the others
the windows that are not full are exchanged, whole windows by hash, and packed again, as long as that saves any; a
group keeps its old windows if packing again does not save any.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import cut

CAPACITY = 1024
ITEMS_PER_PARTITION = 20_000
BROADCAST_ROWS = 100_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item; sizes are integers from 1 to `capacity`. Open bins are kept by the room they have left."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n_bins = 0, 0  # bit r of mask: a bin has r left
    out = np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            chosen, left = n_bins, capacity
            n_bins += 1
        out[i] = chosen
        if left > size:
            room[left - size].append(chosen)
            mask |= 1 << (left - size)
    return out


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """Bins that any packing of count[x] items of each size x needs: the greatest bound of two families of dual feasible
    functions.

    rounding k: x -> x if (k + 1) x / capacity is whole, else floor((k + 1) x / capacity) * capacity / k;
    cutting e: items above capacity - e count as whole bins and items below e as nothing.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, (scaled // capacity) * capacity)  # k times the function
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    below, weight = np.cumsum(count), np.cumsum(count * x)
    e = np.arange(1, capacity // 2 + 1)
    whole = below[-1] - below[capacity - e]
    middle = weight[capacity - e] - weight[e - 1]
    return max(best, int((whole + -(-middle // capacity)).max()))


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity) if len(sizes) else 0


def set_bounds(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(set, least_windows): by set of items (set, size) the windows that any packing needs, from the counts of its at
    most `capacity` sizes."""

    def bound(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(capacity + 1, dtype=np.int64)
        count[pdf["size"].to_numpy()] = pdf["n"].to_numpy()
        return pd.DataFrame({"set": [key[0]], "least_windows": [bound_of_counts(count, capacity)]})

    return items.groupBy("set", "size").agg(F.count("*").alias("n")).groupBy("set").applyInPandas(bound, "set string, least_windows bigint")


def clean_spans(df: DataFrame) -> DataFrame:
    """(span_id, cache_name, span_start, span_end, length, status): of redelivered rows the latest by loaded_at.

    Swapped ends are put in order. status: ok, empty, or null_end for spans that cannot be placed.
    """
    last = df.filter(F.col("span_id").isNotNull()).groupBy("span_id").agg(F.max(F.struct("loaded_at", "cache_name", "span_start", "span_end")).alias("r")).select("span_id", "r.cache_name", "r.span_start", "r.span_end")
    start, end = F.least("span_start", "span_end"), F.greatest("span_start", "span_end")
    known = F.col("span_start").isNotNull() & F.col("span_end").isNotNull()
    status = F.when(~known, "null_end").when(F.col("span_start") == F.col("span_end"), "empty").otherwise("ok")
    last = last.withColumn("status", status)
    return last.select("span_id", F.coalesce("cache_name", F.lit("")).alias("cache_name"), F.when(known, start).otherwise(F.col("span_start")).cast("bigint").alias("span_start"), F.when(known, end).otherwise(F.col("span_end")).cast("bigint").alias("span_end"), F.when(known, end - start).cast("bigint").alias("length"), "status")


def pieces(spans: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(set, span_id, piece, offset, size): spans longer than the capacity are cut into full pieces and a rest."""
    n = F.ceil(F.col("length") / capacity).cast("int")
    cutting = spans.filter("status = 'ok'").withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    offset = F.col("piece").cast("bigint") * capacity
    return cutting.select(F.col("cache_name").alias("set"), "span_id", "piece", offset.alias("offset"), F.least(F.col("length") - offset, F.lit(capacity)).cast("int").alias("size"))


PACKED = "set string, span_id bigint, piece int, offset bigint, size int, window string, fill int, certified boolean, saved int"


def _packer(capacity: int, round_no: int):
    def pack(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["size"].to_numpy().astype(np.int64)
        order = np.lexsort((pdf["piece"].to_numpy(), pdf["span_id"].to_numpy()))
        pdf, sizes = pdf.iloc[order], sizes[order]
        bins = best_fit_decreasing(sizes, capacity)
        used, bound, before = int(bins.max()) + 1, lower_bound(sizes, capacity), pdf["window"].nunique() if round_no else 0
        if round_no and used >= before:
            out = pdf[["set", "span_id", "piece", "offset", "size", "window", "fill"]].copy()
            out["certified"] = before == bound
            out["saved"] = 0
            return out
        out = pdf[["set", "span_id", "piece", "offset", "size"]].copy()
        out["window"] = [f"{round_no}-{int(key[1])}-{b}" for b in bins.tolist()]
        out["fill"] = np.bincount(bins, weights=sizes).astype(np.int32)[bins]
        out["certified"] = used == bound
        out["saved"] = 0
        out.loc[out.index[:1], "saved"] = max(0, before - used)
        return out

    return pack


def _bucketed(items: DataFrame, spread: list[str], per_partition: int) -> DataFrame:
    """Adds `bucket`: by set a hash of `spread` into as many buckets as its items need."""
    sizes = items.groupBy("set").agg(F.ceil(F.count("*") / per_partition).cast("int").alias("n_buckets"))
    sizes = cut(sizes)
    return items.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "set").withColumn("bucket", F.pmod(F.xxhash64(*spread), F.col("n_buckets")).cast("int")).drop("n_buckets")


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """(set, span_id, piece, offset, size, window, fill, certified) of every item (set, span_id, piece, offset, size).

    Rounds go on while some partition saves a window, and end at once when all are certified; each saves at least one,
    so they end. certified: the item's partition has as few windows as the lower bound allows.
    """
    done, open_, r = None, _bucketed(items, ["span_id", "piece"], per_partition), 0
    while True:
        packed = cut(open_.groupBy("set", "bucket").applyInPandas(_packer(capacity, r), PACKED))
        loose = ~F.col("certified") & (F.col("fill") < capacity)
        left = packed.agg(F.count_if(loose).alias("loose"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")).first()
        end = left["loose"] == 0 or (r > 0 and left["saved"] == 0)
        final = (packed if end else packed.filter(~loose)).drop("saved")
        done = final if done is None else done.unionByName(final)
        if end:
            return done
        open_, r = _bucketed(packed.filter(loose).drop("certified", "saved"), ["window", F.lit(r)], per_partition), r + 1


def packed_spans(df: DataFrame, capacity: int = CAPACITY, per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """(span_id, cache_name, piece, piece_start, piece_end, window_id, window_fill, certified, status): every piece of every span.

    Each cache is packed for itself. No span of at most `capacity` tokens is cut. Spans with a null end and empty
    spans have one row without a window. Extra columns are ignored; an empty table gives an empty one.
    """
    spans = cut(clean_spans(df))
    placed = pack(pieces(spans, capacity), capacity, per_partition)
    rows = placed.join(spans.filter("status = 'ok'").select("span_id", "span_start"), "span_id").select(
        "span_id", F.col("set").alias("cache_name"), "piece", (F.col("span_start") + F.col("offset")).alias("piece_start"), (F.col("span_start") + F.col("offset") + F.col("size")).alias("piece_end"), F.col("window").alias("window_id"), F.col("fill").alias("window_fill"), "certified", F.lit("ok").alias("status")
    )
    rest = spans.filter("status <> 'ok'").select("span_id", "cache_name", F.lit(0).alias("piece"), F.col("span_start").alias("piece_start"), F.col("span_end").alias("piece_end"), F.lit(None).cast("string").alias("window_id"), F.lit(None).cast("int").alias("window_fill"), F.lit(None).cast("boolean").alias("certified"), "status")
    return rows.unionByName(rest)


def window_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(cache_name, windows, tokens, fill_share, full_windows, least_windows): by cache how full its windows are.

    least_windows: the bound of dual feasible functions over the whole cache, which no packing can undercut.
    """
    placed = packed.filter(F.col("window_id").isNotNull())
    bounds = set_bounds(placed.select(F.col("cache_name").alias("set"), (F.col("piece_end") - F.col("piece_start")).cast("int").alias("size")), capacity)
    windows = placed.groupBy("cache_name", "window_id").agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("fill"))
    found = windows.groupBy("cache_name").agg(F.count("*").alias("windows"), F.sum("fill").alias("tokens"), (F.sum("fill") / (F.count("*") * capacity)).alias("fill_share"), F.count_if(F.col("fill") == capacity).alias("full_windows"))
    return found.join(bounds.withColumnRenamed("set", "cache_name"), "cache_name")
