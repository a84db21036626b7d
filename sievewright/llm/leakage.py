"""Problem 3: evaluation texts inside training texts, found by winnowed fingerprints and extended to whole runs.

A span of `run` units holds `run - k + 1` k-grams; of every window of so many k-grams the least hash is kept, so
each shared span of `run` units or more keeps at least one common fingerprint, at the same place on both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.units import Units, run_hashes, unit_blocks
from sievewright.llm.arrow import column, map_batches, signed, values
from sievewright.session import cut

RUN = 10
GRAM = 6
BROADCAST_ROWS = 1_000_000
SALTS = 16


def winnow(units: Units, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a block and the index of the first unit of each: the rightmost least k-gram of each window."""
    hashes, at = run_hashes(units, k)
    n = len(hashes) - window + 1
    if n <= 0:
        return hashes[:0], at[:0]
    best, where = hashes[:n].copy(), np.arange(n)
    for j in range(1, window):
        less = hashes[j : j + n] <= best
        best[less] = hashes[j : j + n][less]
        where[less] = np.flatnonzero(less) + j
    whole = units.doc[at[:n]] == units.doc[at[window - 1 :]]  # windows inside one document
    picked = np.unique(where[whole])
    return hashes[picked], at[picked]


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int = GRAM, run: int = RUN) -> DataFrame:
    """(id, fp, pos): winnowed fingerprints of every row; rows of fewer than `run` units have none."""
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch):
        texts, ids = column(batch, text_col), values(batch, id_col)
        for low, _, units in unit_blocks(texts):
            found, at = winnow(units, k, run - k + 1)
            doc = units.doc[at]
            yield {id_col: ids.take(pa.array(doc + low)), "fp": signed(found), "pos": (at - units.offsets[doc]).astype(np.int32)}

    return map_batches(df.select(id_col, text_col), kernel, f"`{id_col}` {kind}, fp bigint, pos int")


def runs(df: DataFrame, id_col: str, text_col: str, run: int = RUN) -> DataFrame:
    """(id, run): the hash of every run of `run` units."""
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch):
        texts, ids = column(batch, text_col), values(batch, id_col)
        for low, _, units in unit_blocks(texts):
            found, at = run_hashes(units, run)
            yield {id_col: ids.take(pa.array(units.doc[at] + low)), "run": signed(found)}

    return map_batches(df.select(id_col, text_col), kernel, f"`{id_col}` {kind}, run bigint")


def extended_runs(df: DataFrame, id_col: str, text_col: str, hits_col: str, k: int = GRAM, run: int = RUN) -> DataFrame:
    """(id, run): of rows with hit positions, the distinct runs that cover a hit."""
    kind = df.schema[id_col].dataType.simpleString()
    reach = run - k

    def kernel(batch: pa.RecordBatch):
        texts, ids, hits = column(batch, text_col), values(batch, id_col), column(batch, hits_col)
        for low, high, units in unit_blocks(texts):
            found, at = run_hashes(units, run)
            position = np.full(len(units.hashes) + 1, -1, dtype=np.int64)
            position[at] = np.arange(len(at))
            counts = [len(h) for h in hits[low:high]]
            hit = np.fromiter((p for h in hits[low:high] for p in h), np.int64, sum(counts))
            doc = np.repeat(np.arange(high - low), counts)
            first = units.offsets[doc]
            starts = (hit[:, None] - np.arange(reach + 1)).ravel()
            base = np.repeat(first, reach + 1)
            ok = starts >= 0
            index = position[np.minimum(base[ok] + starts[ok], len(units.hashes))]
            index = np.unique(index[index >= 0])
            yield {id_col: ids.take(pa.array(units.doc[at[index]] + low)), "run": signed(found[index])}

    return map_batches(df.select(id_col, text_col, hits_col), kernel, f"`{id_col}` {kind}, run bigint")


def bounded(df: DataFrame, keys: list[str], other: DataFrame, spread: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of `other` with the materialised `df`: broadcast up to `rows` rows, counted first, else salted by `spread`."""
    if df.count() <= rows:
        return other.join(F.broadcast(df), keys)
    salted = df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return other.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def own_runs(items: DataFrame, run: int = RUN) -> DataFrame:
    """(run, _item): the runs of rows (_item, _text) that one item alone has."""
    return runs(items, "_item", "_text", run).distinct().groupBy("run").agg(F.count("*").alias("n"), F.min("_item").alias("_item")).filter("n = 1").select("run", "_item")


def leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", k: int = GRAM, run: int = RUN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, item): rows that hold at least one run of `run` units that this item has and no other.

    Runs that several items share, such as a suite's instruction, are no evidence. Null, empty and shorter texts
    on either side match nothing; repeated rows give one result; extra columns are ignored; empty tables give an
    empty result. The items' fingerprints and runs are broadcast only up to `broadcast_rows`, counted first.
    """
    items = items.select(F.col(item_col).alias("_item"), F.col(text_col).alias("_text")).filter(F.col("_item").isNotNull())
    item_runs = cut(own_runs(items, run))
    item_fps = cut(fingerprints(items, "_item", "_text", k, run).select("fp").distinct())
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = bounded(item_fps, ["fp"], fingerprints(docs, "_id", "_text", k, run), "_id", broadcast_rows)
    hits = cut(found.groupBy("_id").agg(F.collect_set("pos").alias("_hits")))
    touched = bounded(hits, ["_id"], docs, "_id", broadcast_rows // 10)
    covered = extended_runs(touched, "_id", "_text", "_hits", k, run)
    return bounded(item_runs, ["run"], covered, "_id", broadcast_rows).select(F.col("_id").alias(id_col), F.col("_item").alias(item_col)).distinct()


def leak_report(found: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """One row: the documents to drop, the items that leaked, the pairs, and the items without a run of their own (short
    ones and those that only repeat others), which can never be reported as leaked."""
    rows = items.select(F.col(item_col).alias("_item"), F.col(text_col).alias("_text")).filter(F.col("_item").isNotNull())
    able = own_runs(rows, run).select("_item").distinct()
    blind = rows.select("_item").distinct().join(able, "_item", "left_anti").agg(F.count("*").alias("items_without_own_run"))
    return found.agg(F.count_distinct(id_col).alias("decontaminated_documents_dropped"), F.count_distinct(item_col).alias("leaked_items"), F.count("*").alias("pairs")).join(blind)
