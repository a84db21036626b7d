"""Problem 5: near copies by Golay-code fuzzy hashing.

Each text has tables of a 23-bit fingerprint segment and an anchor. A segment's bits are bits of least hashes of
its units, so copies with small edits differ in few of them. A segment is decoded to all Golay codewords within 4
bits, which gives one or six keys; two segments that differ in at most 2 bits always have a key in common, and by
the pigeonhole principle some of the tables hold few errors. The anchor, the least hashes of some runs, keeps
texts apart that only share their vocabulary. Texts with a common key are compared by sketches, then exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.golay import LENGTH, nearby_indices
from sievewright.functions.sketch import minima
from sievewright.functions.units import distinct_by_document, mix64, run_hashes, sequence_hashes, unit_blocks
from sievewright.llm.arrow import column, list_column, map_batches, signed, values
from sievewright.operators.components import connected_components
from sievewright.operators.joins import CELL_ROWS, bucket_pairs, met
from sievewright.session import cut


@dataclass(frozen=True)
class Settings:
    """k, threshold and min_words say what a pair is; the rest how candidates are found.

    tables: fingerprint segments. anchor_runs: units in an anchor's run; anchors: least hashes in an anchor.
    check_16, check_64: how many of 16 and 64 sketch cells must agree before the exact comparison; a pair at the
    threshold 0.6 falls short of either about twice in a thousand and less often than one in ten thousand times.
    """

    k: int = 3
    threshold: float = 0.6
    min_words: int = 20
    tables: int = 16
    anchor_runs: int = 4
    anchors: int = 2
    bins: int = 64
    check_16: int = 5
    check_64: int = 25
    seed: int = 20240


def _choices(s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    anchors = np.stack([rng.choice(s.bins, s.anchors, replace=False) for _ in range(s.tables)])
    bins = np.stack([rng.choice(s.bins, LENGTH, replace=False) for _ in range(s.tables)])
    shifts = rng.integers(0, 60, size=(s.tables, LENGTH)).astype(np.uint64)
    return anchors, bins, shifts


def _nibbles(cells: np.ndarray) -> np.ndarray:
    """(n, 16 m) sketch cells as (n, m) words of 16 cells of 4 bits."""
    parts = (cells >> np.uint64(20)) & np.uint64(15)
    parts = parts.reshape(len(cells), cells.shape[1] // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(parts, axis=2)


def _kind(df: DataFrame) -> str:
    return df.schema["_id"].dataType.simpleString()


def prints(df: DataFrame, s: Settings) -> DataFrame:
    """(id, h1, h2, check, anchors, words, s0..s3) of rows with enough units, from one reading of the texts.

    h1, h2 are equal for equal sequences of units; anchors and words have an anchor and a 23-bit segment for each
    table; check and s0..s3 have 16 and 64 cells of the run sketch.
    """
    anchors, bins, shifts = _choices(s)

    def kernel(batch: pa.RecordBatch):
        texts, ids = column(batch, "_text"), values(batch, "_id")
        for low, high, units in unit_blocks(texts):
            n = high - low
            keep = np.flatnonzero(units.counts >= s.min_words)
            h1, h2 = sequence_hashes(units)
            runs, at = run_hashes(units, s.anchor_runs)
            anchor = minima(runs, units.doc[at], n, s.bins, 2)[keep]
            least = minima(units.hashes, units.doc, n, s.bins, 1)[keep]
            grams, at = run_hashes(units, s.k)
            check = _nibbles(minima(grams, units.doc[at], n, 16, 3)[keep])[:, 0]
            marks = _nibbles(minima(grams, units.doc[at], n, 64, 4)[keep])
            hashed, words = np.empty((len(keep), s.tables), np.uint64), np.empty((len(keep), s.tables), np.int32)
            for t in range(s.tables):
                bits = (least[:, bins[t]] >> shifts[t]) & np.uint64(1)
                words[:, t] = (bits.astype(np.int64) << np.arange(LENGTH)).sum(axis=1)
                mixed = np.full(len(keep), t + 1, dtype=np.uint64)
                for b in anchors[t]:
                    mixed = mix64(mixed + anchor[:, b])
                hashed[:, t] = mixed
            offsets = np.arange(len(keep) + 1) * s.tables
            yield {
                "_id": ids.take(pa.array(keep + low)),
                "h1": signed(h1[keep]),
                "h2": signed(h2[keep]),
                "check": signed(check),
                "anchors": list_column(signed(hashed).ravel(), offsets, pa.int64()),
                "words": list_column(words.ravel(), offsets, pa.int32()),
                **{f"s{i}": signed(np.ascontiguousarray(marks[:, i])) for i in range(4)},
            }

    return map_batches(df, kernel, f"_id {_kind(df)}, h1 bigint, h2 bigint, check bigint, anchors array<bigint>, words array<int>, s0 bigint, s1 bigint, s2 bigint, s3 bigint")


def golay_keys(df: DataFrame) -> DataFrame:
    """(id, check, keys): of rows (id, check, anchor, word) the 64-bit keys of the anchor with each codeword near the segment."""

    def kernel(batch: pa.RecordBatch):
        words = values(batch, "word").to_numpy(zero_copy_only=False).astype(np.int64)
        anchor = values(batch, "anchor").to_numpy(zero_copy_only=False).view(np.uint64)
        index = nearby_indices(words)
        keys = mix64(anchor[:, None] * np.uint64(0x9E3779B97F4A7C15) + index.astype(np.uint64) + np.uint64(1))
        offsets = np.concatenate(([0], np.cumsum((index >= 0).sum(axis=1))))
        yield {"_id": values(batch, "_id"), "check": values(batch, "check"), "keys": list_column(signed(keys[index >= 0]), offsets, pa.int64())}

    return map_batches(df.select("_id", "check", "anchor", "word"), kernel, f"_id {_kind(df)}, check bigint, keys array<bigint>")


def run_sets(df: DataFrame, s: Settings) -> DataFrame:
    """(id, runs): the distinct k-runs of each row, as hashes."""

    def kernel(batch: pa.RecordBatch):
        texts, ids = column(batch, "_text"), values(batch, "_id")
        for low, high, units in unit_blocks(texts):
            grams, at = run_hashes(units, s.k)
            distinct, offsets = distinct_by_document(grams, units.doc[at], high - low)
            yield {"_id": ids.slice(low, high - low), "runs": list_column(signed(distinct), offsets, pa.int64())}

    return map_batches(df, kernel, f"_id {_kind(df)}, runs array<bigint>")


def equal_cells(a, b):
    """Of two words of 16 cells, how many agree."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(F.bitwise_not(x).bitwiseAND(F.lit(0x1111111111111111)))


def classes(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (id, rep, n), classes (rep, n)) of the classes of at least two rows with equal (h1, h2); rep is the least
    id. Classes are counted with pre-aggregation, so one of a third of all rows is no hot task. Both are materialised."""
    grouped = cut(hashed.groupBy("h1", "h2").agg(F.min("_id").alias("rep"), F.count("*").alias("n")).filter("n > 1"))
    members = cut(met(hashed.select("_id", "h1", "h2"), grouped, ["h1", "h2"], "_id").select("_id", "rep", "n"))
    return members, grouped.select("rep", "n")


def without_copies(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of `df` that are alone or the representative of their class."""
    return met(df, cut(members.filter("_id <> rep").select("_id").distinct()), ["_id"], "_id", "left_anti")


def candidates(own: DataFrame, s: Settings) -> DataFrame:
    """(a, b), a < b: distinct pairs of materialised prints with a common key whose sketches agree well enough.

    Anchors that one row alone has go no further, so only segments that can meet are decoded. Hot keys are cut into
    cells; every pair of a key is compared.
    """
    rows = own.select("_id", "check", F.inline(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("words").alias("word"))))
    shared = cut(rows.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    keyed = cut(golay_keys(met(rows, shared, ["anchor"], "_id")))
    close = lambda x, y: equal_cells(x["check"], y["check"]) >= s.check_16
    pairs = cut(bucket_pairs(keyed.select("_id", "check", F.explode("keys").alias("key")), "key", "_id", ("check",), close))
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    marks = met(own.select("_id", "s0", "s1", "s2", "s3"), ids, ["_id"], "_id", "left_semi")
    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("_id").alias(side), *[F.col(f"s{i}").alias(f"{side}{i}") for i in range(4)]), side)
    agree = sum((equal_cells(F.col(f"a{i}"), F.col(f"b{i}")) for i in range(4)), F.lit(0))
    return pairs.filter(agree >= s.check_64).select("a", "b")


def alike_sets(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Of the pairs (a, b) those of which the sets (id, runs) are similar: (a, b, similarity)."""
    both = pairs.join(sets.select(F.col("_id").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("_id").alias("b"), F.col("runs").alias("rb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ra", "rb")).alias("o"), (F.size("ra") + F.size("rb")).alias("t"))
    similarity = F.col("o") / (F.col("t") - F.col("o"))
    return both.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= s.threshold)


def verified(docs: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """Of the materialised `pairs` (a, b) those that are similar: (a, b, similarity). Only texts of a pair are read."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    return alike_sets(pairs, run_sets(met(docs, ids, ["_id"], "_id", "left_semi"), s), s)


def class_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs between class representatives, members of classes, classes): the whole result without expanding copies.

    pairs: (a, b, similarity) between different texts; members: (_id, rep, n) of texts that occur more than once;
    classes: (rep, n). Null, empty and short texts (fewer than min_words units) are in none; extra columns are ignored;
    of an id that occurs twice with the same text one row counts; empty tables give empty results.
    """
    s = settings or Settings()
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_id").isNotNull() & F.col("_text").isNotNull())
    marked = cut(prints(docs, s))
    members, grouped = classes(marked)
    own = without_copies(marked, members)
    return verified(docs, cut(candidates(own, s)), s), members, grouped


def grown(pairs: DataFrame, side: str, members: DataFrame, grouped: DataFrame) -> DataFrame:
    """Pairs with every member of the class of `side` in place of its representative. The members of a large class are
    cut into chunks that meet its pairs apart from each other."""
    chunks = F.ceil(F.col("n") / CELL_ROWS).cast("int")
    sized = met(pairs, grouped.withColumnRenamed("rep", side), [side], "b" if side == "a" else "a", "left")
    spread_out = sized.withColumn("_c", F.explode(F.sequence(F.lit(0), F.coalesce(chunks, F.lit(1)) - 1))).drop("n")
    parts = members.select(F.col("rep").alias(side), F.col("_id").alias("_m"), F.pmod(F.xxhash64("_id"), chunks).cast("int").alias("_c"))
    return spread_out.join(parts, [side, "_c"], "left").withColumn(side, F.coalesce("_m", side)).drop("_m", "_c")


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all alike pairs, copies expanded; class_pairs and groups give the same without this
    expansion. See class_pairs for edge cases."""
    pairs, members, grouped = class_pairs(df, id_col, text_col, settings)
    pairs = grown(grown(pairs.select("a", "b"), "a", members, grouped), "b", members, grouped)
    both = pairs.unionByName(bucket_pairs(members, "rep", "_id"))
    return both.select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b")).filter(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """(id, group, copies, links): one row for every row of a group: the least id of the group, how many rows have the
    same text, and how many other texts this text is alike to. Copies are members of their class, not pairs."""
    pairs, members, grouped = class_pairs(df, id_col, text_col, settings)
    pairs = cut(pairs.select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    loops = grouped.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    roots = connected_components(pairs.unionByName(loops)).select(F.col("node").alias("rep"), "root")
    grouped = roots.join(links, "rep", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    copies = members.select("rep", "_id", F.col("n").alias("copies"))
    joined = grouped.join(copies, "rep", "left")
    return joined.select(F.coalesce("_id", "rep").alias(id_col), F.col("root").alias("group"), F.coalesce("copies", F.lit(1)).alias("copies"), "links")
