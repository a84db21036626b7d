"""Problem 7: records of one split that occur again in another, by a partitioned sparse suffix array.

Suffixes start at the rarest `k`-runs of each record, so many of them that two records at the threshold have at least
`COMMON` starts in common; no such pair is left out. They are partitioned by their first `k` units and sorted in each
partition; suffixes of both splits in one interval meet, with bounds from their places. The pairs with enough starts are
extended over their whole texts: the spans of `depth` units or more that both hold are merged into the coverage of the
evaluation record, and the run sets are compared exactly. How often a run occurs is read from a table of counted cells
over all records; it decides which starts are kept, never whether a pair is found.

Texts are read three times and not shuffled but for ids that occur twice and for the pairs met; suffixes travel in
compressed blocks, and meetings only of records whose marks leave room for the threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.units import distinct_by_document, mix64, run_hashes, unit_blocks
from sievewright.llm.arrow import column, map_batches, values
from sievewright.llm.nearcopies import Settings, classes, grown, without_copies
from sievewright.operators.joins import CELL_ROWS, met
from sievewright.session import cut

#: Shared starts asked for before a pair is compared; any number from 1 on gives the same result.
COMMON = 4
#: Bits of a cell's number at most; two cells for a run up to that. More runs a cell cost time, never pairs.
MAX_BITS = 26
CHUNK_BITS = 16
#: Runs of one partition of suffixes, pairs expanded at once, and entries gathered before they are counted.
PART_RUNS, MEETINGS, GATHERED = 2_000_000, 1 << 21, 1 << 22
#: Words of 64 bits of a record's marks at most; records of up to 90 runs have 2, of up to 200 runs 4. More refuse more pairs early.
MARK_WORDS, MARK_RUNS = 8, ((90, 2), (200, 4))


@dataclass(frozen=True)
class SuffixSettings:
    """depth says which spans count as covered."""

    depth: int = 12


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers of one length, byte by byte, so that high bytes take no room."""
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T) for c in columns]
    return zlib.compress(b"".join(x.tobytes() for x in planes), 1)


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(x.T).view("<u8").ravel() for x in planes]


def mark_words(n: np.ndarray) -> np.ndarray:
    """Words of the marks of records with n runs."""
    words = np.full(len(n), MARK_WORDS, np.int64)
    for most, fewer in reversed(MARK_RUNS):
        words[n <= most] = fewer
    return words


def run_marks(runs: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By record, the bits that an odd number of its distinct runs falls on, in mark_words(n) words; the others are 0."""
    odd = np.zeros((len(n), 64 * MARK_WORDS), np.uint8)
    np.bitwise_xor.at(odd.ravel(), doc * odd.shape[1] + (mix64(runs) & np.uint64(odd.shape[1] - 1)).astype(np.int64), 1)
    marks = np.packbits(odd, axis=1, bitorder="little").view("<u8")
    words = mark_words(n)
    for few in sorted({w for _, w in MARK_RUNS}):
        marks[words == few, :few] = folded(marks[words == few], few)
        marks[words == few, few:] = 0
    return marks


def folded(marks: np.ndarray, words: int) -> np.ndarray:
    """Marks as if they had been made with so many words; those with fewer stay."""
    return np.bitwise_xor.reduce(marks.reshape(len(marks), marks.shape[1] // words, words), axis=1)


def marks_apart(marks0: np.ndarray, words0: np.ndarray, marks1: np.ndarray, words1: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the marks of the records i and j differ, in the words that both have: no more than in runs."""
    apart = np.zeros(len(i), np.int64)
    words = np.minimum(words0[i], words1[j])
    for few in np.unique(words).tolist():
        at = np.flatnonzero(words == few)
        left, right = folded(marks0, few), folded(marks1, few)
        for w in range(few):
            apart[at] += np.bitwise_count(left[i[at], w] ^ right[j[at], w])
    return apart


def run_weights(docs: DataFrame, s: Settings, bits: int) -> dict[int, bytes]:
    """By cell, the first `bits` bits of a run, in compressed chunks: 0 if the runs in it occur on one side only, else 1 + the bits of the mean of
    how often they occur on both. Counted over all records; each task sends its distinct cells once."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
            cells, n = (np.concatenate(x) for x in zip(*parts))
            distinct, where = np.unique(cells, return_inverse=True)
            return [(distinct, np.bincount(where, weights=n, minlength=len(distinct)).astype(np.uint64))]

        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for batch in batches:
            texts, side = column(batch, "_text"), values(batch, "side").to_numpy(zero_copy_only=False)
            for low, _, units in unit_blocks(texts):
                grams, at = run_hashes(units, s.k)
                doc = units.doc[at]
                cells = ((grams >> np.uint64(64 - bits)) << np.uint64(1)) | side[low + doc].astype(np.uint64)
                cells, n = np.unique(cells[units.counts[doc] >= s.min_words], return_counts=True)
                parts.append((cells, n.astype(np.uint64)))
            if sum(len(x) for x, _ in parts[1:]) > GATHERED + len(parts[0][0]):
                parts = counted(parts)
        cells, n = counted(parts)[0]
        chunk = (cells >> np.uint64(CHUNK_BITS + 1)).astype(np.int32)
        starts = np.flatnonzero(np.diff(chunk, prepend=-1))
        blobs = [packed(np.diff(cells[a:b], prepend=cells[a] >> np.uint64(CHUNK_BITS + 1) << np.uint64(CHUNK_BITS + 1)), n[a:b]) for a, b in zip(starts, [*starts[1:], len(cells)])]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[starts], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "cells"])

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(column(batch, "chunk"), column(batch, "cells")):
                steps, n = unpacked(blob, 2)
                total = sums.setdefault(chunk, np.zeros(2 << CHUNK_BITS))
                total[np.cumsum(steps)] += n
        for chunk, total in sums.items():
            both = np.sqrt(total[0::2] * total[1::2])
            kinds = np.where(both > 0, 1 + np.ceil(np.log2(np.maximum(both, 1))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(kinds.tobytes(), 1)], pa.binary())], ["chunk", "kinds"])

    found = docs.select("side", "_text").mapInArrow(counts, "chunk int, cells binary").repartition("chunk").mapInArrow(weights, "chunk int, kinds binary")
    return {row.chunk: bytes(row.kinds) for row in found.collect()}  # less than a byte a cell, MAX_BITS at most


def suffixes(docs: DataFrame, s: Settings, bits: int, parts: int) -> DataFrame:
    """(part, side, suffixes): the sampled suffixes of records (id, record, side, text), by a range of their first units.

    The distinct runs of a record are ordered by their weight, then by the run. Two sets at the threshold t share at
    least t times the runs of either, so the first l runs they share lie among the first n - ceil(t n) + l of both, and
    the places of these bound how many more they can share. Runs that occur on one side only come first and are counted,
    not sent. A start whose cell is frequent on both sides goes to a row or column of a grid, and meets each record of
    the other side in one of its fields. A block has the sorted keys, how many runs from each on could be shared, and once
    for each of its records how many runs it has and which bits an odd number of them falls on (run_marks). Two sets
    differ in at least as many runs as these bits differ in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(run_weights(docs, s, bits))
    common, cell_rows, threshold, chunk = COMMON, CELL_ROWS, s.threshold, 1 << CHUNK_BITS
    tables: list[np.ndarray] = []

    def kernel(batch: pa.RecordBatch):
        if not tables:
            tables.append(np.zeros(max(1 << bits, chunk), np.uint8))
            for i, found in shared.value.items():
                tables[0][i * chunk : (i + 1) * chunk] = np.frombuffer(zlib.decompress(found), np.uint8)
        texts = column(batch, "_text")
        records, side = (values(batch, c).to_numpy(zero_copy_only=False) for c in ("record", "side"))
        kept: list[list[np.ndarray]] = []
        for low, high, units in unit_blocks(texts):
            runs, at = run_hashes(units, s.k)
            doc = units.doc[at]
            enough = units.counts[doc] >= s.min_words
            runs, doc = runs[enough], doc[enough]
            kinds = tables[0][runs >> np.uint64(64 - bits)]
            order = np.lexsort((runs, kinds, doc))
            runs, doc, kinds = runs[order], doc[order], kinds[order]
            new = np.ones(len(runs), dtype=bool)
            new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
            runs, doc, kinds = runs[new], doc[new], kinds[new]
            n = np.bincount(doc, minlength=high - low)
            marks = run_marks(runs, doc, n)
            place = np.arange(len(runs)) - (np.cumsum(n) - n)[doc]
            least = np.ceil(n * threshold - 1e-9).astype(np.int64)  # less a little, as 0.6 * n may be rounded up past its integer
            keep = (kinds > 0) & (place < (n - least + common)[doc])
            runs, doc, kinds, place = runs[keep], doc[keep], kinds[keep], place[keep]
            kept.append([runs, kinds, records[low + doc].astype(np.uint64), side[low + doc], n[doc], n[doc] - place, marks[doc]])
        if not kept:
            return
        runs, kinds, record, side, n, rest, marks = (np.concatenate(x) for x in zip(*kept))
        grid = np.maximum(1, -(-(1 << np.maximum(kinds.astype(np.int64) - 1, 0)) // cell_rows))
        own = (mix64(record + np.uint64(91)) % grid.astype(np.uint64)).astype(np.int64)
        each = np.repeat(np.arange(len(runs)), grid)
        other = np.arange(len(each)) - np.repeat(np.cumsum(grid) - grid, grid)
        field = np.where(side[each] == 0, own[each] * grid[each] + other, other * grid[each] + own[each])
        keys = mix64(runs[each] + field.astype(np.uint64)) >> np.uint64(24)
        part = ((keys * np.uint64(parts)) >> np.uint64(40)).astype(np.int64)
        order = np.lexsort((keys, side[each], part))
        each, keys, part = each[order], keys[order], part[order]
        group = part * 2 + side[each]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        blobs = []
        for a, b in zip(starts, [*starts[1:], len(each)]):
            _, once, which = np.unique(record[e := each[a:b]], return_index=True, return_inverse=True)
            own = e[once]
            parted = packed(np.diff(keys[a:b], prepend=np.uint64(0)), which, rest[e]), packed(record[own], n[own], *marks[own].T)
            blobs.append(len(parted[0]).to_bytes(4, "little") + parted[0] + parted[1])
        yield {"part": part[starts].astype(np.int32), "side": (group[starts] % 2).astype(np.int32), "suffixes": pa.array(blobs, pa.binary())}

    return map_batches(docs.select("record", "side", "_text"), kernel, "part int, side int, suffixes binary")


def meetings(found: DataFrame, s: Settings, parts: int) -> DataFrame:
    """(r0, r1): the records of side 0 and 1 whose suffixes meet in as many intervals as a pair at the threshold does."""
    common, threshold = COMMON, s.threshold

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: tuple[list, list] = ([], [])
        named: tuple[list, list] = ([], [])
        seen = [0, 0]
        for batch in batches:
            for side, blob in zip(column(batch, "side"), column(batch, "suffixes")):
                size = 4 + int.from_bytes(blob[:4], "little")
                step, which, rest = unpacked(blob[4:size], 3)
                named[side].append(unpacked(blob[size:], 2 + MARK_WORDS))
                blocks[side].append((np.cumsum(step), which.astype(np.int64) + seen[side], rest.astype(np.int32)))
                seen[side] += len(named[side][-1][0])
        if not all(blocks):
            return
        (k0, w0, rest0), (k1, w1, rest1) = (tuple(np.concatenate(x) for x in zip(*b)) for b in blocks)
        (r0, n0, *marks0), (r1, n1, *marks1) = (tuple(np.concatenate(x) for x in zip(*b)) for b in named)
        marks0, marks1 = np.stack(marks0, axis=1), np.stack(marks1, axis=1)
        r0, r1, n0, n1 = (x.astype(np.int64) for x in (r0, r1, n0, n1))
        words0, words1 = mark_words(n0), mark_words(n1)
        order = np.argsort(k0, kind="stable")
        k0, w0, rest0 = k0[order], w0[order], rest0[order]
        order = np.argsort(k1, kind="stable")
        k1, w1, rest1 = k1[order], w1[order], rest1[order]
        first, size = np.searchsorted(k0, k1), np.searchsorted(k0, k1, side="right")
        size -= first
        ends = np.cumsum(size)
        for low in range(0, int(ends[-1]), MEETINGS):  # the pairs of all intervals in order, so many at a time
            pair = np.arange(low, min(low + MEETINGS, int(ends[-1])))
            j = np.searchsorted(ends, pair, side="right")
            i = first[j] + pair - (ends[j] - size[j])
            rest, i, j = np.minimum(rest0[i], rest1[j]), w0[i], w1[j]
            total = n0[i] + n1[j]
            enough = (rest + (common - 1)) * (1 + threshold) >= threshold * total - 1e-9
            i, j, total = i[enough], j[enough], total[enough]
            apart = marks_apart(marks0, words0, marks1, words1, i, j)
            enough = (total - apart) * (1 + threshold) >= 2 * threshold * total - 1e-9  # at most half of the rest is common
            i, j = i[enough], j[enough]
            order = np.lexsort((r1[j], r0[i]))
            i, j = i[order], j[order]
            a, b = r0[i], r1[j]
            new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate((new, [len(a)])))
            least = np.ceil(np.minimum(n0[i[new]], n1[j[new]]) * threshold - 1e-9)
            columns = [pa.array(a[new]), pa.array(b[new]), pa.array(n.astype(np.int32)), pa.array(np.minimum(common, least).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["r0", "r1", "n", "least"])

    hits = found.repartition(parts, "part").mapInArrow(kernel, "r0 bigint, r1 bigint, n int, least int")
    return hits.groupBy("r0", "r1").agg(F.sum("n").alias("n"), F.min("least").alias("least")).filter("n >= least").select("r0", "r1")


def extended(pairs: DataFrame, s: Settings, x: SuffixSettings) -> DataFrame:
    """Of the pairs (a, b, ta, tb) with their texts those that are similar: (a, b, similarity, covered)."""
    kind = pairs.schema["a"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch):
        sides = [column(batch, c) for c in ("ta", "tb")]
        texts = list(dict.fromkeys(t for side in sides for t in side))
        parts = {}
        for low, high, units in unit_blocks(texts):
            grams, at = run_hashes(units, s.k)
            runs, offsets = distinct_by_document(grams, units.doc[at], high - low)
            deep, at = run_hashes(units, x.depth)
            bounds = np.searchsorted(units.doc[at], np.arange(high - low + 1))
            for i in range(high - low):
                parts[texts[low + i]] = runs[offsets[i] : offsets[i + 1]], deep[bounds[i] : bounds[i + 1]]
        keep, similarity, covered = [], [], []
        for row, (ta, tb) in enumerate(zip(*sides)):
            (ra, da), (rb, db) = parts[ta], parts[tb]
            both = len(np.intersect1d(ra, rb, assume_unique=True))
            if not both or (alike := both / (len(ra) + len(rb) - both)) < s.threshold:
                continue
            starts = np.flatnonzero(np.isin(db, da))  # suffixes of b in an interval with one of a
            keep.append(row)
            similarity.append(alike)
            covered.append(int(np.minimum(np.diff(starts, append=len(db) + x.depth), x.depth).sum()))
        yield {"a": values(batch, "a").take(pa.array(keep, pa.int64())), "b": values(batch, "b").take(pa.array(keep, pa.int64())), "similarity": similarity, "covered": covered}

    return map_batches(pairs.select("a", "b", "ta", "tb"), kernel, f"a {kind}, b {kind}, similarity double, covered int")


def side_of(id_col: str):
    """0 for train, 1 for validation and test, by the prefix of the id; null for others."""
    prefix = F.substring_index(F.col(id_col), "-", 1)
    return F.when(prefix == "train", 0).when(prefix.isin("validation", "test"), 1).cast("int")


def latest(rows: DataFrame) -> DataFrame:
    """(id, text, side) of the latest row of each id, then the greatest text. Only texts of ids that occur twice move."""
    twice = cut(rows.groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").select("_id"))
    last = met(rows, twice, ["_id"], "_id", "left_semi").groupBy("_id").agg(F.max(F.struct("_order", "_text")).alias("last"), F.first("side").alias("side"))
    once = met(rows, twice, ["_id"], "_id", "left_anti").select("_id", "_text", "side")
    return once.unionByName(last.select("_id", F.col("last._text").alias("_text"), "side")).filter(F.col("_text").isNotNull())


def cross_split(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = "loaded_at", settings: Settings | None = None, suffix_settings: SuffixSettings | None = None) -> tuple[DataFrame, dict[str, tuple[DataFrame, DataFrame]]]:
    """(pairs of representatives (a, b, similarity, covered), by side "a" and "b" the members and classes of equal texts).

    The split is the prefix of the id; of rows with one id the latest by `order_col` counts (then the greatest
    text). Null, empty and short texts have no overlaps; equal texts of a side are compared once and are members of
    one class; extra columns are ignored; empty tables give empty results. covered counts the units of b under spans of
    `depth` units or more that it shares with a.
    """
    s, x = settings or Settings(), suffix_settings or SuffixSettings()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *([F.col(order_col).alias("_order")] if order_col else [F.lit(0).alias("_order")]))
    rows = rows.withColumn("side", side_of("_id")).filter(F.col("side").isNotNull())
    docs = latest(rows)
    hashed = docs.select("_id", "side", F.xxhash64(F.lit(1), "_text").alias("h1"), F.xxhash64(F.lit(2), "_text").alias("h2"))
    sides = {name: classes(hashed.filter(F.col("side") == i)) for i, name in enumerate("ab")}
    # records go by 40 bits of a hash of their id; two ids with one hash only give pairs that are compared in vain
    own = without_copies(docs, sides["a"][0].unionByName(sides["b"][0])).withColumn("record", F.shiftrightunsigned(F.xxhash64("_id"), 24))
    runs = (rows.agg(F.sum(F.length("_text"))).first()[0] or 0) // 6
    bits = min(MAX_BITS, max(CHUNK_BITS, (2 * runs).bit_length()))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), runs // PART_RUNS)
    pairs = cut(meetings(suffixes(own, s, bits, parts), s, parts))
    used = cut(pairs.select(F.explode(F.array("r0", "r1")).alias("record")).distinct())
    texts = met(own, used, ["record"], "_id", "left_semi")
    for i, name in enumerate("ab"):
        pairs = pairs.join(texts.filter(F.col("side") == i).select(F.col("record").alias(f"r{i}"), F.col("_id").alias(name), F.col("_text").alias(f"t{name}")), f"r{i}")
    return cut(extended(pairs, s, x)), sides


def overlaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = "loaded_at", settings: Settings | None = None, suffix_settings: SuffixSettings | None = None) -> DataFrame:
    """(train, held, similarity): all cross-split pairs, copies expanded. See cross_split for edge cases."""
    pairs, sides = cross_split(df, id_col, text_col, order_col, settings, suffix_settings)
    for side, (members, grouped) in sides.items():
        pairs = grown(pairs, side, members, grouped)
    return pairs.select(F.col("a").alias("train"), F.col("b").alias("held"), "similarity").distinct()


def overlap_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", order_col: str | None = "loaded_at") -> DataFrame:
    """(split, source, records, overlapping, exact): by held-out split and source, how many records occur in train.

    A null source is reported as null; the source of an id is that of its latest row. Copies of a held-out record are
    counted through its class; no pairs of them are made.
    """
    pairs, sides = cross_split(df, id_col, text_col, order_col)
    flags = pairs.groupBy("b").agg(F.max(F.col("similarity") >= 1.0).alias("exact"))
    flags = grown(flags.withColumn("a", F.col("b")), "b", *sides["b"]).select(F.col("b").alias("_id"), "exact")
    rows = df.select(F.col(id_col).alias("_id"), F.struct(F.col(order_col) if order_col else F.lit(0), F.col(source_col).alias("source")).alias("o"))
    rows = rows.filter(side_of("_id") == 1).groupBy("_id").agg(F.max("o").alias("o"))
    joined = rows.select("_id", F.substring_index("_id", "-", 1).alias("split"), F.col("o.source").alias("source")).join(flags, "_id", "left")
    return joined.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("exact").alias("overlapping"), F.count_if(F.col("exact")).alias("exact"))
