"""Problem 10: repetition inside a document, and lines that many documents of one host share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.units import Units, mix64, run_hashes, unit_blocks
from sievewright.llm.arrow import column, map_batches, values

RUN = 5
MIN_WORDS = 20
MIN_SHARE = 0.30
LINE_DOCS = 20
DEPLETED_SHARE = 0.5
BROADCAST_ROWS = 1_000_000
SALTS = 16


def repeated_positions(units: Units, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By document: positions of k-runs, and those whose run occurred earlier in the document."""
    hashes, at = run_hashes(units, k)
    n = len(units.offsets) - 1
    doc = units.doc[at]
    positions = np.bincount(doc, minlength=n)
    keys = hashes ^ mix64(doc.astype(np.uint64) + np.uint64(1))
    first = np.unique(keys, return_index=True)[1]
    return positions, positions - np.bincount(doc[first], minlength=n)


def repetition_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = RUN) -> DataFrame:
    """(id, n_words, n_runs, repeated_runs, repeated_share, line_share) of every row, without a shuffle.

    repeated_share: of all k-run positions, those with a run that occurred earlier in the document.
    line_share: of the characters in lines that are not blank, those in repeats of an earlier line.
    Null, empty and shorter texts have 0 in all. Repeated rows stay repeated; other columns are dropped.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch):
        texts, ids = column(batch, text_col), values(batch, id_col)
        for low, high, units in unit_blocks(texts):
            runs, repeated = repeated_positions(units, k)
            lines = [line_share(t) for t in texts[low:high]]
            yield {id_col: ids.slice(low, high - low), "n_words": units.counts, "n_runs": runs, "repeated_runs": repeated, "repeated_share": repeated / np.maximum(runs, 1), "line_share": lines}

    return map_batches(df.select(id_col, text_col), kernel, f"`{id_col}` {kind}, n_words bigint, n_runs bigint, repeated_runs bigint, repeated_share double, line_share double")


def line_share(text: str | None) -> float:
    """Characters of repeated lines among those of all lines."""
    lines = [x for line in (text or "").splitlines() if (x := line.strip())]
    total = sum(map(len, lines))
    return (total - sum(map(len, set(lines)))) / total if total else 0.0


def repetitive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """Ids of rows with at least `min_words` units of which at least `min_share` of all run positions are repeats."""
    stats = repetition_stats(df, id_col, text_col)
    return stats.filter((F.col("n_words") >= min_words) & (F.col("repeated_runs") >= min_share * F.col("n_runs"))).select(id_col)


def host_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, line, n_chars): a hash of every normalised line that is not blank; a null host is the host ''."""
    line = F.trim(F.regexp_replace(F.regexp_replace(F.lower("part"), r"\p{Nd}+", "0"), r"[^\p{L}\p{N}]+", " "))
    parts = df.select(F.col(id_col), F.coalesce(F.lower(F.trim(F.col(host_col).cast("string"))), F.lit("")).alias("host"), F.explode(F.split(F.col(text_col), r"[\n\r]+")).alias("part"))
    return parts.select(id_col, "host", line.alias("line"), F.length("part").cast("bigint").alias("n_chars")).filter(F.col("line") != "").withColumn("line", F.xxhash64("line"))


def line_frequency(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = LINE_DOCS, depleted_share: float = DEPLETED_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Cross-document line frequency: (id, n_lines, n_chars, removed_lines, removed_chars, depleted) of every row.

    A line is removed if more than `max_docs` documents of its host have it; a document is depleted if more than
    `depleted_share` of its characters go. Counts are pre-aggregated, so a line that a third of all documents has
    moves once a task. The frequent lines are broadcast while they are at most `broadcast_rows`, counted first;
    beyond that both sides are salted. Rows without lines have zeros. Ids are taken as unique.
    """
    lines = host_lines(df, id_col, text_col, host_col)
    often = lines.select("host", "line", id_col).distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > max_docs)
    often = often.select("host", "line", F.lit(1).alias("often"))
    from sievewright.session import cut

    often = cut(often)
    if often.count() <= broadcast_rows:
        marked = lines.join(F.broadcast(often), ["host", "line"], "left")
    else:
        salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = lines.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"], "left")
    gone = F.col("often").isNotNull()
    per_doc = marked.groupBy(id_col).agg(
        F.count("*").alias("n_lines"),
        F.sum("n_chars").alias("n_chars"),
        F.count_if(gone).alias("removed_lines"),
        F.coalesce(F.sum(F.when(gone, F.col("n_chars"))), F.lit(0)).alias("removed_chars"),
    )
    out = df.select(id_col).join(per_doc, id_col, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_lines", "n_chars", "removed_lines", "removed_chars")}
    return out.withColumns(zero).withColumn("depleted", (F.col("removed_chars") > depleted_share * F.col("n_chars")))




def line_frequency_sql(view: str = "documents", max_docs: int = LINE_DOCS, depleted_share: float = DEPLETED_SHARE) -> str:
    """line_frequency over (doc_id, text, source) in DuckDB's SQL."""
    zero = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("n_lines", "n_chars", "removed_lines", "removed_chars"))
    return rf"""
WITH p AS (SELECT doc_id, coalesce(lower(trim(source)), '') AS host, unnest(regexp_split_to_array(text, '[\n\r]+')) AS part FROM {view}),
k AS (SELECT * FROM (SELECT doc_id, host, length(part) AS n, trim(regexp_replace(regexp_replace(lower(part), '\p{{Nd}}+', '0', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS line FROM p) WHERE line <> ''),
o AS (SELECT host, line, 1 AS often FROM k GROUP BY host, line HAVING count(DISTINCT doc_id) > {max_docs}),
d AS (SELECT doc_id, count(*) AS n_lines, sum(n) AS n_chars, count(often) AS removed_lines, sum(CASE WHEN often = 1 THEN n ELSE 0 END) AS removed_chars FROM k LEFT JOIN o USING (host, line) GROUP BY doc_id)
SELECT doc_id, {zero}, coalesce(removed_chars > {depleted_share} * n_chars, false) AS depleted FROM (SELECT doc_id FROM {view}) LEFT JOIN d USING (doc_id)"""
