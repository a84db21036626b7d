"""Training documents too similar to evaluation texts, by an inverted index of shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators.joins import BROADCAST_ROWS, met
from sievewright.session import cut


def max_similarity(train: DataFrame, evaluation: DataFrame, id_col: str, eval_id: str, shingles: str, threshold: float | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, best): of every training row the greatest Jaccard similarity to an evaluation row, 0 if it shares nothing.

    Two texts without units are equal. With a threshold only pairs whose sizes can reach it are counted. The index of
    the evaluation side is counted and broadcast up to `rows` entries, so training shingles that no evaluation text has
    are dropped before any shuffle; a larger index is salted.
    """
    index = cut(evaluation.select(F.col(eval_id).alias("_e"), F.size(shingles).alias("_rs"), F.explode_outer(shingles).alias("_h")))
    left = train.select(id_col, F.size(shingles).alias("_ls"), F.explode(shingles).alias("_h"))
    met_rows = met(left, index.filter("_rs > 0"), ["_h"], id_col, rows=rows)
    if threshold:
        met_rows = met_rows.filter((F.col("_rs") >= F.ceil(threshold * F.col("_ls"))) & (F.col("_rs") <= F.floor(F.col("_ls") / threshold)))
    shared = met_rows.groupBy(id_col, "_e", "_ls", "_rs").agg(F.count("*").alias("_o"))
    best = shared.groupBy(id_col).agg(F.max(F.col("_o") / (F.col("_ls") + F.col("_rs") - F.col("_o"))).alias("best"))
    blank = index.filter("coalesce(_rs, 0) <= 0").limit(1).count() > 0
    empty = F.when(F.lit(blank) & (F.size(shingles) <= 0), F.lit(1.0))
    return train.select(id_col, empty.alias("_blank")).join(best, id_col, "left").select(id_col, F.coalesce("best", "_blank", F.lit(0.0)).alias("best"))


def decontaminate(train: DataFrame, evaluation: DataFrame, id_col: str = "doc_id", eval_id: str = "item_id", shingles: str = "shingles", threshold: float = 0.85) -> DataFrame:
    """Training rows without an evaluation row of at least `threshold` similarity.

    Without evaluation rows all stay; else a threshold of 0 drops all.
    """
    if evaluation.limit(1).count() == 0:
        return train
    if threshold <= 0:
        return train.limit(0)
    bad = max_similarity(train, evaluation, id_col, eval_id, shingles, threshold).filter(F.col("best") >= threshold)
    return train.join(bad.select(id_col), id_col, "left_anti")
