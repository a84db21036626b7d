"""Joins whose sides may be small or large, and whose keys may be hot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.session import cut, rows_of

#: Rows up to which a counted side is broadcast; beyond that both sides are salted and shuffled.
BROADCAST_ROWS = 500_000
SALTS = 8
#: Rows of one key that meet in one cell; a key with more is cut into a grid of such cells.
CELL_ROWS = 4096


def met(df: DataFrame, other: DataFrame, keys: list[str], spread: str, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join of `df` with the materialised `other`, which is counted: broadcast up to `rows` rows, else the rows of `df` are
    salted by `spread` and those of `other` repeated for each salt, so a hot key of `df` is spread over SALTS tasks."""
    if rows_of(other) <= rows:
        return df.join(F.broadcast(other), keys, how)
    salted = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(F.lit(5), spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def bucket_pairs(rows: DataFrame, key: str, id_col: str, carry: tuple[str, ...] = (), accept: Callable[[dict[str, Column], dict[str, Column]], Column] | None = None, cell: int = CELL_ROWS) -> DataFrame:
    """(a, b), a < b, distinct: all pairs of different ids with a common key, those that `accept` refuses left out.

    Keys are counted first, pre-aggregated in each task; rows whose key nobody else has go no further. A key with more
    than `cell` rows is cut into chunks by a hash of the id, and each two chunks meet in a task of their own, so no task
    sees more than two chunks of a key and no pair is lost. `accept` gets the columns of `carry` of both rows.
    """
    shared = cut(rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1"))
    if rows_of(shared) == 0:
        return rows.select(F.col(id_col).alias("a"), F.col(id_col).alias("b")).limit(0)
    kept = met(rows, shared, [key], id_col)
    kept = kept.withColumn("_m", F.ceil(F.col("_n") / cell).cast("int")).withColumn("_c", F.pmod(F.xxhash64(F.lit(91), id_col), F.col("_m")).cast("int"))
    names = {c: (f"_l{k}", f"_r{k}") for k, c in enumerate(carry)}
    left = kept.select(key, F.col("_c").alias("_i"), F.explode(F.sequence("_c", F.col("_m") - 1)).alias("_j"), F.col(id_col).alias("a"), *[F.col(c).alias(x) for c, (x, _) in names.items()])
    right = kept.select(key, F.explode(F.sequence(F.lit(0), "_c")).alias("_i"), F.col("_c").alias("_j"), F.col(id_col).alias("b"), *[F.col(c).alias(y) for c, (_, y) in names.items()])
    once = F.when(F.col("_i") == F.col("_j"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    joined = left.join(right, [key, "_i", "_j"]).filter(once)
    if accept is not None:
        joined = joined.filter(accept({c: F.col(x) for c, (x, _) in names.items()}, {c: F.col(y) for c, (_, y) in names.items()}))
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
