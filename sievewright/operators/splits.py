"""Deterministic splits and samples by hashed order keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text as tx
from sievewright.operators.joins import met
from sievewright.operators.ordered import global_rank, keep_first
from sievewright.session import cut


def half_even(n: int, fraction: float) -> int:
    return round(n * fraction)


def hold_out(df: DataFrame, id_col: str, fraction: float) -> DataFrame:
    """Adds `split`: validation for the first rows in the order of the id's digest, at least one and not all."""
    n = df.count()
    if n < 2:
        raise ValueError("at least two documents are needed")
    held = min(n - 1, max(1, half_even(n, fraction)))
    ranked = global_rank(df, [tx.digest8(F.col(id_col)), F.col(id_col)], "_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") < held, "validation").otherwise("train")).drop("_rank")


def three_way(df: DataFrame, text_col: str, ord_col: str, fractions: tuple[float, float, float] = (0.9, 0.05, 0.05), seed: int = 42) -> DataFrame:
    """Adds `split` to the first row of each text that is not empty: test, then validation, then train in key order."""
    if min(fractions) <= 0 or abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("fractions must be positive and sum to 1")
    distinct = keep_first(df.filter(F.col(text_col) != ""), [F.sha2(text_col, 256)], [ord_col])
    n = distinct.count()
    n_validation, n_test = max(1, half_even(n, fractions[1])), max(1, half_even(n, fractions[2]))
    if n - n_validation - n_test < 1:
        raise ValueError("too few texts for three splits")
    ranked = global_rank(distinct, [tx.order_key(seed, F.col(text_col)), F.col(ord_col)], "_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_validation, "validation").otherwise("train")).drop("_rank")


def label_hold_out(df: DataFrame, text_col: str, label_col: str, fraction: float = 0.25) -> DataFrame:
    """Adds `split`: of each label the first rows in bucket order are validation, at least one."""
    bucket = F.conv(F.concat(*[F.substring(tx.digest8(F.col(text_col)), 15 - 2 * i, 2) for i in range(8)]), 16, 10).cast("decimal(20,0)") % F.lit(2**31 - 1)
    ranked = global_rank(df, [bucket, F.col(text_col)], "_rank", (label_col,))
    sizes = cut(df.groupBy(label_col).agg(F.greatest(F.lit(1), F.bround(F.count("*") * fraction)).alias("_held")))
    joined = met(ranked, sizes, [label_col], text_col)
    return joined.withColumn("split", F.when(F.col("_rank") < F.col("_held"), "validation").otherwise("train")).drop("_rank", "_held")


def split_overlap(df: DataFrame, split_col: str, content: Column) -> DataFrame:
    """(train_test, train_validation, validation_test): distinct contents that two splits share."""
    seen = df.groupBy(content.alias("_c")).agg(*[F.max(F.when(F.col(split_col) == s, 1).otherwise(0)).alias(s) for s in ("train", "validation", "test")])
    both = lambda a, b: F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("bigint").alias(f"{a}_{b}")
    return seen.agg(both("train", "test"), both("train", "validation"), both("validation", "test"))


def sample_per_group(df: DataFrame, groups: list[str], id_col: str, k: int, seed: int) -> DataFrame:
    """At most `k` rows of each group, by a seeded hash of the id, in one shuffled order (`draw`).

    Each task keeps its own k best of a group before the shuffle, so a hot group is not gathered.
    """
    keyed = df.withColumn("draw", F.sha2(F.concat(F.lit(f"{seed}\x00"), F.col(id_col).cast("string")), 256))
    local = Window.partitionBy(*groups, "_part").orderBy("draw", id_col)
    first = keyed.withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(64))).withColumn("_n", F.row_number().over(local)).filter(F.col("_n") <= k)
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy("draw", id_col))).filter(F.col("_n") <= k).drop("_n", "_part")


def sample_cells(df: DataFrame, groups: list[str], id_col: str, k: int, seed: int) -> DataFrame:
    """As sample_per_group, but a cell with fewer than `k` rows is an error when the rows are read."""
    sizes = df.groupBy(*groups).agg(F.count("*").alias("_size"))
    sampled = sample_per_group(df, groups, id_col, k, seed).join(sizes, groups)
    return sampled.withColumn("_size", F.when(F.col("_size") >= k, F.col("_size")).otherwise(F.raise_error(F.lit("a cell has too few documents")).cast("bigint"))).filter("_size is not null").drop("_size")
