"""Running sums and ranks over a total order without gathering the rows in one task.

Rows are range-partitioned by the order; each range is summed, the few sums are accumulated, and a window inside
each range adds the sum of all ranges before. The range layout is materialised, so that it is the same in each pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.session import cut


def prefix_sum(df: DataFrame, order: list[Column | str], value: Column | str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds `out`: the sum of `value` over all earlier rows of the same `by`, exclusive.

    `order` must be total inside `by`, or equal rows are taken in any order. Null values count as 0.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    amount = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
    placed = df.withColumn("_v", amount).withColumns({f"_o{i}": k for i, k in enumerate(keys)})
    sort = [f"_o{i}" for i in range(len(keys))]
    ranged = cut(placed.repartitionByRange(*[F.col(c) for c in (*by, *sort)]).withColumn("_r", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_r").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_r", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_b"))
    inside = Window.partitionBy(*by, "_r").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_r")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    kept = [F.col(f"a.{c}") for c in ranged.columns]
    joined = ranged.alias("a").join(base.alias("b"), condition).select(*kept, "_b")
    return joined.withColumn(out, F.col("_b") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_r", "_b", *sort)


def global_rank(df: DataFrame, order: list[Column | str], out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds `out`: the 0-based rank of each row in the total order, inside `by`."""
    return prefix_sum(df, order, F.lit(1).cast("bigint"), out, by)


def budget_prefix(df: DataFrame, order: list[Column | str], size: Column, budget: int, text: str | None = None) -> DataFrame:
    """Rows before the running total of `size` reaches `budget`; 0 is no limit. With `text`, the last is cut to fit."""
    if budget <= 0:
        return df
    summed = prefix_sum(df, order, size, "_before")
    kept = summed.filter(F.col("_before") < budget)
    if text:
        kept = kept.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("_before")).cast("int")))
    return kept.drop("_before")


def keep_first(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key: order is semantic, so no dropDuplicates. The pre-aggregated minimum of the order per
    key meets a hot key once a task, and no window gathers it."""
    keyed = df.withColumns({f"_k{i}": k for i, k in enumerate(key)})
    names = [f"_k{i}" for i in range(len(key))]
    firsts = keyed.groupBy(*names).agg(F.min(F.struct(*order)).alias("_first")).select(F.col("_first").alias("_f"))
    return keyed.withColumn("_f", F.struct(*order)).join(firsts, "_f", "left_semi").drop("_f", *names)


def paired(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of both sides one to one; a row without its counterpart, or a repeated key, is an error when rows are read."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), on, "full")
    counted = both.join(both.groupBy(on).agg(F.count("*").alias("_n")), on)
    ok = F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("_n") == 1)
    failed = F.raise_error(F.lit("the two sides differ in their rows")).cast("int")
    return counted.withColumn("_n", F.when(ok, 1).otherwise(failed)).filter("_n = 1").drop("_l", "_r", "_n")


def completed(wanted: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """`found` rows of the wanted ids; an id without a row is an error when rows are read."""
    joined = wanted.select(on).distinct().join(found.withColumn("_f", F.lit(1)), on, "left")
    failed = F.raise_error(F.lit("a wanted id is missing")).cast("int")
    return joined.withColumn("_f", F.when(F.col("_f") == 1, 1).otherwise(failed)).filter("_f = 1").drop("_f")
