"""Problem 9: sources mixed to target shares by weighted fair queueing.

Each source's documents stand in a hashed order, pass after pass. A copy's virtual finish time is the running sum of
its source's tokens divided by the target weight; all copies are range-sorted by it and taken while the total fits
the budget. Running sums are made in two levels, by ranges of the order and inside each, so no source is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.encoding import count_tokens
from sievewright.session import cut, rows_of

#: Ranges of an order: at least MIN_RANGES, and one for every ROWS_PER_RANGE rows, so no window task grows with the data.
MIN_RANGES, ROWS_PER_RANGE = 1024, 50_000
SEED = 29
BROADCAST_ROWS = 100_000


def canonical_source(c: Column) -> Column:
    """Spelling variants as one: no outer white space, lower case, inner white space and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")), r"[\s -]+", "_")


def running_sum(df: DataFrame, groups: list[str], order: list[str], range_col: str, value: str, out: str) -> DataFrame:
    """Adds `out`: the inclusive running sum of `value` by `groups` in `order`; `range_col` must grow with the order."""
    sums = df.groupBy(*groups, range_col).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(range_col).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*groups, range_col, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*groups, range_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(base, [*groups, range_col]).withColumn(out, F.col("_base") + F.sum(value).over(inside)).drop("_base")


def plan(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(mix_name, source, target_share, max_repeats, source_tokens, weight, budget, passes) of every target row.

    weight: the share among the mix's sources that have tokens. budget: the largest total at which all of these
    can hold their weight, or the given one. passes: how often a source is gone through at most; where a given budget
    is more than that, some source ends early and the others may have to fill the rest.
    """
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    rows = targets.filter(F.col("mix_name").isNotNull() & F.col("source").isNotNull()).select("mix_name", canonical_source(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("max_repeats"))
    rows = rows.join(totals, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    has = (F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    mix = Window.partitionBy("mix_name")
    rows = rows.withColumn("weight", F.when(has, F.col("target_share") / F.sum(F.when(has, F.col("target_share"))).over(mix)))
    most = F.floor(F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("weight")).over(mix))
    rows = rows.withColumn("budget", F.lit(budget).cast("bigint") if budget is not None else most)
    fits = F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("weight")).over(mix) >= F.col("budget")
    wanted = F.when(fits, F.col("weight")).otherwise(1.0) * F.col("budget") / F.col("source_tokens")
    passes = F.least(F.col("max_repeats").cast("bigint"), F.ceil(wanted) + 1).cast("int")
    return rows.withColumn("passes", F.when(has, passes).otherwise(0))


def mix(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, seed: int = SEED, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen copies, shares).

    copies: (mix_name, source, id, repeat, n_tokens, finish, total_tokens), repeat from 0; total_tokens is the running
    total of the mix. shares: (mix_name, source, target_share, max_repeats, available_tokens, budget, tokens, copies,
    repeats, actual_share) of every target row; sources that documents lack have zeros. Documents without tokens or
    source are never chosen. A budget beyond what all sources can give in their shares is filled by those that have
    more, up to their repeats; actual_share tells. Spelling variants of a source are one; extra columns are ignored; empty tables on
    either side give empty copies.
    """
    wanted = cut(targets.select(canonical_source(F.col("source")).alias("source")).filter("source is not null").distinct())
    docs = documents.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), canonical_source(F.col(source_col)).alias("source"))
    docs = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "source", "left_semi")
    sized = cut(count_tokens(docs, "_id", "_text", path, keep=("source",)).filter("n_tokens > 0"))
    ranges = max(MIN_RANGES, 1 << (rows_of(sized) // ROWS_PER_RANGE).bit_length())
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_id"), 1)
    ranked = sized.withColumn("_key", order).withColumn("_range", F.shiftright(F.col("_key"), 63 - (ranges.bit_length() - 1)).cast("int"))
    queued = running_sum(ranked, ["source"], ["_key", "_id"], "_range", "n_tokens", "_upto")
    planned = cut(plan(sized, targets, budget))
    plan_rows = planned.filter("passes > 0").select("mix_name", "source", "weight", "budget", "passes", "source_tokens")
    copies = queued.join(F.broadcast(plan_rows) if planned.count() <= BROADCAST_ROWS else plan_rows, "source")
    copies = copies.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    copies = copies.withColumn("finish", (F.col("repeat") * F.col("source_tokens") + F.col("_upto")) / F.col("weight"))
    copies = copies.withColumn("_slot", F.floor(F.col("finish") / F.greatest(F.col("budget"), F.lit(1)) * ranges))
    taken = running_sum(copies.select("mix_name", "source", "_id", "repeat", "n_tokens", "finish", "budget", "_slot"), ["mix_name"], ["finish", "source", "_id", "repeat"], "_slot", "n_tokens", "total_tokens").filter(F.col("total_tokens") <= F.col("budget"))
    chosen = taken.select("mix_name", "source", F.col("_id").alias(id_col), "repeat", "n_tokens", "finish", "total_tokens")
    sums = chosen.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("copies"), (F.max("repeat") + 1).alias("repeats"))
    shares = planned.join(sums, ["mix_name", "source"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("tokens", "copies", "repeats")})
    share = F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy("mix_name")), F.lit(1))
    return chosen, shares.select("mix_name", "source", "target_share", "max_repeats", F.col("source_tokens").alias("available_tokens"), "budget", "tokens", "copies", "repeats", share.alias("actual_share"))
