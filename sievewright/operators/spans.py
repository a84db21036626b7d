"""Token spans: offsets, quality tiers, window sampling and evaluation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators.joins import met
from sievewright.operators.ordered import global_rank, prefix_sum
from sievewright.session import cut

TIERS = ("low", "medium", "high")
MIN_SLOTS, SPANS_PER_SLOT = 1024, 32


def valid_starts(n_tokens: Column, seq_len: int) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), n_tokens - seq_len)


def span_offsets(df: DataFrame, tokens_col: str, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds span_start and span_end: documents one after another in a token stream."""
    return prefix_sum(df, order, tokens_col, "span_start", by).withColumn("span_end", F.col("span_start") + F.col(tokens_col))


def _with_group(df: DataFrame, by: tuple[str, ...], ord_col: str, total: Column) -> DataFrame:
    """Rows with an aggregate of their group, which is counted before it is broadcast; of one group it is a number."""
    totals = cut(df.groupBy(*by).agg(total))
    if by:
        return met(df, totals, list(by), ord_col)
    name = totals.columns[0]
    return df.withColumn(name, F.lit(totals.first()[0]).cast("bigint"))


def quality_tiers(df: DataFrame, tokens_col: str, score_col: str, ord_col: str, seq_len: int, by: tuple[str, ...] = (), out: str = "tier") -> DataFrame:
    """Adds `out`: thirds of the valid window starts in the order of score, then ord; -1 for spans without any.

    Null and NaN scores come first. by: groups that are divided for themselves.
    """
    weighed = df.withColumn("_w", valid_starts(F.col(tokens_col), seq_len))
    rest, eligible = weighed.filter(F.coalesce(F.col("_w"), F.lit(0)) <= 0), weighed.filter("_w > 0")
    score = F.coalesce(F.nanvl(score_col, F.lit(None).cast("double")), F.lit(float("-inf")))
    summed = prefix_sum(eligible, [score, ord_col], "_w", "_before", by)
    joined = _with_group(summed, by, ord_col, F.sum("_w").alias("_total"))
    middle = (F.col("_before") + F.col("_w") / 2) / F.col("_total")
    tier = F.when(middle <= 1 / 3, 0).when(middle <= 2 / 3, 1).otherwise(2)
    return joined.withColumn(out, tier).drop("_w", "_before", "_total").unionByName(rest.withColumn(out, F.lit(-1)).drop("_w"))


def length_strata(df: DataFrame, tokens_col: str, ord_col: str, seq_len: int, strata: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds length_stratum: rank by length times strata over the count, rounded down; null for ineligible spans."""
    if strata < 1:
        raise ValueError("strata must be positive")
    eligible = df.filter(valid_starts(F.col(tokens_col), seq_len) > 0)
    rest = df.filter(F.coalesce(valid_starts(F.col(tokens_col), seq_len), F.lit(0)) <= 0)
    ranked = global_rank(eligible, [tokens_col, ord_col], "_rank", by)
    joined = _with_group(ranked, by, ord_col, F.count("*").alias("_n"))
    enough = F.when(F.col("_n") >= strata, F.col("_n")).otherwise(F.raise_error(F.lit("too few eligible documents for the strata")).cast("bigint"))
    placed = joined.withColumn("length_stratum", F.floor(F.col("_rank") * strata / enough).cast("int")).drop("_rank", "_n")
    return placed.unionByName(rest.withColumn("length_stratum", F.lit(None).cast("int")))


def length_balanced_tiers(df: DataFrame, tokens_col: str, score_col: str, ord_col: str, seq_len: int, strata: int = 4, by: tuple[str, ...] = (), out: str = "tier") -> DataFrame:
    """Adds length_stratum and `out`: quality_tiers inside each stratum of token length."""
    return quality_tiers(length_strata(df, tokens_col, ord_col, seq_len, strata, by), tokens_col, score_col, ord_col, seq_len, (*by, "length_stratum"), out)


def rolling_windows(df: DataFrame, tokens_col: str, seq_len: int, stride: int) -> DataFrame:
    """Explodes each document to (context_start, target_start, target_end): every token is a target once."""
    n = F.col(tokens_col)
    starts = df.filter(n > 0).withColumn("target_start", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(stride).cast("bigint"))))
    end = F.least(n, F.col("target_start") + stride)
    return starts.withColumn("target_end", end).withColumn("context_start", F.greatest(F.lit(0).cast("bigint"), F.col("target_end") - seq_len))


def uniform(seed: int, *parts: Column) -> Column:
    """A reproducible number in [0, 1) from a seed and columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample_windows(df: DataFrame, id_col: str, tokens_col: str, tier_col: str, ord_col: str, draws: int, seq_len: int, probabilities: tuple[float, ...] | None, seed: int) -> DataFrame:
    """(draw, tier, id, window_start): windows drawn by tier, then span by its valid starts, then offset.

    probabilities None draws spans by their mass over all tiers. Cumulative masses are met by an equi-join on
    slots of the unit interval, about one for every 32 spans, and a range test, so a draw meets few spans. A tier with
    a probability but without spans is an error; a window never crosses a document.
    """
    eligible = df.withColumn("_w", valid_starts(F.col(tokens_col), seq_len)).filter("_w > 0").withColumn("_t", F.col(tier_col) if probabilities else F.lit(0))
    summed = cut(prefix_sum(eligible, [ord_col], "_w", "_before", ("_t",)))
    slots_n = 1 << max(MIN_SLOTS.bit_length() - 1, (summed.count() // SPANS_PER_SLOT).bit_length())
    totals = cut(summed.groupBy("_t").agg(F.sum("_w").alias("_total")))
    found = {r["_t"] for r in totals.filter(F.col("_t").isin(*range(len(probabilities or (1,))))).select("_t").collect()}
    empty = [k for k, p in enumerate(probabilities or (1.0,)) if p > 0 and k not in found]
    if empty and draws > 0:
        raise ValueError(f"no eligible span in tier {', '.join(map(str, empty))}")
    low, high = F.col("_before") / F.col("_total"), (F.col("_before") + F.col("_w")) / F.col("_total")
    spans = met(summed, totals, ["_t"], ord_col).withColumn("_low", low).withColumn("_high", high)
    slots = F.sequence(F.floor(F.col("_low") * slots_n).cast("int"), F.least(F.floor(F.col("_high") * slots_n), F.lit(slots_n - 1)).cast("int"))
    spans = spans.withColumn("_slot", F.explode(slots)).select("_t", "_slot", "_low", "_high", "_w", id_col)
    drawn = df.sparkSession.range(draws).withColumnRenamed("id", "draw")
    tier = F.lit(0)
    if probabilities:
        cumulative, steps = 0.0, F.lit(len(probabilities) - 1)
        edges = []
        for p in probabilities:
            cumulative += p
            edges.append(cumulative)
        for i in range(len(edges) - 2, -1, -1):
            steps = F.when(F.col("_u0") < edges[i], i).otherwise(steps)
        tier = steps
    drawn = drawn.withColumn("_u0", uniform(seed, F.lit("tier"), F.col("draw"))).withColumn("_t", tier).withColumn("_u", uniform(seed, F.lit("span"), F.col("draw"))).withColumn("_slot", F.floor(F.col("_u") * slots_n).cast("int"))
    hit = drawn.join(spans, ["_t", "_slot"]).filter((F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high")))
    start = F.floor(uniform(seed, F.lit("start"), F.col("draw")) * F.col("_w")).cast("bigint")
    return hit.select("draw", F.col("_t").alias("tier"), id_col, start.alias("window_start"))


def draw_windows(df: DataFrame, id_col: str, tokens_col: str, tier_col: str, ord_col: str, draws: int, seq_len: int, policy: str, probabilities: tuple[float, ...], seed: int) -> DataFrame:
    """(draw, tier, id, window_start) by a sampling policy; of stream_uniform the id is null and the start lies in the
    stream of all documents."""
    if policy == "stream_uniform":
        total = df.agg(F.sum(tokens_col)).first()[0] or 0
        kind = df.schema[id_col].dataType
        return stream_windows(df.sparkSession, total, seq_len, draws, seed).select("draw", F.lit(0).alias("tier"), F.lit(None).cast(kind).alias(id_col), "window_start")
    if policy not in ("document_uniform", "quality_tier", "quality_tier_length_balanced"):
        raise ValueError(f"unknown sampling policy {policy}")
    return sample_windows(df, id_col, tokens_col, tier_col, ord_col, draws, seq_len, None if policy == "document_uniform" else probabilities, seed)


def draw_counts(sampled: DataFrame, tier_col: str = "tier") -> DataFrame:
    return sampled.groupBy(tier_col).agg(F.count("*").alias("draws"))


def stream_windows(spark, n_tokens: int, seq_len: int, draws: int, seed: int) -> DataFrame:
    """(draw, window_start): uniform starts over one token stream."""
    if n_tokens <= seq_len:
        raise ValueError("the stream must be longer than a window")
    drawn = spark.range(draws).withColumnRenamed("id", "draw")
    return drawn.select("draw", F.floor(uniform(seed, F.lit("start"), F.col("draw")) * (n_tokens - seq_len)).cast("bigint").alias("window_start"))


def latest_spans(df: DataFrame) -> DataFrame:
    """Cleaned spans (span_id, cache_name, ord, doc_id, score, n_tokens): the latest delivery of each span_id with
    both ends known, swapped ends in order."""
    last = df.groupBy("span_id").agg(F.max(F.struct("loaded_at", "cache_name", "ord", "doc_id", "span_start", "span_end", "score")).alias("r"))
    rows = last.select("span_id", "r.*").filter("span_start is not null and span_end is not null")
    return rows.select("span_id", "cache_name", "ord", "doc_id", "score", F.abs(F.col("span_end") - F.col("span_start")).cast("bigint").alias("n_tokens"))


