"""Reports: funnels, tier audits, label summaries, losses, schedules, seeds, scaling fits and latencies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.operators.ordered import global_rank

FEATURES = ("length_score", "alphabetic_score", "sentence_density", "unique_word_ratio", "trigram_uniqueness")


def histogram_map(df: DataFrame, key: str, out: str) -> DataFrame:
    """One row: counts by key as a map in key order, null keys left out."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "_n")))).alias(out))


def tier_statistics(df: DataFrame, tier_col: str, windows_col: str, score_col: str, extra: dict[str, Column] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """By tier (and `by`): documents, eligible windows, share of windows, mean and exact median score, means of `extra`."""
    kept = df.filter(F.col(tier_col) >= 0)
    stats = kept.groupBy(*by, tier_col).agg(F.count("*").alias("documents"), F.sum(windows_col).alias("eligible_windows"), F.avg(score_col).alias("mean_score"), F.median(score_col).alias("median_score"), *[F.avg(c).alias(f"mean_{k}") for k, c in (extra or {}).items()])
    total = F.sum("eligible_windows").over(Window.partitionBy(*(by or [F.lit(0)])))  # at most a row a tier
    return stats.withColumn("window_fraction", F.when(total > 0, F.col("eligible_windows") / total).otherwise(0.0))


def length_table(df: DataFrame, stratum_col: str, tier_col: str, tokens_col: str, windows_col: str) -> DataFrame:
    """By stratum: documents, mean tokens, and the share of documents and of windows in each tier."""
    share = lambda k: (F.count_if(F.col(tier_col) == k) / F.count("*")).alias(f"tier{k}_documents")
    mass = lambda k: (F.coalesce(F.sum(F.when(F.col(tier_col) == k, F.col(windows_col))), F.lit(0)) / F.sum(windows_col)).alias(f"tier{k}_windows")
    return df.filter(F.col(stratum_col).isNotNull()).groupBy(stratum_col).agg(F.count("*").alias("documents"), F.avg(tokens_col).alias("mean_tokens"), *[share(k) for k in range(3)], *[mass(k) for k in range(3)])


def clean_labels(df: DataFrame, id_col: str, label_col: str, order: list[str]) -> DataFrame:
    """(id, label): the last usable label 0, 1 or 2 of each id; blank, null and other values are left out."""
    value = F.trim(F.col(label_col))
    rows = df.filter(value.isin("0", "1", "2")).select(id_col, value.cast("int").alias("label"), *order)
    return rows.groupBy(id_col).agg(F.max(F.struct(*order, "label")).alias("_r")).select(id_col, F.col("_r.label").alias("label"))


def checked_labels(df: DataFrame, known: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) of rows with a label; an unknown or repeated id or another label fails when the rows are read."""
    value = F.trim(F.col(label_col))
    rows = df.filter(F.coalesce(value, F.lit("")) != "").select(id_col, value.alias("_v"))
    counted = rows.join(rows.groupBy(id_col).agg(F.count("*").alias("_n")), id_col).join(known.select(id_col, F.lit(True).alias("_known")), id_col, "left")
    fail = lambda text: F.raise_error(F.lit(text)).cast("int")
    label = F.when(F.col("_known").isNull(), fail("unknown document")).when(F.col("_n") > 1, fail("repeated document")).when(~F.col("_v").isin("0", "1", "2"), fail("label must be 0, 1 or 2")).otherwise(F.col("_v").cast("int"))
    return counted.select(id_col, label.alias("label"))


def label_means(spark: SparkSession, tiers: DataFrame, labels: DataFrame, id_col: str, tier_cols: list[str]) -> DataFrame:
    """(policy, tier, labeled, mean_label) for tiers 0 to 2 of every policy column; null where nothing is labelled."""
    met = labels.join(tiers.select(id_col, *tier_cols), id_col)
    long = met.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("policy"), F.col(c).alias("tier")) for c in tier_cols])).alias("x")).select("label", "x.*")
    every = spark.createDataFrame([(c, t) for c in tier_cols for t in range(3)], "policy string, tier int")
    found = long.groupBy("policy", "tier").agg(F.count("*").alias("labeled"), F.avg("label").alias("mean_label"))
    return every.join(found, ["policy", "tier"], "left").withColumn("labeled", F.coalesce("labeled", F.lit(0)))


def rank_correlation(df: DataFrame, x: Column, y: Column, tie: str) -> DataFrame:
    """One row: correlation of the ranks of x and y, ties by `tie`."""
    ranked = global_rank(df.withColumn("_x", x).withColumn("_y", y), ["_x", tie], "_rx")
    return global_rank(ranked, ["_y", tie], "_ry").agg(F.corr("_rx", "_ry").alias("rank_correlation"))


#: Groups whose cut points score_bands compares in one pass; more are an error.
MAX_BAND_GROUPS = 10_000


def score_bands(reference: DataFrame, other: DataFrame, tier_col: str, score_col: str, by: str | None = None) -> DataFrame:
    """One row (for each `by` of the reference): how many scores of `other` lie up to the greatest score of tier 0, of
    tier 1, and above. The cut points of at most MAX_BAND_GROUPS groups pass through the driver."""
    top = lambda k: F.max(F.when(F.col(tier_col) == k, F.col(score_col))).alias(f"cut{k}")
    group = F.col(by).alias("g") if by else F.lit(0).alias("g")
    cuts = reference.groupBy(group).agg(top(0), top(1)).limit(MAX_BAND_GROUPS + 1).collect()
    if len(cuts) > MAX_BAND_GROUPS:
        raise ValueError(f"more than {MAX_BAND_GROUPS} groups")
    s, kind = F.col(score_col), reference.select(group).schema["g"].dataType.simpleString()
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r["cut0"]).cast("double").alias("cut0"), F.lit(r["cut1"]).cast("double").alias("cut1")) for i, r in enumerate(cuts)])
    met = other.select(s, F.explode(bands).alias("x")).groupBy("x.i").agg(F.count_if(s <= F.col("x.cut0")).alias("low"), F.count_if((s > F.col("x.cut0")) & (s <= F.col("x.cut1"))).alias("medium"), F.count_if(s > F.col("x.cut1")).alias("high"))
    numbered = reference.sparkSession.createDataFrame([(i, r["g"]) for i, r in enumerate(cuts)], f"i int, g {kind}")
    counted = numbered.join(met, "i", "left").select("g", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("low", "medium", "high")])
    return counted.withColumnRenamed("g", by) if by else counted.drop("g")


def corpus_loss(df: DataFrame, loss_col: str, tokens_col: str, bytes_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (by `by`): tokens, mean loss, perplexity (of a loss up to 20) and bits per byte."""
    loss = F.sum(loss_col) / F.sum(tokens_col)
    return df.groupBy(*by).agg(F.sum(tokens_col).alias("tokens"), loss.alias("loss"), F.exp(F.least(loss, F.lit(20.0))).alias("perplexity"), (F.sum(loss_col) / (F.lit(math.log(2)) * F.sum(bytes_col))).alias("bits_per_byte"))


def mixture(a: Column, b: Column) -> Column:
    """Log probability of the even mixture of two log probabilities."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))) - math.log(2)


def gold_log_probability(logits: Column, target: Column) -> Column:
    """Log-softmax of an array of logits at a 0-based target."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.element_at(logits, target + 1) - top - F.ln(total)


def ensemble_summary(df: DataFrame, doc_col: str, members: list[str], tokens_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (by `by`) from per-document log-probability sums of two members and their mixture (`mixed`): losses,
    perplexities, the best member's loss and how many documents the mixture improves on both."""
    loss = {m: -F.sum(m) / F.sum(tokens_col) for m in (*members, "mixed")}
    better = F.count_if(F.col("mixed") > F.greatest(*members))
    cols = [c for m, v in loss.items() for c in (v.alias(f"{m}_loss"), F.exp(F.least(v, F.lit(20.0))).alias(f"{m}_perplexity"))]
    return df.groupBy(*by).agg(F.count(doc_col).alias("documents"), *cols, F.least(*[loss[m] for m in members]).alias("best_single_loss"), better.alias("improved_documents"))


def _warm(step: Column, rate: float, warmup: int) -> Column:
    return F.lit(rate) * (step + 1) / max(1, warmup)


def _fall(progress: Column, rate: float, floor_ratio: float) -> Column:
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress))
    low = rate * floor_ratio
    return low + 0.5 * (rate - low) * (1 + F.cos(math.pi * clipped))


def cosine_rate(step: Column, steps: int, rate: float, warmup: int, floor_ratio: float) -> Column:
    """Linear warm-up, then a cosine to the floor at the last step."""
    after = F.lit(rate) if steps == warmup else _fall((step - warmup) / float(max(1, steps - warmup - 1)), rate, floor_ratio)
    return F.when(step < warmup, _warm(step, rate, warmup)).otherwise(after)


def wsd_rate(step: Column, steps: int, rate: float, warmup: int, decay: int, floor_ratio: float) -> Column:
    """Linear warm-up, a constant part, and a cosine over the last `decay` steps."""
    begin = steps - decay
    fall = _fall((step - begin) / float(max(1, decay - 1)), rate, floor_ratio)
    return F.when(step < warmup, _warm(step, rate, warmup)).when(step < begin, F.lit(rate)).otherwise(fall)


def seed_summary(df: DataFrame, change: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of relative changes over runs: mean, median, sample deviation, extremes, improvements."""
    c = F.col(change)
    return df.groupBy(*by).agg(F.count(c).alias("runs"), F.avg(c).alias("mean_change"), F.median(c).alias("median_change"), F.stddev_samp(c).alias("sample_std_change"), F.min(c).alias("min_change"), F.max(c).alias("max_change"), F.count_if(c < 0).alias("improved_runs"))


def check_seeds(df: DataFrame, seed_col: str, controls: list[str]) -> DataFrame:
    """The runs, if there are at least two, all controls are equal and no seed repeats; else an error."""
    row = df.agg(F.count("*").alias("n"), F.count_distinct(seed_col).alias("seeds"), F.count_distinct(F.struct(*controls)).alias("kinds")).first()
    if row.n < 2:
        raise ValueError("at least two runs are needed")
    if row.kinds != 1:
        raise ValueError("runs differ in their controls")
    if row.seeds != row.n:
        raise ValueError("a seed is repeated")
    return df


def best_runs(df: DataFrame) -> DataFrame:
    """(compute_budget, parameters, final_loss, tokens): the run of least loss, then fewest parameters, of each budget."""
    best = df.groupBy("compute_budget").agg(F.min(F.struct("final_loss", "parameters")).alias("b"))
    return best.select("compute_budget", "b.parameters", "b.final_loss", (F.col("compute_budget") / (6 * F.col("b.parameters"))).alias("tokens"))


def power_law(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """One row: coefficient, exponent and log RMSE of y as a power of x."""
    lx, ly = F.ln(x), F.ln(y)
    fit = df.agg(F.regr_slope(ly, lx).alias("s"), F.regr_intercept(ly, lx).alias("i"))
    error = df.crossJoin(F.broadcast(fit)).agg(F.sqrt(F.avg(F.pow(ly - (F.col("i") + F.col("s") * lx), 2))).alias(f"{name}_log_rmse"), F.exp(F.first("i")).alias(f"{name}_coefficient"), F.first("s").alias(f"{name}_exponent"))
    return error


def scaling_fit(df: DataFrame) -> DataFrame:
    """One row: power laws of the best parameters and tokens over the compute budget."""
    best = best_runs(df)
    return power_law(best, "compute_budget", "parameters", "parameter").crossJoin(power_law(best, "compute_budget", "tokens", "token"))


def predict(fit: DataFrame, budget: float) -> DataFrame:
    """Parameters and tokens that a fit gives a budget, and the compute they imply."""
    if budget <= 0:
        raise ValueError("budget must be positive")
    n, d = F.col("parameter_coefficient") * F.pow(F.lit(budget), "parameter_exponent"), F.col("token_coefficient") * F.pow(F.lit(budget), "token_exponent")
    return fit.select(F.lit(budget).alias("compute_budget"), n.alias("predicted_parameters"), d.alias("predicted_tokens"), (6 * n * d).alias("implied_compute"))


def latency(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Median and nearest-rank 95th percentile."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.percentile_disc(0.95)(value).alias("p95") if callable(getattr(F, "percentile_disc", None)) else F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def compare_runs(left: DataFrame, right: DataFrame, controls: list[str], loss: str = "loss", perplexity: str = "perplexity") -> DataFrame:
    """One row from two one-row reports: losses, relative change of perplexity and the choice, which is the second only
    if its loss is lower. Controls that differ are an error."""
    a, b = left.first(), right.first()
    for c in controls:
        if a[c] is None or a[c] != b[c]:
            raise ValueError(f"runs differ in {c}")
    change = b[perplexity] / a[perplexity] - 1.0
    row = (*[a[c] for c in controls], a[loss], b[loss], change, "second" if b[loss] < a[loss] else "first")
    kinds = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in controls)
    return left.sparkSession.createDataFrame([row], f"{kinds}, first_loss double, second_loss double, relative_change double, selected string")
