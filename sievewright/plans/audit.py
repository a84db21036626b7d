"""Audits of quality tiers: the current and the length-balanced policy side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators import reports, spans, splits
from sievewright.session import cut


def policy_summary(df: DataFrame, policies: list[str], windows_col: str, score_col: str, bytes_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, policy, tier, documents, valid_windows, window_fraction, mean_utf8_bytes, mean_score) of tiers 0 to 2 by policy."""
    long = df.select(*by, windows_col, score_col, bytes_col, F.explode(F.array(*[F.struct(F.lit(c).alias("policy"), F.col(c).alias("tier")) for c in policies])).alias("p")).select(*by, windows_col, score_col, bytes_col, "p.*")
    return reports.tier_statistics(long, "tier", windows_col, score_col, {"utf8_bytes": F.col(bytes_col)}, (*by, "policy")).select(*by, "policy", "tier", "documents", F.col("eligible_windows").alias("valid_windows"), "window_fraction", "mean_utf8_bytes", "mean_score")


def length_balanced_audit(df: DataFrame, seq_len: int, per_cell: int, seed: int, held_out: DataFrame | None = None, strata: int = 4, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Tables of an audit over rows (ord, doc_id, n_tokens, score, tier, utf8_bytes), each of `by` for itself.

    tiers: both policies; lengths_current and lengths_candidate: shares of tiers by stratum; correlation: ranks of
    score and bytes; sample: `per_cell` documents of every stratum and candidate tier, an error if a cell has fewer;
    bands: where scores of `held_out` (score) fall, if given. Spans without a window are left out. If the rows come with
    valid_windows, one that does not fit n_tokens and seq_len is an error when the rows are read. Null scores count as 0.
    """
    if per_cell < 1:
        raise ValueError("per_cell must be positive")
    w = spans.valid_starts(F.col("n_tokens"), seq_len)
    if "valid_windows" in df.columns:
        w = F.when(F.col("valid_windows") == w, w).otherwise(F.raise_error(F.lit("valid_windows do not fit the tokens")).cast("bigint"))
    live = df.withColumn("w", w).filter("w > 0").withColumnRenamed("tier", "current_tier")
    both = cut(spans.length_balanced_tiers(live, "n_tokens", "score", "ord", seq_len, strata, by, out="candidate_tier").withColumn("score", F.coalesce("score", F.lit(0.0))))
    out = {
        "tiers": policy_summary(both, ["current_tier", "candidate_tier"], "w", "score", "utf8_bytes", by),
        "lengths_current": reports.length_table(both, "length_stratum", "current_tier", "n_tokens", "w"),
        "lengths_candidate": reports.length_table(both, "length_stratum", "candidate_tier", "n_tokens", "w"),
        "correlation": reports.rank_correlation(both, F.col("score"), F.col("utf8_bytes"), "ord"),
        "sample": splits.sample_cells(both, [*by, "length_stratum", "candidate_tier"], "doc_id", per_cell, seed),
        "assigned": both,
    }
    if held_out is not None:
        out["bands"] = reports.score_bands(both, held_out, "current_tier", "score")
    return out


def reviewed(tables: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """(policy, tier, labeled, mean_label) from a filled review sheet (doc_id, human_label) of the audit's sample."""
    sample = tables["sample"]
    marked = reports.checked_labels(labels, sample, "doc_id", "human_label")
    return reports.label_means(sample.sparkSession, sample, marked, "doc_id", ["current_tier", "candidate_tier"])
