"""The curation funnel: normalise and mask, then rules, model, exact and near duplicates, decontamination."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.config import ABLATION, CurationConfig
from sievewright.functions import text as tx
from sievewright.functions.quality import drop_reason
from sievewright.operators.classifier import QualityClassifier
from sievewright.operators.decontam import decontaminate
from sievewright.operators.dedup import near_duplicates
from sievewright.operators.joins import met
from sievewright.operators.splits import hold_out
from sievewright.session import cut, rows_of


@dataclass
class Curated:
    train: DataFrame
    validation: DataFrame
    test: DataFrame
    report: DataFrame


def ingest(df: DataFrame, prefix: str, config: CurationConfig) -> DataFrame:
    """(ord, doc_id, text, source, pii_replacements, quality_score, profile) of rows (ord, text, source); null texts become empty."""
    rows = df.select("ord", "source", tx.normalize_text(F.coalesce("text", F.lit(""))).alias("_raw"))
    rows = rows.withColumn("doc_id", F.format_string(f"{prefix}-%06d-%s", "ord", tx.digest6("_raw")))
    if config.enable_pii_masking:
        rows = tx.with_masked(rows, "_raw").withColumn("pii_replacements", tx.pii_map())
    else:
        zeros = F.create_map(*[x for k in tx.PII_KEYS for x in (F.lit(k), F.lit(0).cast("bigint"))])
        rows = rows.withColumn("text", F.col("_raw")).withColumn("pii_replacements", zeros)
    rows = rows.withColumn("profile", tx.unit_counts()("text"))
    return rows.select("ord", "doc_id", "text", "source", "pii_replacements", F.lit(None).cast("double").alias("quality_score"), "profile")


REPORT = "raw_documents raw_train_documents quality_dropped model_quality_dropped exact_duplicates_dropped near_duplicates_dropped decontaminated_documents_dropped kept_documents train_documents validation_documents test_documents".split()


def curate(corpus: DataFrame, config: CurationConfig, validation: DataFrame | None = None, test: DataFrame | None = None, model: QualityClassifier | None = None) -> Curated:
    """Splits and one-row report of rows (ord, text, source). Only the training part is filtered.

    The texts are written once, normalised and masked, to the shared checkpoint folder. The stages pass on nothing but
    ords, keys and shingle hashes, and the texts of the rows that are left are joined at the end.
    """
    config.validate()
    if config.enable_model_quality and model is None:
        raise ValueError("model quality needs a classifier")
    spark = corpus.sparkSession
    pool = cut(ingest(corpus, "train-source", config))
    if validation is None:
        parts = cut(hold_out(pool.select("ord", "doc_id"), "doc_id", config.validation_fraction))
        chosen = {s: cut(parts.filter(F.col("split") == s).select("ord")) for s in ("train", "validation")}
        held = met(pool, chosen["validation"], ["ord"], "ord", "left_semi")
        alive = met(pool, chosen["validation"], ["ord"], "ord", "left_anti")
        tested = pool.limit(0)
    else:
        alive, held = pool, cut(ingest(validation, "validation-source", config))
        tested = cut(ingest(test, "test-source", config)) if test is not None else pool.limit(0)
        if held.limit(1).count() == 0 or (test is not None and tested.limit(1).count() == 0):
            raise ValueError("an external split has no documents")
    counts = dict.fromkeys(REPORT, 0)
    reason = drop_reason(F.col("text"), F.col("profile"), config.min_words, config.min_alpha_ratio) if config.enable_quality_rules else F.lit(None).cast("string")
    keyed = cut(alive.select("ord", reason.alias("reason"), tx.canonical_key(F.col("profile"), F.col("text")).alias("key")))
    reasons = {r["reason"]: r["n"] for r in keyed.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    n = reasons.pop(None, 0)
    counts["quality_dropped"] = sum(reasons.values())
    counts["raw_train_documents"] = n + counts["quality_dropped"]
    left, scores, scored = keyed.filter(F.col("reason").isNull()).select("ord", "key"), None, None

    def drop(stage: str, kept: DataFrame) -> DataFrame:
        nonlocal n
        kept = cut(kept)
        before, n = n, rows_of(kept)
        counts[stage] = before - n
        return kept

    if config.enable_model_quality:
        passed = alive.withColumn("reason", reason).filter(F.col("reason").isNull()).select("ord", "text")
        scored = cut(model.score(passed, "text").select("ord", "quality_score"))
        row = scored.agg(F.count("quality_score").alias("n"), F.min("quality_score").alias("min"), F.avg("quality_score").alias("mean"), F.max("quality_score").alias("max")).first()
        scores = (row["min"], row["mean"], row["max"]) if row["n"] else None
        left = drop("model_quality_dropped", left.join(scored.filter(F.col("quality_score") >= config.quality_threshold).select("ord"), "ord", "left_semi"))
    if config.enable_exact_dedup:
        left = drop("exact_duplicates_dropped", left.groupBy("key").agg(F.min("ord").alias("ord")).select("ord"))
    left = left.select("ord")
    if config.enable_near_dedup or config.enable_decontamination:
        sets = cut(met(pool, left, ["ord"], "ord", "left_semi").select("ord", "doc_id", tx.shingle_hashes(config.ngram_size)("text").alias("shingles")))
        if config.enable_near_dedup:
            found = near_duplicates(sets, "shingles", "ord", config.near_dedup_threshold, config.num_hashes, config.num_bands)
            copies = cut(found.filter("ord <> root").select("ord"))
            left = drop("near_duplicates_dropped", met(left, copies, ["ord"], "ord", "left_anti"))
        if config.enable_decontamination:
            reference = held.unionByName(tested).select(F.col("doc_id").alias("item_id"), tx.shingle_hashes(config.ngram_size)("text").alias("shingles"))
            clean = decontaminate(met(sets, left, ["ord"], "ord", "left_semi"), reference, threshold=config.decontamination_threshold, id_col="ord")
            left = drop("decontaminated_documents_dropped", clean.select("ord"))
    train = met(pool, left, ["ord"], "ord", "left_semi")
    if scored is not None:
        train = train.drop("quality_score").join(scored, "ord", "left").select(*pool.columns)
    sides = [pool] if validation is None else [pool, held, tested]
    sums = [F.coalesce(F.sum(F.col("pii_replacements")[k]), F.lit(0)).alias(k) for k in tx.PII_KEYS]
    every = reduce(DataFrame.unionByName, [side.select(F.lit(i).alias("side"), "pii_replacements") for i, side in enumerate(sides)])
    totals = {r["side"]: r for r in every.groupBy("side").agg(F.count("*").alias("n"), *sums).collect()}
    pii = {k: sum(r[k] for r in totals.values()) for k in tx.PII_KEYS}
    size = lambda i: totals[i]["n"] if i in totals else 0
    n_held, n_test = (size(0) - counts["raw_train_documents"], 0) if validation is None else (size(1), size(2))
    counts |= {"raw_documents": counts["raw_train_documents"] + n_held + n_test, "kept_documents": n + n_held + n_test, "train_documents": n, "validation_documents": n_held, "test_documents": n_test}
    histogram = dict(sorted(reasons.items())) if config.enable_quality_rules else None
    schema = ", ".join(f"{k} bigint" for k in REPORT) + ", pii_replacements map<string,bigint>, quality_drop_reasons map<string,bigint>, model_quality_scores struct<min:double,mean:double,max:double>"
    report = spark.createDataFrame([(*[counts[k] for k in REPORT], pii, histogram, scores)], schema)
    return Curated(train.drop("profile"), held.drop("profile"), tested.drop("profile"), report)


def variant(base: CurationConfig, name: str) -> CurationConfig:
    """Settings of one ablation step; each turns on one more stage than the step before."""
    at = ABLATION.index(name)
    return replace(base, enable_pii_masking=True, enable_decontamination=True, enable_quality_rules=at >= 1, enable_exact_dedup=at >= 2, enable_near_dedup=at >= 2, enable_model_quality=at >= 3)


def ablate(corpus: DataFrame, base: CurationConfig, validation: DataFrame, test: DataFrame | None = None, model: QualityClassifier | None = None, names: tuple[str, ...] = ABLATION) -> DataFrame:
    """(variant, counts) of each step over the same held-out documents, which must not change between steps."""
    from sievewright.operators.lineage import content_hash

    rows, seen = None, None
    for name in names:
        found = curate(corpus, variant(base, name), validation, test, model)
        held = content_hash(found.validation.select("doc_id", "text")).first()["content"]
        if seen not in (None, held):
            raise RuntimeError("held-out documents changed between variants")
        seen = held
        one = found.report.select(F.lit(name).alias("variant"), "raw_documents", "quality_dropped", "model_quality_dropped", "exact_duplicates_dropped", "near_duplicates_dropped", "decontaminated_documents_dropped", "train_documents")
        rows = one if rows is None else rows.unionByName(one)
    return rows
