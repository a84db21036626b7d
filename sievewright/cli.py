"""Command line: python -m sievewright.cli VERB ...; every verb prints one JSON object with sorted keys."""

from __future__ import annotations

import argparse
import importlib
import json
import platform
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright import __version__, schema, storage
from sievewright.config import ABLATION, ProjectConfig
from sievewright.functions.quality import prose_features
from sievewright.functions.text import canonical_story
from sievewright.operators import bpe, likelihood, reports, spans, splits
from sievewright.operators.classifier import QualityClassifier, train_classifier
from sievewright.operators.lineage import check_contract, content_hash, contract, run_fingerprint, sha256_tree, write_contract
from sievewright.operators.ordered import budget_prefix
from sievewright.plans.curation import ablate, curate
from sievewright.session import build_session, cut
from sievewright.sources import readers, writers


def _row(df: DataFrame) -> dict:
    return json.loads(df.toJSON().first())


def _model(spark: SparkSession, config: ProjectConfig) -> tuple[QualityClassifier, dict] | tuple[None, None]:
    d = config.data
    if not d.enable_model_quality:
        return None, None
    return _fitted(spark, config)


def _fitted(spark: SparkSession, config: ProjectConfig) -> tuple[QualityClassifier, dict]:
    d = config.data
    return train_classifier(readers.read_examples(spark, config.path(d.quality_seed_path)), d.quality_hash_dim, d.quality_epochs, d.quality_learning_rate, d.quality_threshold)


def _corpora(spark: SparkSession, config: ProjectConfig) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    d = config.data
    read = lambda p: readers.read_corpus(spark, config.path(p)) if p else None
    return read(d.input_path), read(d.validation_path), read(d.test_path)


def _content(df: DataFrame) -> str:
    return content_hash(df).first()["content"]


def prepare(spark: SparkSession, config: ProjectConfig) -> dict:
    """Curates the corpora once; a second call with the same inputs reuses the result, with others it is an error."""
    folder = f"{config.artifact_dir}/dataset"
    train, validation, test = _corpora(spark, config)
    inputs = {name: _content(df) for name, df in (("train", train), ("validation", validation), ("test", test)) if df is not None}
    seeds = _content(readers.read_examples(spark, config.path(config.data.quality_seed_path))) if config.data.enable_model_quality else None
    wanted = contract(config=config.as_dict()["data"], inputs=inputs, seeds=seeds, version=__version__)
    if storage.exists(spark, f"{folder}/contract.json"):
        stored = check_contract(spark, f"{folder}/contract.json", wanted)
        for name, content in stored["splits"].items():
            if _content(readers.read_documents(spark, f"{folder}/{name}")) != content:
                raise ValueError(f"the prepared {name} split was changed after it was written")
        return json.loads(storage.read_text(spark, f"{folder}/manifest.json"))
    model, quality = _model(spark, config)
    found = curate(train, config.data, validation, test, model)
    splits_made = {}
    for name in ("train", "validation", "test"):
        part = getattr(found, name)
        if name != "test" or test is not None:
            writers.write_documents(part, f"{folder}/{name}")
            splits_made[name] = _content(readers.read_documents(spark, f"{folder}/{name}"))
    if model is not None:
        storage.write_text(spark, f"{config.artifact_dir}/quality_model.json", model.dumps(quality))
    report = writers.write_manifest(found.report, f"{folder}/manifest.json", quality_model=quality, splits=splits_made)
    write_contract(spark, f"{folder}/contract.json", wanted, splits=splits_made)
    return report


def _split_rows(spark: SparkSession, config: ProjectConfig, name: str = "train") -> DataFrame:
    number = F.regexp_extract("doc_id", r"-(\d+)-", 1).cast("bigint")
    return readers.read_documents(spark, f"{config.artifact_dir}/dataset/{name}").withColumn("ord", number)


def _merges(spark: SparkSession, config: ProjectConfig) -> list[tuple[int, int]]:
    return bpe.loads(storage.read_text(spark, f"{config.artifact_dir}/tokenizer.json"))


def _cache_contract(spark: SparkSession, config: ProjectConfig) -> dict:
    return contract(train=_content(_split_rows(spark, config)), validation=_content(_split_rows(spark, config, "validation")), tokenizer=storage.read_text(spark, f"{config.artifact_dir}/tokenizer.json"), seq_len=config.training.seq_len, version=__version__)


def experiment(spark: SparkSession, config: ProjectConfig) -> dict:
    """Data, vocabulary and token spans with tiers, each guarded by its contract, and the fingerprint; ends before any model."""
    data = prepare(spark, config)
    rows = cut(_split_rows(spark, config))
    place = f"{config.artifact_dir}/tokenizer.json"
    if not storage.exists(spark, place):
        text = budget_prefix(rows, ["ord"], F.length("text"), config.tokenizer.max_training_characters, "text")
        storage.write_text(spark, place, bpe.dumps(bpe.train(text, "text", config.tokenizer.vocab_size)))
    merges, folder = _merges(spark, config), f"{config.artifact_dir}/tokens"
    wanted = _cache_contract(spark, config)
    if not storage.exists(spark, f"{folder}/contract.json"):
        encoded = bpe.encode(rows, "text", merges, "tokens", add_eos=True).withColumn("n_tokens", F.size("tokens").cast("bigint")).withColumn("score", prose_features(F.col("text"))["score"])
        placed = spans.span_offsets(encoded.select("ord", "doc_id", "tokens", "n_tokens", "score"), "n_tokens", ["ord"])
        writers.write_tokens(_tiered(placed, config), folder, wanted)
    cached = readers.read_tokens(spark, folder, wanted)
    every = config.as_dict()
    model = f"{config.artifact_dir}/quality_model.json"
    quality = storage.read_text(spark, model) if storage.exists(spark, model) else None
    found = run_fingerprint(config.seed, data["splits"], storage.read_text(spark, place), every["model"], every["training"], quality, sha256_tree(Path(__file__).parent))
    storage.write_text(spark, f"{config.artifact_dir}/run_fingerprint.json", json.dumps(found, indent=2, sort_keys=True) + "\n")
    totals = cached.agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")).first()
    return {"data": data, "tokens": totals["tokens"], "documents": totals["documents"], "vocabulary": len(merges) + bpe.FIRST_MERGE, "fingerprint_id": found["fingerprint_id"]}


def _tiered(df: DataFrame, config: ProjectConfig) -> DataFrame:
    seq_len = config.training.seq_len
    if config.training.sampling_policy == "quality_tier_length_balanced":
        return spans.length_balanced_tiers(df, "n_tokens", "score", "ord", seq_len)
    return spans.quality_tiers(df, "n_tokens", "score", "ord", seq_len)


def _scorer(spark: SparkSession, config: ProjectConfig, named: str | None):
    """The scorer `module:name`, called with the session and the configuration, or bigrams of the train split."""
    if named:
        module, _, name = named.partition(":")
        return getattr(importlib.import_module(module), name)(spark, config)
    merges = _merges(spark, config)
    tokens = bpe.encode(_split_rows(spark, config), "text", merges, "tokens", add_eos=True)
    return likelihood.fit_ngrams(tokens, "tokens", len(merges) + bpe.FIRST_MERGE)


def evaluation(spark: SparkSession, config: ProjectConfig, rows: DataFrame, split: str, scorer, full: bool, stride: int | None) -> dict:
    """Loss of a scorer on documents (doc_id, text): over all tokens once in rolling windows, or over random windows."""
    seq_len = config.training.seq_len
    stride = max(1, seq_len // 2) if stride is None else stride
    if not 1 <= stride <= seq_len:
        raise ValueError("stride must lie in [1, seq_len]")
    encoded = cut(bpe.encode(rows.select("doc_id", "text"), "text", _merges(spark, config), "tokens", add_eos=True))
    if encoded.agg(F.sum(F.octet_length("text"))).first()[0] in (None, 0):
        raise ValueError("the evaluation corpus has no text")
    if full:
        found = likelihood.evaluate(encoded, "doc_id", "text", "tokens", scorer, seq_len, stride)
    else:
        found = likelihood.evaluate_windows(encoded, "doc_id", "tokens", scorer, seq_len, config.training.eval_batches * config.training.batch_size, config.seed)
    more = {"split": split, "evaluation_mode": "full_corpus" if full else "random_windows", "stride": stride if full else None, "seq_len": seq_len, "documents": encoded.count(), "dataset_content": _content(rows.select("doc_id", "text"))}
    return writers.write_manifest(found, f"{config.artifact_dir}/evaluation_{split}_{'full' if full else 'windows'}.json", **more)


def run_all(spark: SparkSession, config: ProjectConfig, scorer: str | None) -> dict:
    """Data, vocabulary, spans, drawn windows by the sampling policy, and the evaluation of a scorer; no training."""
    made = experiment(spark, config)
    t = config.training
    drawn = spans.draw_windows(readers.read_tokens(spark, f"{config.artifact_dir}/tokens", _cache_contract(spark, config)), "doc_id", "n_tokens", "tier", "ord", t.batch_size * t.gradient_accumulation_steps * t.steps, t.seq_len, t.sampling_policy, t.quality_tier_probabilities, config.seed)
    counts = {str(r["tier"]): r["draws"] for r in spans.draw_counts(drawn).orderBy("tier").collect()}
    report = evaluation(spark, config, _split_rows(spark, config, "validation"), "validation", _scorer(spark, config, scorer), True, None)
    summary = {**made, "draws_by_tier": counts, "validation": report}
    storage.write_text(spark, f"{config.artifact_dir}/summary.json", json.dumps(summary, indent=2, sort_keys=True, default=str) + "\n")
    return summary


def audit(spark: SparkSession, config: ProjectConfig, per_tier: int, seed: int, labels: str | None) -> dict:
    """Tier statistics with the means of the prose features, a blinded sample and, with a filled sheet, mean labels by tier."""
    tokens = spark.read.parquet(f"{config.artifact_dir}/tokens/spans")
    texts = _split_rows(spark, config).select("ord", "text")
    joined = tokens.drop("text").join(texts, "ord").withColumn("w", spans.valid_starts(F.col("n_tokens"), config.training.seq_len))
    if joined.count() != tokens.count() or texts.count() != tokens.count():
        raise ValueError("documents and spans differ in number")
    found = prose_features(F.col("text"))
    stats = reports.tier_statistics(joined.withColumns({f: found[f] for f in reports.FEATURES}), "tier", "w", "score", {"utf8_bytes": F.octet_length("text"), **{f: F.col(f) for f in reports.FEATURES}})
    sample = splits.sample_per_group(joined.filter("tier >= 0"), ["tier"], "doc_id", per_tier, seed)
    writers.write_review(sample, f"{config.artifact_dir}/quality_audit_samples", "doc_id", "text")
    out = {"tiers": {spans.TIERS[r["tier"]]: r.asDict() for r in stats.collect()}, "sample_seed": seed}
    if labels:
        known = joined.select("doc_id", "tier")
        marked = reports.checked_labels(readers.read_labels(spark, labels), known, "doc_id", "human_label")
        out["human_labels"] = [r.asDict() for r in reports.label_means(spark, known, marked, "doc_id", ["tier"]).collect()]
    storage.write_text(spark, f"{config.artifact_dir}/quality_audit.json", json.dumps(out, indent=2, sort_keys=True, default=str) + "\n")
    return out


def retier(spark: SparkSession, config: ProjectConfig) -> dict:
    """New scores and tiers over the same spans. Refused once checkpoints exist or if data, vocabulary, length or the cache
    itself changed; old audits are put aside and the contract says from which cache this one comes."""
    root = config.artifact_dir
    if storage.any_match(spark, f"{root}/checkpoint*"):
        raise ValueError("tiers cannot change after a checkpoint exists")
    wanted = _cache_contract(spark, config)
    before = json.loads(storage.read_text(spark, f"{root}/tokens/contract.json"))["cache_content"]
    old = cut(readers.read_tokens(spark, f"{root}/tokens", wanted))
    bounds = old.agg(F.max("span_end").alias("end"), F.sum("n_tokens").alias("tokens"), F.sum(F.size("tokens")).alias("held")).first()
    if not bounds["end"] == bounds["tokens"] == bounds["held"]:
        raise ValueError("the spans do not cover the token stream")
    texts = _split_rows(spark, config).select("ord", prose_features(F.col("text"))["score"].alias("score"))
    scored = cut(_tiered(old.drop("tier", "length_stratum", "score").join(texts, "ord"), config))
    if not scored.count() == old.count() == texts.count():
        raise ValueError("documents and spans differ in number")
    for name in ("quality_audit.json", "quality_audit_samples"):
        if storage.exists(spark, f"{root}/{name}"):
            storage.move(spark, f"{root}/{name}", f"{root}/{name}.before_retier")
    scored.write.mode("errorifexists").parquet(f"{root}/tokens/spans.new")
    storage.move(spark, f"{root}/tokens/spans", f"{root}/tokens/spans.{before[:12]}")
    storage.move(spark, f"{root}/tokens/spans.new", f"{root}/tokens/spans")
    after = writers.seal_tokens(spark, f"{root}/tokens", wanted, retiered_from=before)
    tiers = {spans.TIERS[r["tier"]]: r["n"] for r in scored.filter("tier >= 0").groupBy("tier").agg(F.count("*").alias("n")).collect()}
    return {"documents": scored.count(), "train_tokens": bounds["tokens"], "old_cache": before, "new_cache": after, "tier_documents": tiers, "status": "rescored_before_training"}


def stories(spark: SparkSession, path: str, out: str, seed: int) -> dict:
    """Delimited stories, of one file or many, into three splits with a manifest."""
    rows = cut(readers.read_delimited(spark, path).select("ord", canonical_story(F.col("segment")).alias("text")))
    totals = rows.agg(F.count("*").alias("n"), F.count_if(F.col("text") == "").alias("empty")).first()
    split = cut(splits.three_way(rows, "text", "ord", seed=seed))
    counts = {r["split"]: r.asDict() for r in writers.text_manifest(split, by=("split",)).collect()}
    for name in counts:
        writers.write_texts(split.filter(F.col("split") == name), f"{out}/{name}")
    overlap = splits.split_overlap(split, "split", F.sha2("text", 256)).first().asDict()
    storage.write_text(spark, f"{out}/README.md", writers.dataset_card(path.rstrip("/").split("/")[-1], counts, seed))
    kept = sum(c["documents"] for c in counts.values())
    report = {"seed": seed, "source": path, "delimiter": readers.DELIMITER, "segments": totals["n"], "empty": totals["empty"], "exact_duplicates_removed": totals["n"] - totals["empty"] - kept, "splits": counts, "exact_cross_split_overlap": overlap}
    storage.write_text(spark, f"{out}/manifest.json", json.dumps(report, indent=2, sort_keys=True) + "\n")
    return report


def wiki(spark: SparkSession, path: str, out: str, min_chars: int) -> dict:
    """Articles of at least `min_chars` characters from heading-delimited lines of one file or many. A second call with
    the same source is checked against the manifest of the first."""
    source = _content(readers.numbered(spark, path).select(F.substring_index("file", "/", -1).alias("file"), "line_no", "line"))
    if storage.exists(spark, f"{out}/manifest.json"):
        found = json.loads(storage.read_text(spark, f"{out}/manifest.json"))
        if (found["source_content"], found["min_document_chars"]) != (source, min_chars):
            raise ValueError("the output comes from another source or length")
        return found
    rows = cut(readers.read_articles(spark, path).filter(F.length("text") >= min_chars))
    if rows.isEmpty():
        raise ValueError("no article is long enough")
    writers.write_texts(rows, f"{out}/texts")
    return writers.write_manifest(writers.text_manifest(rows), f"{out}/manifest.json", source_content=source, min_document_chars=min_chars)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sievewright", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    configured = {
        "doctor": "check a configuration", "prepare-data": "curate the corpora", "prepare-experiment": "data, vocabulary and spans", "run": "data to evaluation of a scorer", "train-quality": "fit the quality classifier", "retier-quality": "rescore cached spans", "ablate-data": "compare curation variants",
        "audit-tokenizer": "compare vocabulary sizes", "audit-quality": "tier statistics and a blinded sample", "evaluate": "loss of a scorer on the validation split", "test": "loss of a scorer on all of the test split", "evaluate-external": "loss of a scorer on other documents",
    }
    made = {}
    for name, text in configured.items():
        made[name] = verbs.add_parser(name, help=text)
        made[name].add_argument("--config", required=True)
    made["audit-tokenizer"].add_argument("--vocab-sizes", "--sizes", dest="sizes", type=int, nargs="+", default=[512, 1024])
    made["audit-tokenizer"].add_argument("--max-training-characters", type=int, default=None)
    made["audit-quality"].add_argument("--sample-per-tier", "--per-tier", dest="per_tier", type=int, default=20)
    made["audit-quality"].add_argument("--seed", type=int, default=42)
    made["audit-quality"].add_argument("--labels")
    for name in ("run", "evaluate", "test", "evaluate-external"):
        made[name].add_argument("--scorer", help="module:name, called with (spark, config); bigrams of the train split if left out")
    for name in ("evaluate", "test", "evaluate-external"):
        made[name].add_argument("--stride", type=int, default=None)
    made["evaluate"].add_argument("--full-corpus", action="store_true")
    made["evaluate-external"].add_argument("--jsonl", required=True)
    one = verbs.add_parser("split-stories", help="split delimited stories")
    one.add_argument("--input", required=True)
    one.add_argument("--output", required=True)
    one.add_argument("--seed", type=int, default=42)
    one = verbs.add_parser("prepare-wikitext", help="articles from headed lines")
    one.add_argument("--raw-dir", "--input", dest="input", required=True)
    one.add_argument("--output-dir", "--output", dest="output", required=True)
    one.add_argument("--min-document-chars", "--min-chars", dest="min_chars", type=int, default=200)
    one = verbs.add_parser("fit-scaling", help="power laws from run records")
    one.add_argument("--runs", required=True)
    one.add_argument("--target-compute", "--budget", dest="budget", type=float)
    one = verbs.add_parser("summarize-seeds", help="statistics of repeated comparisons")
    one.add_argument("--comparisons", "--reports", dest="reports", nargs="+", required=True)
    one.add_argument("--controls", nargs="*", default=["data"])
    one = verbs.add_parser("compare-sampling", help="compare two run reports")
    one.add_argument("--first", required=True)
    one.add_argument("--second", required=True)
    one.add_argument("--controls", nargs="*", default=["data"])
    return top


def _needs_config(spark: SparkSession, args: argparse.Namespace, config: ProjectConfig) -> dict:
    verb = args.verb
    if verb == "doctor":
        return {"config": config.as_dict(), "python": platform.python_version(), "spark": spark.version}
    if verb == "prepare-data":
        return prepare(spark, config)
    if verb == "prepare-experiment":
        return experiment(spark, config)
    if verb == "run":
        return run_all(spark, config, args.scorer)
    if verb == "train-quality":
        model, report = _fitted(spark, config)
        storage.write_text(spark, f"{config.artifact_dir}/quality_model.json", model.dumps(report))
        return report
    if verb == "retier-quality":
        return retier(spark, config)
    if verb == "ablate-data":
        train, validation, test = _corpora(spark, config)
        model = _fitted(spark, config)[0] if config.data.quality_seed_path else None
        names = ABLATION if model else ABLATION[:3]
        return {"variants": [r.asDict() for r in ablate(train, config.data, validation, test, model, names).collect()]}
    if verb == "audit-tokenizer":
        limit = config.tokenizer.max_training_characters if args.max_training_characters is None else args.max_training_characters
        rows = budget_prefix(_split_rows(spark, config), ["ord"], F.length("text"), limit, "text")
        return {"sizes": [r.asDict() for r in bpe.vocabulary_sweep(cut(rows), "text", args.sizes).collect()]}
    if verb == "audit-quality":
        return audit(spark, config, args.per_tier, args.seed, args.labels)
    scorer = _scorer(spark, config, args.scorer)
    if verb == "evaluate-external":
        return evaluation(spark, config, readers.read_documents(spark, args.jsonl), "external", scorer, True, args.stride)
    if verb == "test":
        return evaluation(spark, config, _split_rows(spark, config, "test"), "test", scorer, True, args.stride)
    return evaluation(spark, config, _split_rows(spark, config, "validation"), "validation", scorer, args.full_corpus, args.stride)


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    if getattr(args, "config", None):
        return _needs_config(spark, args, ProjectConfig.from_toml(args.config))
    if args.verb == "split-stories":
        return stories(spark, args.input, args.output, args.seed)
    if args.verb == "prepare-wikitext":
        return wiki(spark, args.input, args.output, args.min_chars)
    if args.verb == "fit-scaling":
        fit = reports.scaling_fit(readers.read_reports(spark, args.runs, schema.SCALING_RUN))
        return _row(fit) | ({"prediction": _row(reports.predict(fit, args.budget))} if args.budget else {})
    if args.verb == "summarize-seeds":
        found = reports.check_seeds(readers.read_reports(spark, args.reports), "seed", args.controls)
        return _row(reports.seed_summary(found, "relative_change"))
    return _row(reports.compare_runs(readers.read_reports(spark, args.first), readers.read_reports(spark, args.second), args.controls))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    print(json.dumps(run(build_session("sievewright"), args), indent=2, sort_keys=True, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
