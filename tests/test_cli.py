import json
import shutil

import numpy as np
import pytest

from sievewright import cli
from sievewright.sources import readers


def call(spark, *argv):
    return json.loads(json.dumps(cli.run(spark, cli.parser().parse_args(list(argv))), default=str))


def test_verbs(spark, tmp_path):
    docs = [f"The warden of {w} carried one ledger across the bridge, and nobody there asked about it until market day number {i}." for i, w in enumerate(["Ash", "Birch", "Cedar", "Doum", "Elm", "Fir"])]
    (tmp_path / "train.txt").write_text("\n\n".join(docs + [docs[0], "too short"]))
    (tmp_path / "val.txt").write_text("Something else is written here for validation.")
    (tmp_path / "test.txt").write_text("The last words are kept for the test, and nobody may look at them before the very end of it all.")
    (tmp_path / "seed.jsonl").write_text("\n".join(json.dumps({"text": f"fine text {i}" if i % 2 else f"$$$ {i}", "label": i % 2}) for i in range(12)))
    (tmp_path / "configs").mkdir()
    path = tmp_path / "configs/c.toml"
    path.write_text('[project]\noutput_dir = "out"\n[data]\ninput_path = "train.txt"\nvalidation_path = "val.txt"\ntest_path = "test.txt"\nquality_seed_path = "seed.jsonl"\nmin_words = 5\nenable_near_dedup = false\nquality_hash_dim = 64\n[tokenizer]\nvocab_size = 270\n[training]\nseq_len = 16\nsteps = 4\nbatch_size = 2\nwarmup_steps = 1\nsampling_policy = "quality_tier"\nquality_tier_probabilities = [0.2, 0.3, 0.5]\n[model]\nd_model = 64\nmax_seq_len = 64\n[generation]\ntop_k = 5\n')
    c = ("--config", str(path))
    assert call(spark, "doctor", *c)["config"]["data"]["min_words"] == 5
    report = call(spark, "prepare-data", *c)
    assert (report["train_documents"], report["exact_duplicates_dropped"], report["quality_dropped"]) == (6, 1, 1)
    assert call(spark, "prepare-data", *c) == report
    made = call(spark, "prepare-experiment", *c)
    assert made["documents"] == 6 and made["vocabulary"] == 270 and made["tokens"] > 6 * 16
    assert made["fingerprint_id"] == call(spark, "prepare-experiment", *c)["fingerprint_id"]
    tiers = call(spark, "audit-quality", *c, "--per-tier", "1")["tiers"]
    assert set(tiers) <= {"low", "medium", "high"} and all(0 < t["mean_unique_word_ratio"] <= 1 for t in tiers.values())
    again = call(spark, "retier-quality", *c)
    assert again["documents"] == 6 and again["old_cache"] == again["new_cache"] and (tmp_path / "out/quality_audit.json.before_retier").exists()
    assert json.loads((tmp_path / "out/tokens/contract.json").read_text())["retiered_from"] == again["old_cache"]
    whole = call(spark, "evaluate", *c, "--full-corpus", "--stride", "4")
    assert whole["evaluation_mode"] == "full_corpus" and whole["tokens"] > 10 and whole["documents"] == 1
    assert call(spark, "evaluate", *c)["windows"] == 20
    assert call(spark, "test", *c)["split"] == "test"
    assert call(spark, "evaluate-external", *c, "--jsonl", str(tmp_path / "out/dataset/test"))["tokens"] == call(spark, "test", *c)["tokens"]
    summary = call(spark, "run", *c, "--scorer", "tests.test_cli:flat")
    assert abs(summary["validation"]["loss"] - 2.0) < 1e-9 and sum(summary["draws_by_tier"].values()) == 8
    assert [r["vocab_size"] for r in call(spark, "audit-tokenizer", *c, "--sizes", "258", "262")["sizes"]] == [258, 262]
    assert call(spark, "train-quality", *c)["validation_examples"] == 4
    assert len(call(spark, "ablate-data", *c)["variants"]) == 4
    part = next((tmp_path / "out/tokens/spans").glob("part-*.parquet"))
    shutil.copy(part, part.with_name("part-again.parquet"))
    for verb in ("retier-quality", "prepare-experiment"):
        with pytest.raises(ValueError, match="changed"):
            call(spark, verb, *c)
    (tmp_path / "train.txt").write_text("another corpus")
    with pytest.raises(ValueError, match="inputs"):
        call(spark, "prepare-data", *c)


def flat(spark, config):
    return lambda window, first, end: np.full(end - first, -2.0)


def test_several_files(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"w{n}.txt").write_text(f" = Title {n} = \n\n first {n} \n = = Part = = \n second {n}\n = Other {n} = \n third\n")
        (tmp_path / f"s{n}.txt").write_text(f"cut<|endoftext|>one {n}\n\nb<|endoftext|>two {n}<|endoftext|>" + ("tail" if n else ""))
    rows = readers.read_articles(spark, str(tmp_path / "w*.txt")).orderBy("ord").collect()
    assert [r.text for r in rows] == [x for n in range(2) for x in (f"Title {n} first {n} Part second {n}", f"Other {n} third")]
    told = readers.read_delimited(spark, str(tmp_path / "s*.txt")).orderBy("ord").collect()
    assert [(r.ord, r.segment) for r in told] == [(0, "one 0\n\nb"), (1, "two 0"), (2, "one 1\n\nb"), (3, "two 1")]
    assert readers.read_delimited(spark, str(tmp_path / "s*.txt"), drop_first=False).count() == 6


def test_story_and_article_verbs(spark, tmp_path):
    (tmp_path / "s.txt").write_text("cut<|endoftext|>" + "<|endoftext|>".join(f"Story {i % 11}.\n\nEnd." for i in range(12)) + "<|endoftext|>rest")
    got = call(spark, "split-stories", "--input", str(tmp_path / "s.txt"), "--output", str(tmp_path / "out"))
    assert sum(v["documents"] for v in got["splits"].values()) == 11 and set(got["exact_cross_split_overlap"].values()) == {0}
    (tmp_path / "w.txt").write_text(" = One = \n\n" + "word " * 60 + "\n = Two = \n\nshort\n")
    assert call(spark, "prepare-wikitext", "--input", str(tmp_path / "w.txt"), "--output", str(tmp_path / "w"))["documents"] == 1
    again = ("prepare-wikitext", "--raw-dir", str(tmp_path / "w.txt"), "--output-dir", str(tmp_path / "w"))
    assert call(spark, *again)["documents"] == 1
    with pytest.raises(ValueError, match="another source"):
        call(spark, *again, "--min-document-chars", "5")


def test_report_verbs(spark, tmp_path):
    (tmp_path / "runs.json").write_text(json.dumps([{"compute_budget": c * 1e12, "parameters": p * 1e6, "final_loss": 2.0 + abs(p - b)} for c, b in ((1, 4), (4, 8), (16, 16)) for p in (4, 8, 16)]))
    assert abs(call(spark, "fit-scaling", "--runs", str(tmp_path / "runs.json"), "--budget", "6.4e13")["prediction"]["predicted_parameters"] - 32e6) < 1
    for i, change in enumerate((-0.1, 0.2)):
        (tmp_path / f"r{i}.json").write_text(json.dumps({"seed": i, "data": "x", "relative_change": change, "loss": 2.0 - i, "perplexity": 8.0 - i}))
    files = [str(tmp_path / f"r{i}.json") for i in range(2)]
    assert call(spark, "summarize-seeds", "--reports", *files)["improved_runs"] == 1
    assert call(spark, "compare-sampling", "--first", files[0], "--second", files[1])["selected"] == "second"
