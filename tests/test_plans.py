import json

import pytest
from pyspark.sql import functions as F

from sievewright.config import ABLATION, CurationConfig, ProjectConfig, ScheduleConfig
from sievewright.operators.classifier import QualityClassifier
from sievewright.operators.lineage import check_contract, content_hash, contract, write_contract
from sievewright.plans import audit
from sievewright.plans.curation import ablate, curate
from sievewright.sources import readers, writers
from sievewright.streaming import incremental

LONG = "the river warden carried a ledger across the bridge and nobody in the village asked about it until the following market day in {}"


def corpus(spark, extra=()):
    rows = [(i, LONG.format(w), "a") for i, w in enumerate(["spring", "summer", "autumn"])]
    rows += [(3, rows[0][1].upper() + "!", "a"), (4, "short text", "a"), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22", "a"), (6, None, "b"), (7, "go " * 25, "b"), *extra]
    return spark.createDataFrame(rows, "ord long, text string, source string")


def test_funnel(spark):
    held = spark.createDataFrame([(0, "alpha beta gamma " * 8 + "write to x@y.org", "v")], "ord long, text string, source string")
    bad = (8, "alpha beta gamma " * 8 + "write to a@b.org", "b")
    found = curate(corpus(spark, [bad]), CurationConfig(near_dedup_threshold=0.99), held)
    r = found.report.first()
    assert (r.raw_train_documents, r.quality_dropped, r.exact_duplicates_dropped, r.decontaminated_documents_dropped) == (9, 4, 1, 1)
    assert r.quality_drop_reasons == {"low_alpha_ratio": 1, "repetitive_text": 1, "too_few_words": 2}
    assert r.train_documents == found.train.count() == 3 and r.pii_replacements == {"email": 2, "phone": 0, "ipv4": 0}
    assert sorted(x.ord for x in found.train.collect()) == [0, 1, 2]
    assert all(x.doc_id.startswith("train-source-00000") for x in found.train.collect())
    near = curate(corpus(spark), CurationConfig(near_dedup_threshold=0.6, num_bands=64), held).report.first()
    assert near.near_duplicates_dropped == 2


def test_inner_split_and_model(spark):
    config = CurationConfig(enable_quality_rules=False, enable_exact_dedup=False, enable_near_dedup=False, enable_decontamination=False, enable_model_quality=True)
    model = QualityClassifier(64)
    r = curate(corpus(spark), config, model=model).report.first()
    assert r.validation_documents == 1 and r.train_documents == 7 and r.model_quality_scores.mean == 0.5
    with pytest.raises(ValueError):
        curate(corpus(spark), config)


def test_ablation_keeps_held_out(spark):
    held = spark.createDataFrame([(0, "something else entirely", "v")], "ord long, text string, source string")
    rows = {r.variant: r.train_documents for r in ablate(corpus(spark), CurationConfig(near_dedup_threshold=0.99), held, names=ABLATION[:3]).collect()}
    assert rows == {"raw": 8, "heuristic": 4, "dedup": 3}


def test_config(tmp_path):
    folder = tmp_path / "configs"
    folder.mkdir()
    (folder / "a.toml").write_text('[project]\nname = "x"\n[data]\nmin_words = 5\n[training]\nlr_schedule = "wsd"\nwsd_decay_steps = 10\n')
    config = ProjectConfig.from_toml(folder / "a.toml")
    assert config.data.min_words == 5 and config.root == str(tmp_path) and config.artifact_dir.startswith(str(tmp_path))
    for section in ("model", "generation", "nothing"):
        (folder / "c.toml").write_text(f"[{section}]\nnonsense = 1\n")
        with pytest.raises(ValueError):
            ProjectConfig.from_toml(folder / "c.toml")
    for section in ('[data]\ntest_path = "t"\n', "[data]\nenable_model_quality = true\n", "[training]\nseq_len = 999\n", "[model]\nd_model = 10\n", "[generation]\ntemperature = 0\n"):
        (folder / "c.toml").write_text(section)
        with pytest.raises(ValueError):
            ProjectConfig.from_toml(folder / "c.toml")
    (folder / "b.toml").write_text("[data]\nnonsense = 1\n")
    with pytest.raises(ValueError):
        ProjectConfig.from_toml(folder / "b.toml")
    for bad in (CurationConfig(num_hashes=10, num_bands=3), CurationConfig(validation_fraction=0), ScheduleConfig(lr_schedule="x"), ScheduleConfig(quality_tier_probabilities=(1, 1, 1))):
        with pytest.raises(ValueError):
            bad.validate()


def test_corpus_reader(spark, tmp_path):
    (tmp_path / "b.txt").write_text("third\n")
    (tmp_path / "a.txt").write_text("first line\nsecond line\n \t\n\n\nsecond doc\r\n\r\n\n")
    rows = readers.read_corpus(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.text, r.source) for r in rows] == [(0, "first line\nsecond line", "a.txt"), (1, "second doc", "a.txt"), (2, "third", "b.txt")]


def test_articles_and_delimited(spark):
    text = "\n".join([" = First = ", "", "A @-@ B is here .".replace(" .", "."), " = = Gameplay = = ", "More   detail.", "= Second =", "Other 1 @,@ 000 text."])
    df = spark.createDataFrame([(1, text)], "id long, t string")
    got = readers.articles(readers.lines_of(df, "id", "t"), ["id"]).orderBy("article").collect()
    assert [r.text for r in got] == ["First A-B is here. Gameplay More detail.", "Second Other 1,000 text."]
    parts = spark.createDataFrame([("x<|endoftext|>one\n\nb<|endoftext|>two<|endoftext|>tail",)], "t string")
    assert [s.segment for s in parts.select(readers.delimited(F.col("t")).alias("s")).first().s] == ["one\n\nb", "two"]
    assert parts.select(readers.delimited(F.col("t"), drop_first=False).alias("s")).first().s[0].segment == "x"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "d1", "a, \"b\"\nc"), (0, "d0", "x y")], "ord long, doc_id string, text string")
    writers.write_documents(df, str(tmp_path / "docs"))
    lines = [json.loads(x) for p in sorted((tmp_path / "docs").glob("part*")) for x in p.read_text().splitlines()]
    assert [x["doc_id"] for x in lines] == ["d0", "d1"]
    assert readers.read_documents(spark, str(tmp_path / "docs")).count() == 2
    sheet = df.withColumn("draw", F.col("ord"))
    writers.write_review(sheet, str(tmp_path / "review"), "doc_id", "text")
    writers.write_review(sheet, str(tmp_path / "review"), "doc_id", "text")
    with pytest.raises(ValueError):
        writers.write_review(sheet.limit(1), str(tmp_path / "review"), "doc_id", "text")
    assert readers.read_labels(spark, str(tmp_path / "review")).count() == 2
    counts = writers.corpus_counts(df, "text").first()
    assert (counts.documents, counts.words, counts.characters) == (2, 5, 11)
    writers.write_once(df, str(tmp_path / "once"))
    writers.write_once(df, str(tmp_path / "once"))
    with pytest.raises(ValueError):
        writers.write_once(df.limit(1), str(tmp_path / "once"))
    assert "d" in writers.dataset_card("d", {"train": {"documents": 1, "words": 2}}, 42)


def test_contracts(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string"), spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    assert content_hash(a).first() == content_hash(b).first() and content_hash(a.limit(1)).first() != content_hash(a).first()
    wanted = contract(data="1", seq_len=8)
    write_contract(spark, tmp_path / "c.json", wanted)
    check_contract(spark, tmp_path / "c.json", wanted)
    with pytest.raises(ValueError, match="seq_len"):
        check_contract(spark, tmp_path / "c.json", contract(data="1", seq_len=9))
    writers.write_tokens(a, str(tmp_path / "cache"), wanted)
    assert readers.read_tokens(spark, str(tmp_path / "cache"), wanted).count() == 2


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1, 'a b', 's', timestamp'2024-01-01'), (2, 'a b', 's', timestamp'2024-01-02'), (3, 'mail x@y.org', null, timestamp'2024-01-03') AS t(doc_id, text, source, ingested_at)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.document_stream(spark, str(tmp_path / "in"), rows.schema)
    query = incremental.masked(incremental.first_seen(stream, "text", "ingested_at"), "text").writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("seen").collect()
    assert len(got) == 2 and any(r.pii_replacements["email"] == 1 for r in got)


def test_length_balanced_audit(spark):
    rows = [(i, f"d{i}", 20 + (i * 7) % 90, (i * 37 % 120) / 120, (i * 37 % 120) // 40, 100 + i) for i in range(120)]
    df = spark.createDataFrame(rows, "ord long, doc_id string, n_tokens long, score double, tier int, utf8_bytes int")
    tables = audit.length_balanced_audit(df, 10, 2, 3, df.select("score"))
    tiers = {(r.policy, r.tier): r for r in tables["tiers"].collect()}
    assert len(tiers) == 6 and all(abs(tiers["candidate_tier", k].window_fraction - 1 / 3) < 0.05 for k in range(3))
    assert tables["sample"].count() == 24 and tables["lengths_candidate"].count() == 4
    assert sum(tables["bands"].first()) == 120 and abs(tables["correlation"].first()[0]) <= 1
    ids = [r.doc_id for r in tables["sample"].collect()]
    sheet = spark.createDataFrame([(d, str(i % 3)) for i, d in enumerate(ids)], "doc_id string, human_label string")
    assert sum(r.labeled for r in audit.reviewed(tables, sheet).collect()) == 48
    with pytest.raises(Exception, match="do not fit"):
        audit.length_balanced_audit(df.withColumn("valid_windows", F.lit(1).cast("long")), 10, 2, 3)
    with pytest.raises(Exception, match="too few"):
        audit.length_balanced_audit(df, 10, 50, 3)["sample"].collect()


def test_take_characters(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "defg"), (3, "hi")], "o long, t string")
    kept, manifest = readers.take_characters(df, ["o"], "t", 5)
    assert sorted(r.o for r in kept.collect()) == [1, 2] and manifest.first().characters == 7 and manifest.first().rows == 2
    with pytest.raises(ValueError):
        readers.take_characters(df, ["o"], "t", 99)
