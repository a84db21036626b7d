import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as tx
from sievewright.operators import bpe, likelihood, reports, spans, splits
from sievewright.operators.classifier import QualityClassifier, check_examples, class_weights, classifier_metrics, features, train_classifier
from sievewright.operators.components import connected_components
from sievewright.operators.decontam import decontaminate
from sievewright.operators.dedup import exact_dedup, near_dedup, near_duplicates, signature
from sievewright.operators.ordered import budget_prefix, completed, global_rank, keep_first, paired, prefix_sum


def units(spark, rows, names="doc_id long, text string"):
    df = spark.createDataFrame(rows, names).withColumn("profile", tx.unit_profile(2)("text"))
    return df.withColumn("shingles", F.col("profile.shingles"))


@pytest.mark.parametrize(("cell", "rows"), [(4096, 10**6), (3, 10**6), (3, 0)])
def test_pairs_of_hot_keys(spark, cell, rows, monkeypatch):
    """A key of 40 rows, small keys and rows of their own: cells and salts give each pair once."""
    from sievewright.operators import joins

    monkeypatch.setattr(joins.met, "__defaults__", ("inner", rows))
    data = [(i, 7, i % 5) for i in range(40)] + [(i, 100 + i // 2, 0) for i in range(50, 60)] + [(i, i + 1000, 0) for i in range(60, 70)] + [(3, 7, 3), (70, None, 0), (71, None, 0)]
    df = spark.createDataFrame(data, "id long, k long, c int").repartition(5)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40)} | {(i, i + 1) for i in range(50, 60, 2)}
    got = [(r.a, r.b) for r in joins.bucket_pairs(df, "k", "id", cell=cell).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    alike = {(r.a, r.b) for r in joins.bucket_pairs(df, "k", "id", ("c",), lambda x, y: x["c"] == y["c"], cell).collect()}
    assert alike == {(i, j) for i, j in want if i >= 50 or i % 5 == j % 5}
    assert joins.bucket_pairs(df.limit(0), "k", "id").count() == 0


def test_prefix_sums_and_ranks(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 3), rnd.randint(0, 9), rnd.choice([None, 1, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g int, k int, v long").repartition(7)
    got = {r.id: r.s for r in prefix_sum(df, ["k", "id"], "v", "s", ("g",)).collect()}
    for i, g, k, _ in rows:
        assert got[i] == sum(v or 0 for j, h, m, v in rows if h == g and (m, j) < (k, i))
    order = [r.id for r in global_rank(df, ["k", "id"], "r").orderBy("r").collect()]
    assert order == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert prefix_sum(df.limit(0), ["id"], "v", "s").count() == 0


def test_budget_prefix_cuts_the_last(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "efgh"), (3, "ij")], "o long, t string")
    assert [r.t for r in budget_prefix(df, ["o"], F.length("t"), 6, "t").orderBy("o").collect()] == ["abcd", "ef"]
    assert budget_prefix(df, ["o"], F.length("t"), 0).count() == 3


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "b")], "o long, k string")
    assert sorted(r.o for r in keep_first(df, [F.col("k")], ["o"]).collect()) == [1, 2, 4]


def test_components_of_random_graphs(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(80)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (1, 2), (1, 2)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup_keeps_the_first(spark):
    df = units(spark, [(2, "Hello, World"), (1, "hello world!"), (3, "…"), (4, "…"), (5, ""), (6, None)])
    assert sorted(r.doc_id for r in exact_dedup(df, "text", "profile", ["doc_id"]).collect()) == [1, 3, 5]


def test_near_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, base), (2, base.replace("today", "tonight")), (3, "completely different words stand in this other sentence here"), (4, base), (5, ""), (6, None)]
    df = units(spark, rows)
    assert sorted(r.doc_id for r in near_dedup(df, "shingles", "doc_id", 0.45, 32, 32).collect()) == [1, 3, 5, 6]
    found = {r.doc_id: (r.root, r.links) for r in near_duplicates(df, "shingles", "doc_id", 0.45, 32, 32).collect()}
    assert {k: v[0] for k, v in found.items()} == {1: 1, 2: 1, 4: 1} and all(v[1] >= 1 for v in found.values())
    with pytest.raises(ValueError):
        near_dedup(df, "shingles", "doc_id", 0.5, 10, 3)


def test_signatures_of_many_sets():
    import numpy as np

    from sievewright.operators.dedup import coefficients, signatures

    sets = [[5, 9, 2**63 + 1], [], [7]]
    flat, offsets = np.array([x for s in sets for x in s], np.uint64), np.array([0, 3, 3, 4])
    a, b = (c.tolist() for c in coefficients(4))
    want = [[min(((x * a[i] + b[i]) % 2**64 for x in s), default=0) for i in range(4)] for s in sets]
    assert signatures(flat, offsets, 4).tolist() == want


def test_signatures_do_not_depend_on_order():
    a, b = signature(["x", "y", "z"], 16), signature(["z", "x", "y"], 16)
    assert (a == b).all() and signature([], 4).tolist() == [0, 0, 0, 0]


def test_decontamination(spark):
    train = units(spark, [(1, "alpha beta gamma delta epsilon"), (2, "another text about rivers and boats"), (3, "")])
    held = units(spark, [(9, "alpha beta gamma delta epsilon")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate(train, held, threshold=0.8).collect()) == [2, 3]
    assert decontaminate(train, held.limit(0), threshold=0.0).count() == 3
    assert decontaminate(train, held, threshold=0.0).count() == 0
    blank = units(spark, [(9, "")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate(train, blank, threshold=0.8).collect()) == [1, 2]


def test_max_similarity_by_salted_index(spark):
    from sievewright.operators.decontam import max_similarity

    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 9)))
    train, held = units(spark, [(i, text()) for i in range(60)] + [(60, ""), (61, None)]), units(spark, [(i, text()) for i in range(12)] + [(12, "")], "item_id long, text string")
    sets, other = {r.doc_id: set(r.shingles) for r in train.collect()}, [set(r.shingles) for r in held.collect()]
    want = {i: max(len(s & o) / len(s | o) if s | o else 1.0 for o in other) for i, s in sets.items()}
    for rows in (10**6, 0):
        assert {r.doc_id: r.best for r in max_similarity(train, held, "doc_id", "item_id", "shingles", rows=rows).collect()} == want


def test_three_way_split(spark):
    rows = [(i, f"story {i % 40}") for i in range(60)] + [(99, "")]
    df = spark.createDataFrame(rows, "o long, t string")
    got = {r.o: r.split for r in splits.three_way(df.repartition(5), "t", "o").collect()}
    again = {r.o: r.split for r in splits.three_way(df.repartition(2), "t", "o").collect()}
    assert got == again and set(got) == set(range(40))
    assert sorted(got.values()).count("test") == 2 and list(got.values()).count("validation") == 2
    with pytest.raises(ValueError):
        splits.three_way(df, "t", "o", (0.5, 0.5, 0.5))


def test_hold_out_and_samples(spark):
    df = spark.createDataFrame([(f"d{i}", "ab"[i % 2]) for i in range(25)], "id string, g string")
    assert splits.hold_out(df, "id", 0.1).filter("split = 'validation'").count() == 2
    with pytest.raises(ValueError):
        splits.hold_out(df.limit(1), "id", 0.5)
    a = splits.sample_per_group(df.repartition(6), ["g"], "id", 3, 7).select("id").collect()
    b = splits.sample_per_group(df.repartition(1), ["g"], "id", 3, 7).select("id").collect()
    assert sorted(a) == sorted(b) and len(a) == 6
    with pytest.raises(Exception, match="too few"):
        splits.sample_cells(df, ["g"], "id", 20, 7).collect()


def test_label_hold_out(spark):
    df = spark.createDataFrame([(f"t{i}", i % 2) for i in range(20)], "text string, label int")
    held = splits.label_hold_out(df, "text", "label").filter("split = 'validation'").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in held} == {0: 2, 1: 2}


def _tiers(rows, seq):
    live = sorted((r for r in rows if r[1] > seq), key=lambda r: (r[2], r[0]))
    total, seen, out = sum(r[1] - seq for r in live), 0, {r[0]: -1 for r in rows}
    for i, n, _ in live:
        m = (seen + (n - seq) / 2) / total
        out[i] = 0 if m <= 1 / 3 else 1 if m <= 2 / 3 else 2
        seen += n - seq
    return out


def test_quality_tiers(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(1, 60), rnd.choice([0.1, 0.5, 0.9, rnd.random()])) for i in range(120)]
    df = spark.createDataFrame(rows, "o long, n long, s double")
    assert {r.o: r.tier for r in spans.quality_tiers(df, "n", "s", "o", 20).collect()} == _tiers(rows, 20)
    strata = {r.o: r.length_stratum for r in spans.length_strata(df, "n", "o", 20, 4).collect()}
    live = sorted((r for r in rows if r[1] > 20), key=lambda r: (r[1], r[0]))
    assert strata == {r[0]: None for r in rows if r[1] <= 20} | {r[0]: k * 4 // len(live) for k, r in enumerate(live)}
    got = {r.o: r.tier for r in spans.length_balanced_tiers(df, "n", "s", "o", 20, 4).collect()}
    for k in range(4):
        part = [r for r in live if strata[r[0]] == k]
        assert {r[0]: got[r[0]] for r in part} == _tiers(part, 20)
    with pytest.raises(Exception, match="too few"):
        spans.length_strata(df.limit(2).withColumn("n", F.lit(30).cast("long")), "n", "o", 20, 4).collect()


def test_null_scores_and_empty_spans(spark):
    df = spark.createDataFrame([(1, 30, None), (2, 30, float("nan")), (3, 30, 0.5), (4, None, 0.1)], "o long, n long, s double")
    got = {r.o: r.tier for r in spans.quality_tiers(df, "n", "s", "o", 20).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: -1}
    assert spans.quality_tiers(df.limit(0), "n", "s", "o", 20).count() == 0


def test_rolling_windows_score_each_token_once(spark):
    df = spark.createDataFrame([(1, 10), (2, 0), (3, 3)], "o long, n long")
    rows = spans.rolling_windows(df, "n", 4, 3).orderBy("o", "target_start").collect()
    assert [(r.o, r.context_start, r.target_start, r.target_end) for r in rows] == [(1, 0, 0, 3), (1, 2, 3, 6), (1, 5, 6, 9), (1, 6, 9, 10), (3, 0, 0, 3)]


def test_sampled_windows_stay_inside(spark):
    df = spark.createDataFrame([(i, 10 * i, i % 3) for i in range(1, 30)], "o long, n long, tier int")
    rows = spans.sample_windows(df, "o", "n", "tier", "o", 3000, 16, (0.2, 0.3, 0.5), 1).collect()
    assert len(rows) == 3000 and all(0 <= r.window_start < 10 * r.o - 16 for r in rows)
    share = [sum(r.tier == k for r in rows) / 3000 for k in range(3)]
    assert abs(share[0] - 0.2) < 0.03 and abs(share[2] - 0.5) < 0.03
    with pytest.raises(ValueError, match="tier 1"):
        spans.sample_windows(df.filter("tier <> 1"), "o", "n", "tier", "o", 10, 16, (0.2, 0.3, 0.5), 1)
    assert {r.tier for r in spans.sample_windows(df.filter("tier <> 1"), "o", "n", "tier", "o", 50, 16, (0.5, 0.0, 0.5), 1).collect()} == {0, 2}
    assert spans.draw_counts(spark.createDataFrame(rows)).count() == 3


def test_bpe_round_trip(spark):
    texts = ["low lower lowest", "newer wider", "héllo 你好 🙂 low", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    merges = bpe.train(df, "t", 275)
    assert merges == bpe.loads(bpe.dumps(merges)) and len(merges) == 17
    rows = bpe.encode(df, "t", merges, "ids", add_eos=True).collect()
    for r in rows:
        assert bpe.decode(r.ids, merges) == (r.t or "") and r.ids[-1] == bpe.EOS_ID
    assert bpe.decode([bpe.PAD_ID, 65], merges, True) == "<|pad|>A"
    with pytest.raises(ValueError):
        bpe.decode([9999], merges)
    with pytest.raises(ValueError):
        bpe.learn_merges({}, 200)


def _slow_merges(counts, n):
    pieces = {p: list(p.encode()) for p in counts}
    out = []
    for k in range(n):
        pairs = {}
        for p, ids in pieces.items():
            for x in zip(ids, ids[1:]):
                pairs[x] = pairs.get(x, 0) + counts[p]
        if not pairs:
            break
        best = min(pairs, key=lambda x: (-pairs[x], x))
        out.append(best)
        pieces = {p: bpe.apply_merge(ids, best, 258 + k) for p, ids in pieces.items()}
    return out


def test_incremental_merges_equal_recounting():
    rnd = random.Random(5)
    counts = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))): rnd.randint(1, 5) for _ in range(40)}
    assert bpe.learn_merges(counts, 258 + 25) == _slow_merges(counts, 25)


def test_classifier_learns(spark):
    good, bad = [f"the river and the boat went to town {i}" for i in range(20)], [f"$$$ http://x{i} www.win!!!!" for i in range(20)]
    model = QualityClassifier(128).fit(good + bad, [1] * 20 + [0] * 20, 60)
    assert model.score_texts(good).min() > model.score_texts(bad).max()
    again = QualityClassifier.loads(model.dumps())
    df = spark.createDataFrame([(good[0], 1), (bad[0], 0), (None, 0)], "text string, label int")
    scored = again.score(df, "text").collect()
    assert abs(scored[0].quality_score - model.score_texts([good[0]])[0]) < 1e-12 and scored[2].quality_score is None
    odd = ["", "x", "aaaa aaaa", "Ünï http://www.a", "12 ab!?"]
    each = np.concatenate([features([t], 64) for t in odd])
    assert np.allclose(features(odd, 64), each) and each[2, 7] == 0.2 and each[3, 6] == 0.2 and (each[0, :8] == 0).all()
    m = classifier_metrics(again.score(df, "text").na.drop(), "label", "quality_score", 0.5).first()
    assert (m.examples, m.accuracy, m.precision, m.recall) == (2, 1.0, 1.0, 1.0)
    assert {r.label: r.weight for r in class_weights(df, "label").collect()} == {0: 0.75, 1: 1.5}
    with pytest.raises(ValueError):
        check_examples(df)
    labelled = spark.createDataFrame([(t, 1) for t in good] + [(t, 0) for t in bad], "text string, label int")
    _, report = train_classifier(labelled, 64, 60, max_examples=12)
    assert report == {"train_examples": 12, "validation_examples": 10, "accuracy": 1.0, "precision": 1.0, "recall": 1.0}


def test_scaling_and_schedules(spark):
    runs = [(c * 1e12, p * 1e6, 2.0 + abs(p - b)) for c, b in ((1, 4), (4, 8), (16, 16), (64, 32)) for p in (2, 4, 8, 16, 32, 64)]
    fit = reports.scaling_fit(spark.createDataFrame(runs, "compute_budget double, parameters double, final_loss double"))
    row = fit.first()
    assert abs(row.parameter_exponent - 0.5) < 1e-9 and abs(row.token_exponent - 0.5) < 1e-9 and row.parameter_log_rmse < 1e-9
    assert abs(reports.predict(fit, 2.56e14).first().predicted_parameters - 64e6) < 1
    step = F.col("id")
    got = spark.range(10).select(reports.wsd_rate(step, 10, 1.0, 2, 4, 0.1).alias("w"), reports.cosine_rate(step, 10, 1.0, 2, 0.1).alias("c")).collect()
    assert got[0].w == 0.5 and got[3].w == 1.0 and abs(got[9].w - 0.1) < 1e-12 and abs(got[9].c - 0.1) < 1e-12


def test_mixture_is_of_probabilities(spark):
    import math

    df = spark.createDataFrame([(math.log(0.9), math.log(0.1), [1.0, 2.0, 0.5])], "a double, b double, z array<double>")
    row = df.select(F.exp(reports.mixture(F.col("a"), F.col("b"))).alias("m"), reports.gold_log_probability(F.col("z"), F.lit(1)).alias("g")).first()
    assert abs(row.m - 0.5) < 1e-12 and abs(row.g - (2 - math.log(math.e + math.e**2 + math.e**0.5))) < 1e-9


def test_seed_controls(spark):
    df = spark.createDataFrame([(1, "x", -0.1), (2, "x", 0.3)], "seed int, data string, change double")
    row = reports.seed_summary(reports.check_seeds(df, "seed", ["data"]), "change").first()
    assert row.runs == 2 and row.improved_runs == 1 and abs(row.mean_change - 0.1) < 1e-12
    for bad in (df.limit(1), df.withColumn("seed", F.lit(1)), df.withColumn("data", F.col("seed").cast("string"))):
        with pytest.raises(ValueError):
            reports.check_seeds(bad, "seed", ["data"])


def test_training_in_rounds_holds_few_symbols(spark, monkeypatch):
    rnd = random.Random(7)
    texts = [" ".join("".join(rnd.choice("aaabbcd é5") for _ in range(rnd.randint(1, 9))) for _ in range(20)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in [*texts, "aaaaaaa" * 40, "", None]], "t string")
    counts = {r.piece: r.n for r in bpe.piece_counts(df, "t").collect()}
    want = bpe.learn_merges(counts, 280)
    held, greedy = [], bpe.greedy_merges

    def watched(weighted, *rest):
        pieces = list(weighted)
        held.append(sum(len(ids) for ids, _ in pieces))
        return greedy(pieces, *rest)

    monkeypatch.setattr(bpe, "greedy_merges", watched)
    assert bpe.train(df, "t", 280, 800) == want and len(held) > 1 and max(held) <= 800
    held.clear()
    assert bpe.train(df, "t", 280) == want and len(held) == 1 and held[0] > 800
    assert bpe.train(df, "t", 260, 0) == want[:2]
    assert bpe.train(df.limit(0), "t", 300) == bpe.train(df, "t", 258) == []


def test_sweep_counts_the_tokens_of_all_texts(spark):
    df = spark.createDataFrame([(t,) for t in ["low lower lowest", "low low newer wider", "héllo 你好 🙂 low aaaaa", "", None]], "t string")
    merges = bpe.train(df, "t", 270)
    rows = bpe.vocabulary_sweep(df, "t", [258, 262, 270]).collect()
    assert [r.vocab_size for r in rows] == [258, 262, 270]
    for r in rows:
        assert r.tokens == sum(len(x.i) for x in bpe.encode(df, "t", merges[: r.vocab_size - 258], "i").collect())
        assert r.bytes == sum(len((x.t or "").encode()) for x in df.collect()) and r.bytes_per_token == r.bytes / r.tokens
    assert [(r.vocab_size, r.tokens, r.bytes) for r in bpe.vocabulary_sweep(df.limit(0), "t", [258]).collect()] == [(258, None, None)]


def test_labels(spark):
    rows = [(1, " 2 ", 1), (1, "0", 2), (2, "", 1), (3, "9", 1), (4, None, 1), (5, "1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, human_label string, at long")
    assert {r.doc_id: r.label for r in reports.clean_labels(df, "doc_id", "human_label", ["at"]).collect()} == {1: 0, 5: 1}
    known = spark.createDataFrame([(5,)], "doc_id long")
    assert reports.checked_labels(df.filter("doc_id = 5"), known, "doc_id", "human_label").first().label == 1
    for keep, text in (("doc_id = 1", "unknown"), ("doc_id = 3", "unknown")):
        with pytest.raises(Exception, match=text):
            reports.checked_labels(df.filter(keep), known, "doc_id", "human_label").collect()
    tiers = spark.createDataFrame([(1, 0), (5, 2)], "doc_id long, tier int")
    got = {r.tier: (r.labeled, r.mean_label) for r in reports.label_means(spark, tiers, reports.clean_labels(df, "doc_id", "human_label", ["at"]), "doc_id", ["tier"]).collect()}
    assert got == {0: (1, 0.0), 1: (0, None), 2: (1, 1.0)}


def test_compare_runs(spark):
    a = spark.createDataFrame([("d", 2.0, 8.0)], "data string, loss double, perplexity double")
    b = spark.createDataFrame([("d", 1.9, 6.0)], "data string, loss double, perplexity double")
    assert reports.compare_runs(a, b, ["data"]).first().selected == "second"
    assert reports.compare_runs(a, a, ["data"]).first().selected == "first"
    with pytest.raises(ValueError):
        reports.compare_runs(a, b.withColumn("data", F.lit("e")), ["data"])


def test_long_pieces_merge_alike():
    rnd = random.Random(8)
    counts = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))): 1 for _ in range(60)}
    merges = bpe.learn_merges(counts, 258 + 30)
    rank = {p: i for i, p in enumerate(merges)}
    for n in (1, 2, 30, 47):
        text = "".join(rnd.choice("abc") for _ in range(n))
        ids = list(text.encode())
        for i, pair in enumerate(merges):
            ids = bpe.apply_merge(ids, pair, 258 + i)
        assert bpe.merge_ranked(list(text.encode()), rank) == bpe.PieceEncoder(merges).piece(text) == ids
    assert bpe.apply_merge([1, 1, 1, 2, 1, 1], (1, 1), 9) == [9, 1, 2, 9] and bpe.apply_merge([], (1, 1), 9) == []
    long = "".join(rnd.choice("abc") for _ in range(20_000))
    assert bpe.decode(bpe.PieceEncoder(merges).piece(long), merges) == long


def test_pairing(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "o long, a string"), spark.createDataFrame([(1, 5), (2, 6)], "o long, b int")
    assert sorted(tuple(r) for r in paired(a, b, "o").select("o", "a", "b").collect()) == [(1, "x", 5), (2, "y", 6)]
    for other in (b.limit(1), b.unionByName(b.limit(1))):
        with pytest.raises(Exception, match="differ"):
            paired(a, other, "o").collect()
    assert completed(b.limit(1), a, "o").count() == 1
    with pytest.raises(Exception, match="missing"):
        completed(b, a.limit(1), "o").collect()


def test_likelihood_covers_each_token_once(spark):
    import math

    import numpy as np

    calls = []

    def flat(window, first, end):
        calls.append((len(window), first, end))
        return np.full(end - first, -1.0)

    assert likelihood.score_tokens(list(range(10)), flat, 4, 3).sum() == -10 and likelihood.score_tokens([], flat, 4, 3).size == 0
    assert [end - first for _, first, end in calls] == [3, 3, 3, 1] and all(n <= 5 for n, _, _ in calls)
    df = spark.createDataFrame([("a", "xy", [120, 121]), ("b", "", []), ("c", "xx", [120, 120])], "id string, text string, tokens array<int>")
    model = likelihood.fit_ngrams(df, "tokens", 300)
    assert model.uni == {120: 3, 121: 1} and model.bi == {(257, 120): 2, (120, 121): 1, (120, 120): 1}
    probabilities = np.exp([model([120, t], 1, 2)[0] for t in range(300)])
    assert abs(probabilities.sum() - 1) < 1e-9
    row = likelihood.evaluate(df, "id", "text", "tokens", model, 8, 2).first()
    want = -sum(likelihood.score_tokens(t, model, 8, 2).sum() for t in ([120, 121], [120, 120]))
    assert row.tokens == 4 and abs(row.loss - want / 4) < 1e-9 and abs(row.bits_per_byte - want / (math.log(2) * 4)) < 1e-9
    mixed = likelihood.evaluate_ensemble(df, "id", "tokens", {"x": model, "y": model}, 8, 2).first()
    assert abs(mixed.mixed_loss - mixed.x_loss) < 1e-9 and mixed.documents == 2 and mixed.improved_documents == 0
    with pytest.raises(ValueError):
        likelihood.evaluate_ensemble(df, "id", "tokens", {"x": model}, 8, 2)


def test_near_duplicates_of_one_signature(spark):
    """Different sets that share a signature are all compared: three that differ in one element that no minimum shows."""
    import numpy as np

    from sievewright.operators import dedup

    rnd = np.random.default_rng(4)
    base = rnd.integers(-(2**62), 2**62, 300)
    plain = dedup.signatures(base.view(np.uint64), np.array([0, 300]), 16)
    quiet = [x for x in rnd.integers(-(2**62), 2**62, 200) if (dedup.signatures(np.append(base, x).view(np.uint64), np.array([0, 301]), 16) == plain).all()][:3]
    rows = [(i, [*base.tolist(), int(x)]) for i, x in enumerate(quiet)] + [(3, [*base.tolist(), int(quiet[0])])]
    found = dedup.near_duplicates(spark.createDataFrame(rows, "ord long, shingles array<long>"), "shingles", "ord", 0.9, 16, 4)
    assert {(r.ord, r.root, r.links) for r in found.collect()} == {(0, 0, 3), (1, 0, 2), (2, 0, 2), (3, 0, 1)}
