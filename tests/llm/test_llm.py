import os
import pickle
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.functions.golay import nearby_indices
from sievewright.functions.units import normalized_words, unit_blocks
from sievewright.llm import encoding, leakage, mixing, nearcopies, overlaps, packing, pii, prose, queries, repetition, sampling
from sievewright.llm.pii_model import KINDS, Tagger, encode_text
from sievewright.llm.pii_training import Maker, batch, report
from sievewright.session import table

ODD = "doc_id long, text string, source string, lang string, rank int, h1 string, _id string"


def odd_rows():
    """Nulls, blanks, repeats, a very long text, and columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [None, "", " \n\t", "x", "same words again " * 12, "same words again " * 12, long, "你好世界" * 30, "\x00￾￿\U0001f642"]
    return [(i if i else None, t, None if i % 2 else "s", None, None, "h", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    return spark.createDataFrame([*rows, rows[4]], ODD)


def story(rnd, n):
    return [rnd.choice("the a boat river lamp clock baker counted hid sold near under before market jar owl".split()) + rnd.choice(["", "", str(rnd.randint(1, 60))]) for _ in range(n)]


def corpus(seed, n=120):
    """Stories, copies with edits, insertions and another order, exact copies, and a notice that a third carries."""
    rnd = random.Random(seed)
    notice = "all measurements were taken with simple tools and should not be used for the planning of bridges or boats today".split()
    out = []
    for i in range(n):
        k = rnd.random()
        if i > 10 and k < 0.5:
            w = list(rnd.choice(out))
            for _ in range(rnd.randint(0, max(1, len(w) // 14))):
                w[rnd.randrange(len(w))] = "edit" + str(rnd.randint(1, 99))
            if k < 0.15:
                at = rnd.randrange(len(w))
                w[at:at] = story(rnd, len(w) // 6)
            elif k < 0.25:
                at = len(w) // 2
                w = w[at:] + w[:at]
        else:
            w = story(rnd, rnd.randint(22, 90))
        out.append((notice + w) if i % 3 == 0 and w[: len(notice)] != notice else w)
    return [" ".join(w) for w in out]


def runs_of(text, k):
    w = normalized_words(text)
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= 20 else set()


def alike(a, b, threshold=0.6):
    return bool(a and b) and len(a & b) >= threshold * len(a | b)


# --- 1 ---


def test_prose_and_lists(spark):
    sentence = "The old baker carried the lamp across the bridge because nobody in the village wanted it."
    texts = {
        "plain": sentence * 3, "bare": sentence.lower().replace(".", "") * 3, "markup": f"<p>{sentence}</p>\n<p>{sentence}</p>", "loop": "\n".join(["the baker said that it was late"] * 12),
        "numbered": "\n".join(f"{i}. {sentence}" for i in range(5)), "chinese": "渔夫在河边慢慢修好了小船，因为店主想要卖掉木桶。" * 4,
        "list": "\n".join(f"- the {w} jar ({i} ml)" for i, w in enumerate(["old", "new", "red", "big", "tin", "wet", "dry"])), "table": "\n".join(f"{i}\t{i * 7}.25\tyes\t{i + 90}" for i in range(20)), "csv": "\n".join(f"the lamp,{i},{i * 3}.1,n/a,8812" for i in range(12)),
        "noise": "%&/ ==) ?!* #+~ " * 12, "letters": "xkqz vrtp qwlm zzkt pfwx bnmq " * 8, "keywords": "lamp baker bridge copper lantern village kettle harbour " * 6, "hex": "0c5ee 0e5fb baddd 632dd 9a70d 4594b " * 8, "log": "\n".join(f"2024-01-0{i} 10:00:0{i} INFO [a-{i}] n={i}55 m=0.{i}" for i in range(1, 9)), "cjk list": "\n".join(["- 柔软蜂蜜", "- 完整钟表", "- 木制罗盘", "- 透明篮子"] * 5), "menu": "home | about | tags | login | print | share | next | " * 4,
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    names = list(texts)
    assert {names[r.doc_id] for r in prose.not_prose(df).collect()} == {"list", "table", "csv", "noise", "letters", "keywords", "hex", "log", "cjk list", "menu"}


def test_published_rules(spark):
    sentence = "The old baker carried the lamp to the bridge and found that nobody in the village wanted it."
    texts = {
        "fine": " ".join([sentence] * 4 + ["It was late.", "They have it with them."]), "short": sentence, "long words": "incomprehensibilities counterrevolutionaries " * 30, "hashes": ("# tag ... word " * 40), "bullets": "\n".join(f"- item number {i} of the list to have" for i in range(12)),
        "ellipses": "\n".join(["the story goes on and on to the end ..."] * 2 + ["and so it was."] * 2), "numbers": "12 345 6789 " * 30, "braces": sentence * 4 + " {x}", "lorem": sentence * 3 + " lorem ipsum dolor", "lines": "\n".join(["short line"] * 5 + ["an unended line that has many words in it"] * 2), "empty": "",
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    names, stats = list(texts), prose.text_quality(df)
    got = {names[r.doc_id]: set(r.published) for r in stats.collect()}
    assert got["fine"] <= {"fineweb_repeated_lines"} and got["empty"] == set()
    for name, rule in (("short", "gopher_word_count"), ("long words", "gopher_word_length"), ("hashes", "gopher_symbols"), ("bullets", "gopher_bullets"), ("ellipses", "gopher_ellipses"), ("numbers", "gopher_alpha_words"), ("numbers", "gopher_stop_words"), ("short", "c4_sentences"), ("braces", "c4_braces"), ("lorem", "c4_lorem_ipsum"), ("lines", "c4_lines"), ("lines", "fineweb_short_lines"), ("bullets", "fineweb_ended_lines"), ("ellipses", "fineweb_repeated_lines")):
        assert rule in got[name] and (rule not in got["fine"]), (name, rule)
    counts = {(r.rule, r.published): r for r in prose.rule_counts(stats).collect()}
    assert counts["c4_braces", True].documents == 1 and all(r.not_prose <= r.documents for r in counts.values())
    assert {r for r, p in counts if not p} <= set(prose.REASONS)


def test_prose_edge_cases(spark, odd):
    rows = prose.text_quality(odd).collect()
    assert len(rows) == 10 and all(0 <= r.prose_share <= 1.0001 for r in rows)
    assert [r.reasons for r in rows if r.doc_id is None or r.doc_id in (1, 2)] == [[], [], []]
    assert prose.not_prose(odd.limit(0)).count() == 0


# --- 2 ---


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=200, deadline=None)
def test_bins_hold_everything(sizes):
    x = np.array(sizes, dtype=np.int64)
    bins = packing.best_fit_decreasing(x, 50)
    if len(x):
        assert np.bincount(bins, weights=x).max() <= 50
        assert packing.lower_bound(x, 50) <= bins.max() + 1


@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
@settings(max_examples=100, deadline=None)
def test_bound_never_exceeds_the_optimum(sizes):
    def least(rest, open_):
        if not rest:
            return len(open_)
        best = least(rest[1:], [*open_, 12 - rest[0]])
        for i, left in enumerate(open_):
            if left >= rest[0]:
                best = min(best, least(rest[1:], [*open_[:i], left - rest[0], *open_[i + 1 :]]))
        return best

    assert packing.lower_bound(np.array(sizes), 12) <= least(sizes, [])


SPANS = "span_id long, cache_name string, span_start long, span_end long, loaded_at timestamp, size int, window string"


def test_packing(spark):
    rnd = random.Random(4)
    rows = [(i, f"c{i % 3 if i % 3 else 0}", 100, 100 + rnd.choice([1, 7, 300, 512, 700, 1024, 1025, 3000]), None, None, "x") for i in range(900)]
    rows += [(1, "c1", 5, 25, None, None, "x"), (901, "c1", None, 5, None, 1, None), (902, "c1", 9, 9, None, 1, None), (903, None, 40, 10, None, 1, None), (None, "c1", 1, 2, None, 1, None)]
    df = spark.createDataFrame(rows, SPANS).withColumn("loaded_at", F.when(F.col("span_end") == 25, F.lit("2025-01-01").cast("timestamp")).otherwise(F.lit("2024-01-01").cast("timestamp")))
    got = packing.packed_spans(df, per_partition=100).collect()
    placed = [r for r in got if r.status == "ok"]
    fill = Counter()
    for r in placed:
        fill[r.cache_name, r.window_id] += r.piece_end - r.piece_start
    assert max(fill.values()) <= 1024 and all(fill[r.cache_name, r.window_id] == r.window_fill for r in placed)
    total = Counter()
    for r in placed:
        total[r.span_id] += r.piece_end - r.piece_start
    want = {i: abs(b - a) for i, _, a, b, *_ in rows if i is not None and a is not None and b is not None and a != b} | {1: 20}
    assert dict(total) == want
    assert {r.span_id for r in placed if r.piece > 0} == {i for i, n in want.items() if n > 1024}
    assert {r.span_id: r.status for r in got if r.status != "ok"} == {901: "null_end", 902: "empty"}
    share = packing.window_fill(packing.packed_spans(df, per_partition=100)).collect()
    assert all(r.windows <= 1.03 * r.least_windows + 1 or r.windows - r.least_windows < 40 for r in share)
    assert packing.packed_spans(df.limit(0)).count() == 0 and packing.window_fill(packing.packed_spans(df.limit(0))).count() == 0
    for r in share:
        own = [x.piece_end - x.piece_start for x in placed if x.cache_name == r.cache_name]
        assert r.least_windows == packing.lower_bound(np.array(own), 1024) <= r.windows and r.tokens == sum(own)


# --- 3 ---


@given(st.lists(st.integers(0, 3), min_size=10, max_size=40), st.integers(0, 20))
@settings(max_examples=60, deadline=None)
def test_winnowing_never_misses_a_run(shared, at):
    words = [f"w{x}" for x in shared]
    a, b = " ".join(["p"] * at + words + ["q"]), " ".join(["r", "s"] + words)
    found = [set(leakage.winnow(u, 6, 5)[0].tolist()) for t in (a, b) for _, _, u in unit_blocks([t])]
    assert found[0] & found[1]


def leaks_of(docs, items):
    own = defaultdict(set)
    for i, t in items:
        for x in zip(*[normalized_words(t)[j:] for j in range(10)]):
            own[x].add(i)
    return {(d, *own[x]) for d, t in docs for x in zip(*[normalized_words(t)[j:] for j in range(10)]) if len(own.get(x, ())) == 1}


def test_leaks(spark, odd):
    rnd = random.Random(6)
    head = "read the passage with care and answer the question in one short sentence"
    items = [(i, f"{head} " + " ".join(story(rnd, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "too short")]
    docs = [(i, t) for i, t in enumerate(corpus(7, 60))]
    for i in range(12):
        w = items[i][1].split()
        docs.append((100 + i, " ".join(story(rnd, 20) + w[14 + i : 24 + i] + story(rnd, 5))))
        docs.append((200 + i, head + " " + " ".join(story(rnd, 20))))
        docs.append((300 + i, " ".join(w[14:23])))
    docs += [(400, items[3][1].upper()), (400, items[3][1].upper()), (401, None)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaks_of(docs, items)
    assert {tuple(r) for r in leakage.leaks(df, it).collect()} == want and len(want) >= 13
    assert {tuple(r) for r in leakage.leaks(df, it, broadcast_rows=5).collect()} == want
    assert leakage.leaks(odd, it).count() == leakage.leaks(df, it.limit(0)).count() == 0
    row = leakage.leak_report(leakage.leaks(df, it), it).first()
    assert row.items_without_own_run == 3
    assert row.decontaminated_documents_dropped == len({d for d, _ in want}) and row.leaked_items == len({i for _, i in want})


# --- 4 ---


def test_tagger_gradients():
    maker, model = Maker(3), Tagger(6)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = batch(maker, 4, 18)
    _, grads = model.loss(x, y)
    for name, p in model.p.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), p.shape)
        old, e = p[at], 1e-3
        p[at] = old + e
        up = model.loss(x, y)[0]
        p[at] = old - e
        down = model.loss(x, y)[0]
        p[at] = old
        assert abs((up - down) / (2 * e) - grads[name][at]) < 1e-3


def test_tagger_held_out_accuracy():
    x, y = batch(Maker(99), 400, 112)
    for kind, (recall, precision) in report(pii.tagger().decode(x), y).items():
        least = 0.5 if kind == "id_number" else 0.8  # a number's label is what the exact check asks for
        assert recall > least and precision > least, (kind, recall, precision)


def test_one_symbol_a_character():
    for text in ("a＠ｂ　é😀\n漢", "ﬁ"):
        assert len(encode_text(text)) == len(text)


def test_pii(spark, odd):
    text = "Signed, Rosalind Fenmond. Write to rosalind.fenmond@mail.example or call +44 20 7946 0123. Server 10.20.30.40 refused it. The form lists SSN 912-34-5678 in the margin. Deliver to: 12 Mill Lane, Norholt 00123"
    clean = "Lake Norholt froze in 1788. Firmware 57.426.1.2 was withdrawn. The part number is 912-34-5678 in the list. Tess wanted the map. They paid 88 @ 35 cents each."
    df = spark.createDataFrame([(1, text), (2, clean), (3, None), (4, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.personal_information(df).collect()}
    assert rows[1].pii_replacements == dict.fromkeys(KINDS, 1)
    for kind, mark in pii.PLACEHOLDERS.items():
        assert mark in rows[1].text, kind
    assert "refused it" in rows[1].text and "Fenmond" not in rows[1].text and "7946" not in rows[1].text
    assert rows[2].text == clean and rows[2].pii_replacements == dict.fromkeys(KINDS, 0)
    assert rows[3].text is None and rows[4].text == ""
    assert {tuple(r) for r in pii.found_kinds(df).collect()} == {(1, k) for k in KINDS}
    assert pii.personal_information(odd).count() == 10 and pii.found_kinds(odd.limit(0)).count() == 0


def test_generator_labels_what_it_makes():
    maker, kinds = Maker(4), Counter()
    for _ in range(300):
        text, spans = maker.window(200)
        assert len(text) == 200 and all(0 <= a < b <= 200 and text[a:b].strip() for a, b, _ in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        kinds.update(k for _, _, k in spans)
    assert set(kinds) == set(KINDS)


def test_checks_only_take_away():
    """What passes the exact checks stands where the tagger found something."""
    maker = Maker(17)
    texts = [maker.window(300)[0] for _ in range(40)]
    for exact, raw in zip(pii.find_spans(texts), pii.tagged_spans(texts)):
        assert all(any(c < b + 40 and d > a - 40 for c, d, _ in raw) for a, b, _ in exact)


def test_pii_in_long_digit_runs():
    phones = [f"+4477009{n:05d}" for n in range(861, 901)]
    for sep in (", ", "\n"):
        assert [k for _, _, k in pii.find_spans([sep.join(phones)])[0]] == ["phone"] * len(phones)
    assert sum(k == "ipv4" for _, _, k in pii.find_spans([", ".join(f"192.168.{n}.{n + 101}" for n in range(101, 141))])[0]) > 20
    dump = "\n".join(" ".join(str(i * j * 7919 % 99991) for j in range(1, 13)) for i in range(1, 21))
    alone = pii.find_spans([phones[0] + " is the number to call."])[0]
    assert [k for _, _, k in alone] == ["phone"]
    assert pii.find_spans([dump, phones[0] + " is the number to call."]) == [[], alone]


def test_tagger_reads_every_character():
    """An item that nothing marks from outside: few digits, no capitals beside it, far from anything else."""
    assert pii.find_spans(["their passport number is X123456 and they left."])[0] == [(25, 32, "id_number")]
    filler = "the boats lay still and nobody came to the quay that day. " * 12
    assert [k for _, _, k in pii.find_spans([filler + "their passport number is X123456 and they left. " + filler])[0]] == ["id_number"]
    assert pii.find_spans(["perdió su reloj del pueblo, aunque toda la calle vino a mirar. En 1820, una nutria curiosa cambió dos redes."])[0] == []
    start, end = pii.windows(np.array([0, 1, 301, 302, 2000, 2050]))
    read = set().union(*(range(a, b) for a, b in zip(start, end)))
    assert read == set(range(2049)) - {0, 300, 301, 1999}


def test_windows_that_no_check_passes_are_not_run(monkeypatch):
    """Text without a possible item costs no window; a passport number in it those around it, with the same spans."""
    filler = "the boats lay still and nobody came to the quay that day. " * 60
    texts = [filler, filler + "their passport number is X123456 and they left. " + filler]
    read, decode = [], pii.Tagger.decode
    monkeypatch.setattr(pii.Tagger, "decode", lambda self, x, bias=0.0: read.append(x.shape[1]) or decode(self, x, bias))
    spans = pii.find_spans(texts)
    assert sum(read) <= 4 and [k for _, _, k in spans[1]] == ["id_number"] and spans[0] == []
    assert pii.find_spans(texts, everything=True) == spans and sum(read) > 100
    assert pii.find_spans([]) == [] and pii.find_spans(["", None]) == [[], []]


def test_windows_not_run_hold_nothing_whatever_the_tags(monkeypatch):
    """With tags at random in place of the tagger's, over odd texts, the checks pass the same spans as over all windows."""
    pieces = (
        "Anna;Bo;li;O'Neil;L'Anna;anna-Maria;Ｌｉ;Ａnna;张Anna;Müller;Mu\u0308ller;ﬁn;Ⓐnna;M.;J.;_.;Dr;the;lake;Signed,;Paraŀlel;½;①;Ⅻ;〇〇;12;1788;912-34-5678;+44 20 7946 0123;(030) 1234567;10.20.30.40;⒈⒉⒊4;"
        "１２３４５６７;555 1234, 555 9876;ext. 12;a@b.co;foo (at) bar (dot) com;foo at bar dot com;½at b.com;SSN;NIE;NI_;tax;税号;Führerschein;ıdentıty;id no;X123456;1 2 3 4 5 6;12 Mill Lane;flat 3, 12 Mill Lane;"
        "5 rue de la Paix;calle Mayor nº 5;c/ Sol 3;Hauptstraße 5;am Alten Markt 5;an der Weide 12;Auf dem Großen Hohen Berg 3;12 old road;ſtr. 5;" + "x" * 170
    ).split(";")
    gaps = [" "] * 8 + ["\u00a0", ", ", ". ", "\n", "\t", "; ", "|", "-", "'", "", "_", "  ", "\u0301", "…", "("]
    rnd, tags = random.Random(5), None

    def fake(points, start, end, bias, out, chosen):
        for a, b in zip(*(x[chosen].tolist() for x in pii.own(start, end))):
            out[a:b] = tags[a:b]

    monkeypatch.setattr(pii, "tag", fake)
    passed = 0
    for _ in range(60):
        texts = ["".join(rnd.choice(pieces) + rnd.choice(gaps) for _ in range(rnd.randint(0, 60))) for _ in range(20)]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        tags, at, dense = np.zeros(bounds[-1] + 1, np.int8), 0, rnd.choice([3, 20, 80])
        while at < bounds[-1]:
            at += rnd.randint(0, dense)
            n, k = rnd.randint(1, rnd.choice([2, 12, 40, 150])), rnd.randrange(len(KINDS))
            tags[at : at + n] = 2 + 2 * k
            tags[at : at + 1] -= rnd.random() < 0.95
            at += n
        tags[bounds[1:] - 1] = 0
        spans = pii.find_spans(texts, everything=True)
        assert pii.find_spans(texts) == spans
        passed += sum(map(len, spans))
    assert passed > 500


def test_windows_agree_over_long_texts():
    maker = Maker(8)
    text = " ".join(maker.window(400)[0] for _ in range(30))
    whole, parts = pii.find_spans([text])[0], pii.find_spans(["", text, None, "x"])
    assert parts[0] == parts[2] == [] and parts[1] == whole
    assert all(b > a for a, b, _ in whole) and all(x[1] <= y[0] for x, y in zip(whole, whole[1:]))


# --- 5 and 7 ---


def test_golay_radius():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    keys = nearby_indices(words)
    assert set((keys >= 0).sum(1).tolist()) <= {1, 6}
    for _ in range(20):
        flips = [1 << int(i) for i in rng.choice(23, 2, replace=False)]
        other = nearby_indices(words ^ flips[0] ^ flips[1])
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys, other))


def test_near_pairs(spark, odd):
    texts = corpus(11, 150)
    rows = list(enumerate([*texts, texts[5], texts[5], None, ""]))
    sets = [runs_of(t, 3) for _, t in rows]
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if alike(sets[i], sets[j])}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in nearcopies.near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.99 * len(want)
    groups = {r.doc_id: r for r in nearcopies.groups(df).collect()}
    assert set(groups) == {x for p in got for x in p}
    assert all(groups[a].group == groups[b].group for a, b in got) and groups[5].copies == 3
    assert {tuple(r) for r in nearcopies.near_pairs(odd).collect()} == {(4, 5)}
    assert nearcopies.near_pairs(odd.limit(0)).count() == nearcopies.groups(odd.limit(0)).count() == 0


def test_sketch_comparison(spark):
    a, b = 0x123456789ABCDEF0, 0x1234567890BCDEF1
    row = spark.createDataFrame([(a, b, -1, -1)], "a long, b long, c long, d long").select(nearcopies.equal_cells(F.col("a"), F.col("b")).alias("x"), nearcopies.equal_cells(F.col("c"), F.col("d")).alias("y")).first()
    assert (row.x, row.y) == (14, 16)


def test_cross_split(spark, odd, monkeypatch):
    rnd = random.Random(3)
    texts = corpus(13, 140)
    rows = [(f"{rnd.choice(['train', 'train', 'validation', 'test'])}-source-{i:03d}-x", t, "s", i) for i, t in enumerate(texts)]
    rows += [("train-source-900-x", texts[4], None, 1), ("test-source-901-x", texts[4], None, 1), ("test-source-901-x", texts[4], None, 2), ("other-source-902-x", texts[4], None, 2), ("test-source-903-x", None, "s", 2)]
    latest = {}
    for i, t, _, o in rows:
        if t is not None and (i not in latest or o >= latest[i][1]):
            latest[i] = (t, o)
    sets = {i: runs_of(t, 3) for i, (t, _) in latest.items()}
    side = lambda i: i.split("-")[0]
    want = {tuple(sorted((i, j))) for i in sets for j in sets if side(i) == "train" and side(j) in ("validation", "test") and alike(sets[i], sets[j])}
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, loaded_at long")
    got = {tuple(sorted((r.train, r.held))) for r in overlaps.overlaps(df).collect()}
    assert got == want
    monkeypatch.setattr(overlaps, "CELL_ROWS", 2)
    monkeypatch.setattr(nearcopies, "CELL_ROWS", 2)
    assert {tuple(sorted((r.train, r.held))) for r in overlaps.overlaps(df).collect()} == want
    rep = overlaps.overlap_report(df).collect()
    held = {x for p in got for x in p if side(x) != "train"}
    same = {x for x in held if any(sets[x] == sets[y] for p in got for y in p if side(y) == "train")}
    assert sum(r.overlapping for r in rep) == len(held) and sum(r.exact for r in rep) == len(same) > 0
    named = odd.withColumn("doc_id", F.concat(F.lit("test-"), F.col("doc_id").cast("string"))).withColumn("loaded_at", F.lit(1))
    assert overlaps.overlaps(named).count() == overlaps.overlaps(named.limit(0)).count() == 0


def cross_pairs(spark, rows):
    """What overlaps finds in (id, text) rows, and what all pairs compared one by one give."""
    sets = {i: runs_of(t, 3) for i, t in rows if len(t.split()) >= 20}
    want = {(i, j) for i in sets for j in sets if i.startswith("train") and not j.startswith("train") and alike(sets[i], sets[j])}
    df = spark.createDataFrame(rows, "doc_id string, text string")
    return {(r.train, r.held) for r in overlaps.overlaps(df, order_col=None).collect()}, want


def test_cross_split_of_one_story_with_edits(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "CELL_ROWS", 2)
    base = [f"w{i}" for i in range(100)]
    edited = lambda n, first: [f"e{n}x{i}" if i % 19 == first else w for i, w in enumerate(base)]
    rows = [(f"train-source-{n}-x", " ".join([*base[:-1], f"t{n}"])) for n in range(5)]
    rows += [(f"test-source-{n}-x", " ".join(edited(n, 9))) for n in range(5)]
    got, want = cross_pairs(spark, rows)
    assert len(want) == 25 and got == want


def test_marks_bound_the_difference_and_refuse_strangers():
    rnd = np.random.default_rng(3)
    for n in (1, 40, 90, 91, 118, 200, 201, 400):
        pool = rnd.integers(0, 2**63, 2 * n * 30, dtype=np.uint64)
        sets = [pool[: n - k] if k < n else pool[:0] for k in (0, 1, n // 3)] + [pool[n * i : n * i + n + (i % 3) * (n // 5)] for i in range(1, 25)]
        sizes = np.array([len(x) for x in sets])
        marks, words = overlaps.run_marks(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes), overlaps.mark_words(sizes)
        i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
        apart = overlaps.marks_apart(marks, words, marks, words, i, j)
        assert all(a <= len(np.setxor1d(sets[x], sets[y])) for a, x, y in zip(apart, i, j))
        strangers = (i > 2) & (j > i + 2)
        if 40 <= n <= 201:  # at similarity 0.6 at most a quarter of all runs differ; marks of longer records fill up
            assert (apart[strangers] > 0.25 * (sizes[i] + sizes[j])[strangers]).mean() > 0.9


def test_recall_by_length(spark):
    """Random pairs at similarity 0.6 or more, one edit and several, by length; near copies and overlaps of splits."""
    rnd, rows, sizes = random.Random(1), [], [20, 22, 24, 28, 34, 45, 60, 100]
    for size in sizes:
        first = len(rows)
        while len(rows) < first + 240:
            words = [f"v{rnd.randint(1, 9**6)}" for _ in range(size)]
            other = list(words)
            for _ in range(1 if len(rows) % 4 else max(1, size // 14)):
                other[rnd.randrange(size)] = "e" + str(rnd.randint(1, 999))
            a, b = " ".join(words), " ".join(other)
            if alike(runs_of(a, 3), runs_of(b, 3)):
                rows += [(f"train-{size}-{len(rows)}", a), (f"test-{size}-{len(rows)}", b)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    want = {(rows[i][0], rows[i + 1][0]) for i in range(0, len(rows), 2)}
    assert {(r.train, r.held) for r in overlaps.overlaps(df, order_col=None).collect()} == want
    near = {tuple(sorted(r)) for r in nearcopies.near_pairs(df).collect()}
    assert near <= {tuple(sorted(x)) for x in want}
    for size in sizes:
        assert sum(f"-{size}-" in a for a, _ in near) >= 0.96 * 120, size


def test_copies_are_no_hot_task(spark, monkeypatch):
    """One text 600 times, with a near copy: classes and links without expansion, and all pairs from cells."""
    monkeypatch.setattr(nearcopies, "CELL_ROWS", 100)
    monkeypatch.setattr(nearcopies.bucket_pairs, "__defaults__", ((), None, 100))
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words)) for i in range(600)] + [(600, " ".join([*words[:-1], "x"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    pairs, members, grouped = nearcopies.class_pairs(df)
    assert pairs.count() == 1 and members.count() == 600 and grouped.first().n == 600
    got = [tuple(r) for r in nearcopies.near_pairs(df).collect()]
    assert len(got) == len(set(got)) == 600 * 599 // 2 + 600


def test_cross_split_of_short_records(spark):
    rnd = random.Random(5)
    rows = []
    for n, size in enumerate([20, 20, 21, 25, 30, 40, 90]):
        words = [f"w{n}x{i}" for i in range(size)]
        rows.append((f"train-source-{n}-x", " ".join(words)))
        rows.append((f"validation-source-{n}-x", " ".join("edit" if i % 14 == size // 2 % 14 else w for i, w in enumerate(words))))
        words[rnd.randrange(size)] = "other"
        rows.append((f"test-source-{n}-x", " ".join(words)))
    got, want = cross_pairs(spark, rows)
    assert len(want) > 10 and got == want
    pairs, _ = overlaps.cross_split(spark.createDataFrame(rows, "doc_id string, text string"), order_col=None)
    assert {(r.a, r.b) for r in pairs.collect()} == want and pairs.filter("a = 'train-source-6-x' and b = 'test-source-6-x' and covered > 20").count() == 1


def test_pairs_come_from_suffixes_with_their_coverage(spark, monkeypatch):
    """Pairs come by the suffixes alone, with exact coverage, however full the cells and whatever COMMON."""
    rows = [(f"{'test' if i % 3 == 0 else 'train'}-source-{i}-x", t) for i, t in enumerate(corpus(29, 60))]
    texts = dict(rows)
    sets = {i: runs_of(t, 3) for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i.startswith("train") and j.startswith("test") and alike(sets[i], sets[j])}

    def covered(a, b):
        deep, words = runs_of(a, 12), normalized_words(b)
        return len({j for i in range(len(words) - 11) if tuple(words[i : i + 12]) in deep for j in range(i, i + 12)})

    df = spark.createDataFrame(rows, "doc_id string, text string")
    for common, bits in ((4, 26), (1, 2)):
        monkeypatch.setattr(overlaps, "COMMON", common)
        monkeypatch.setattr(overlaps, "CHUNK_BITS", min(bits, 16))
        monkeypatch.setattr(overlaps, "MAX_BITS", bits)
        found = overlaps.cross_split(df, order_col=None)[0].collect()
        by = {(r.a, r.b): r.covered for r in found}
        assert len(want) > 10 and {(r.train, r.held) for r in overlaps.overlaps(df, order_col=None).collect()} == want
        assert by == {(a, b): covered(texts[a], texts[b]) for a, b in by} and by.keys() <= want
    monkeypatch.setattr(overlaps, "meetings", lambda found, s, parts: spark.createDataFrame([], "r0 bigint, r1 bigint"))
    assert overlaps.cross_split(df, order_col=None)[0].count() == 0


def test_weights_of_runs_travel_compressed(spark):
    texts = corpus(31, 40)
    docs = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "side int, _text string")
    assert 0 < len(pickle.dumps(overlaps.run_weights(docs, nearcopies.Settings(), 22))) < 2**22 // 8


# --- 6 ---


def test_sample_is_stable(spark, sf):
    rows = spark.range(-5000, 40_000).withColumnRenamed("id", "doc_id")
    whole = {r.doc_id for r in sampling.block_sample(rows.repartition(9)).collect()}
    assert whole == {r.doc_id for r in sampling.block_sample(rows.repartition(2)).collect()}
    part = {r.doc_id for r in sampling.block_sample(rows.filter("pmod(doc_id, 7) < 3")).collect()}
    assert part == {x for x in whole if x % 7 < 3}
    per = Counter(x >> 10 for x in whole)
    assert all(per[b] == sampling.CHOSEN for b in range(0, 39))
    small, large = (table(spark, f"/root/testdata/{d}", "documents").select("doc_id") for d in ("sf0.001", "sf0.01"))
    ids = {r.doc_id for r in small.collect()}
    assert {r.doc_id for r in sampling.block_sample(small).collect()} == {r.doc_id for r in sampling.block_sample(large).collect() if r.doc_id in ids}
    mixed = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b")], "doc_id long, r string")
    assert sampling.block_sample(mixed, chosen=1024).count() == 2 and sampling.block_sample(mixed, chosen=0).count() == 0
    with pytest.raises(ValueError):
        sampling.block_sample(mixed, "r")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(queries.oracle_sql()["p6_sample"]).fetchall()) == sorted(tuple(r) for r in queries.p6_sample(spark, sf).collect())


# --- 8 ---


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    encoder = encoding.load_encoder(encoding.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_of_any_text(reference, texts):
    flat, offsets = encoding.load_encoder(encoding.vocabulary_path()).encode_batch(texts)
    for i, t in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == reference.encode_ordinary(t)


def test_ids(spark, odd, reference):
    extra = spark.createDataFrame([(90, "a" * 3000), (91, "x<|endoftext|>y"), (92, "é" * 700 + " " * 900)], "doc_id long, text string")
    rows = [*encoding.encode(odd).collect(), *encoding.encode(extra).collect()]
    texts = [r.text for r in [*odd.collect(), *extra.collect()]]
    assert sorted(map(str, (r.ids for r in rows))) == sorted(str(reference.encode_ordinary(t)) if t else "[]" for t in texts)
    assert encoding.encode(odd.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in encoding.count_tokens(extra).collect()} == {r.doc_id: len(r.ids) for r in encoding.encode(extra).collect()}


def test_round_trip_and_long_pieces(reference):
    encoder = encoding.load_encoder(encoding.vocabulary_path())
    rnd = random.Random(1)
    for n in (2, 17, 130, 511):
        piece = "".join(rnd.choice("abcéñ漢") for _ in range(n))[:n].encode()
        assert encoder.merge_long(piece) == encoder.merge_matrix([piece, b"ab"])[0]


# --- 9 ---


def test_mixing(spark, odd):
    rnd = random.Random(2)
    rows = [(i, " ".join(story(rnd, rnd.randint(1, 60))), rnd.choice(["Big ", "big", "BIG", "mid", "small-one" if i % 9 == 0 else "big", None])) for i in range(600)]
    targets = [("m", "big", 0.5, 2), ("m", "mid", 0.3, 1), ("m", "small_one", 0.1, 4), ("m", "absent", 0.1, 3), (None, "big", 1.0, 1), ("n", "mid", 1.0, 3)]
    df, t = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(df.repartition(5), t)
    got = chosen.collect()
    assert sorted((r.mix_name, r.doc_id, r.repeat) for r in got) == sorted((r.mix_name, r.doc_id, r.repeat) for r in mixing.mix(df.repartition(2), t)[0].collect())
    by = {(r.mix_name, r.source): r for r in shares.collect()}
    assert by["m", "absent"].tokens == 0 and set(by) == {(m, s) for m, s, *_ in targets if m}
    for (m, s), r in by.items():
        mine = [x for x in got if x.mix_name == m and x.source == s]
        assert r.tokens == sum(x.n_tokens for x in mine) and r.tokens <= r.max_repeats * r.available_tokens
        assert max([x.repeat for x in mine], default=-1) < r.max_repeats
        counts = Counter(x.doc_id for x in mine)
        assert not counts or max(counts.values()) - min([counts[d] for d in counts]) <= r.max_repeats
    m = [r for (n, _), r in by.items() if n == "m"]
    assert sum(r.tokens for r in m) <= m[0].budget and sum(r.tokens for r in m) > 0.9 * m[0].budget
    for r in m:
        want = r.target_share / 0.9 if r.source != "absent" else 0
        assert abs(r.actual_share - want) < 0.03
    total = 0
    for x in sorted((x for x in got if x.mix_name == "m"), key=lambda x: x.total_tokens):
        total += x.n_tokens
        assert x.total_tokens == total
    assert mixing.mix(odd, t)[0].count() == mixing.mix(odd, t.limit(0))[0].count() == 0 and mixing.mix(df.limit(0), t)[0].count() == 0
    assert mixing.mix(df, t.limit(0))[1].count() == 0


@pytest.mark.parametrize("budget", [1000, 3000, 6000, 14_000])
def test_mixing_fills_a_budget_that_one_source_cannot_share(spark, budget):
    rows = [(i, "boat " * 21, "small") for i in range(5)] + [(10 + i, "lamp " * 49, "big") for i in range(255)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([("m", "small", 0.9, 1), ("m", "big", 0.1, 1)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(df, t, budget=budget)
    by = {r.source: r for r in shares.collect()}
    total = sum(r.tokens for r in by.values())
    assert total <= budget and total >= min(budget, sum(r.available_tokens for r in by.values())) - 55
    assert by["small"].tokens <= by["small"].available_tokens and chosen.count() == sum(r.copies for r in by.values())


# --- 10 ---


def repeats(text):
    w, seen, n, k = normalized_words(text), set(), 0, 0
    for i in range(len(w) - 4):
        x = tuple(w[i : i + 5])
        n, k = n + 1, k + (x in seen)
        seen.add(x)
    return len(w), n, k


def test_repetition(spark, odd):
    rnd = random.Random(9)
    texts = [*corpus(21, 40), *(" ".join(story(rnd, 12) * rnd.randint(1, 4)) for _ in range(40)), "a b c d e " * 4, "one two three " * 6]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_runs, r.repeated_runs) for r in repetition.repetition_stats(df).collect()}
    assert got == {i: repeats(t) for i, t in enumerate(texts)}
    assert {r.doc_id for r in repetition.repetitive(df).collect()} == {i for i, (w, n, k) in got.items() if w >= 20 and k >= 0.3 * n}
    stats = repetition.repetition_stats(odd).collect()
    assert len(stats) == 10 and all(r.repeated_share == 0 for r in stats if r.doc_id in (1, 2, 3))
    assert repetition.repetitive(odd.limit(0)).count() == 0


def test_line_frequency(spark, odd):
    rows = [(i, f"Shared notice {i}!\nown text of row {'x' * i}\n\n", "a" if i % 2 else "b") for i in range(30)] + [(99, "shared NOTICE 5", "a"), (98, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in repetition.line_frequency(df, max_docs=10).collect()}
    assert all(got[i].removed_lines == 1 and got[i].n_lines == 2 for i in range(30))
    assert got[99].depleted and not got[29].depleted and got[98].n_lines == 0 and not got[98].depleted
    spread = {r.doc_id: tuple(r) for r in repetition.line_frequency(df, max_docs=10, broadcast_rows=0).collect()}
    assert spread == {k: tuple(v) for k, v in got.items()}
    assert repetition.line_frequency(odd.limit(0)).count() == 0 and repetition.line_frequency(odd.filter("doc_id <> 4")).count() == 7


def test_line_frequency_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    df = table(spark, "/root/testdata/sf0.01", "documents")
    found = con.execute(repetition.line_frequency_sql(max_docs=1))
    columns = [d[0] for d in found.description]
    rows = repetition.line_frequency(df, max_docs=1).select(*columns).collect()
    assert sorted(map(tuple, rows)) == sorted(found.fetchall()) and sum(r.removed_lines for r in rows) > 0


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"p10_line_frequency", "p6_sample"}))
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "prepared_docs", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    rows = queries.queries()[name](spark, sf).select(*columns).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, found.fetchall())) and (rows or name == "p7_found")


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_run(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() >= 0


def test_nothing_else_imports_llm():
    import sievewright

    root = os.path.dirname(sievewright.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "sievewright.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
