"""Problem 1: per-document text statistics and fixed-threshold rules that tell prose from lists, tables and junk."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.units import ALNUM, CJK, MARK, SEPARATOR, Units, char_classes, mix64, split_units, unit_blocks
from sievewright.llm.arrow import column, map_batches, values

# Common function words of the corpus languages.
COMMON_WORDS = {
    "en": "the of and to in a is was that for it with as on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any my now such like our over me even most made after also did many before must through back where much your well down should because each just those how too good nobody until while near",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man dann soll weil während obwohl bevor damit denn niemand",
    "fr": "le la les de des du un une et en à que qui dans ce il au pas ne sur se pour plus par je avec tout faire son mettre autre on mais nous comme ou si leur y dire elle devoir avant deux même prendre aussi celui donner bien où fois vous encore nouveau aller cela entre premier vouloir déjà grand mon quand aux était été l d s n car puis jusqu afin parce tandis près",
    "es": "el la los las de del un una y en a que no se por con su para como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo al lo fue era aunque mientras nadie cerca pues luego",
}

MIN_CHARS = 60
MIN_PROSE_SHARE = 0.5
# Fixed thresholds of the line rules.
MIN_ALPHA_SHARE = 0.70
MAX_DIGIT_SHARE = 0.20
MAX_DIGIT_SHARE_CJK = 0.40
MAX_WORDS_BY_COMMA = 3.2
MAX_COMMON_SHARE_ROW = 0.20
MAX_SYMBOL_SHARE = 0.15
MIN_COMMON_SHARE = 0.06
LONG_LINE_WORDS = 25
MIN_COMMON_SHARE_LONG = 0.20
MIN_COMMON_SHARE_LOOP = 0.10
MAX_DISTINCT_LOOP = 0.35
LONG_LINE_CHARS = 60
MAX_SYMBOL_SHARE_LONG = 0.08
MIN_LINE_WORDS = 3
MEAN_PLAIN_WORDS = 5.5
MEAN_ITEM_WORDS = 8.5
SHORT_LINE_WORDS = 16
MIN_COMMON_SHARE_UNENDED = 0.18
MIN_DELIMITED_LINES = 0.6
MIN_CJK = 6
MIN_CJK_UNENDED = 16
MIN_CJK_RUN = 4.0
#: Reasons in the order in which they are tried; a line has the first that holds.
REASONS = ("few_letters", "many_digits", "many_symbols", "delimited", "few_common_words", "too_short", "list_item", "cjk_fragment")

_NEWLINES = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  " + SEPARATOR
_TAG = re.compile(r"<[^<>\n]{1,80}>|&[a-z]{2,8};|&#\d{1,6};|<\|[^|\n]{1,40}\|>")
_ITEM = re.compile(r"^\s*(?:[-*+•–—·‣◦]\s|\[[ x]?\]|\(?(?:\d{1,3}|[a-z]|[ivx]{1,4})[.):]\s)| [/+–—-] |: |\(\d+ ?\w{1,4}\)")


@lru_cache(maxsize=1)
def common_hashes() -> np.ndarray:
    words = sorted({w for text in COMMON_WORDS.values() for w in text.split()})
    return np.sort(split_units([" ".join(words)]).hashes)


@lru_cache(maxsize=1)
def _newline_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[ord(c) for c in _NEWLINES]] = True
    return table


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 space, 1 letter or mark, 2 digit, 3 sentence punctuation, 4 symbol."""
    import sys

    table = np.full(sys.maxunicode + 1, 4, dtype=np.uint8)
    classes = char_classes()
    table[(classes == ALNUM) | (classes == CJK) | (classes == MARK)] = 1
    for code in np.flatnonzero(classes == ALNUM).tolist():
        if not chr(code).isalpha():
            table[code] = 2
    for code in range(0x3100):
        if chr(code).isspace():
            table[code] = 0
    table[[ord(c) for c in ".,;:!?'\"()-–—’‘“”„«»¿¡…、。，！？；："]] = 3
    return table


def clean_markup(text: str | None) -> str | None:
    return _TAG.sub(" ", text) if text and ("<" in text or "&" in text) else text


def _per(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    running = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return running[end] - running[start]


def line_table(units: Units) -> dict[str, np.ndarray]:
    """Statistics of every line of a block: an array per statistic."""
    points = units.points
    breaks = np.flatnonzero(_newline_table()[points])
    start, end = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(points)]))
    doc = np.searchsorted(np.flatnonzero(points == ord(SEPARATOR)), start, side="left")
    kinds = _kinds()[points]
    cjk = char_classes()[points] == CJK
    run_start = cjk & np.concatenate(([True], ~cjk[:-1])) if len(cjk) else cjk
    delimiters = np.isin(points, [ord(c) for c in "\t;|="])
    first, last = np.searchsorted(units.start, start), np.searchsorted(units.start, end)
    common = np.concatenate(([0], np.cumsum(np.isin(units.hashes, common_hashes()))))
    endings = np.isin(points, [ord(c) for c in ".!?。…"])
    out = {
        "doc": doc,
        "start": start,
        "end": end,
        "chars": _per(kinds != 0, start, end),
        "letters": _per(kinds == 1, start, end),
        "digits": _per(kinds == 2, start, end),
        "punctuation": _per(kinds == 3, start, end),
        "symbols": _per(kinds == 4, start, end),
        "cjk": _per(cjk, start, end),
        "cjk_runs": _per(run_start, start, end),
        "cjk_ends": _per(np.isin(points, [ord(c) for c in "。!?"]), start, end),
        "delimiters": _per(delimiters, start, end),
        "separators": _per(np.isin(points, [ord(c) for c in "\t;|"]), start, end),
        "commas": _per(points == ord(","), start, end),
        "words": last - first,
        "common": common[last] - common[first],
    }
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(units.hashes)))
    again = np.unique((sums[last] - sums[first]) ^ mix64(doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    out["first"] = np.zeros(len(start), bool)
    out["first"][again] = True
    solid = np.flatnonzero(kinds != 0)
    at = np.searchsorted(solid, end) - 1
    tail = solid[np.maximum(at, 0)] if len(solid) else np.zeros(len(start), np.int64)
    quotes = np.isin(points, [ord(c) for c in "\"'”»’)"])
    if len(points):
        out["ends"] = (out["chars"] > 0) & (endings[tail] | (quotes[tail] & endings[np.maximum(tail - 1, 0)]))
    else:
        out["ends"] = np.zeros(len(start), bool)
    # of long lines with few common words: those that say a phrase again and again
    out["loop"] = np.zeros(len(start), bool)
    share = out["common"] / np.maximum(out["words"], 1)
    for i in np.flatnonzero((out["words"] >= LONG_LINE_WORDS) & (share >= MIN_COMMON_SHARE_LOOP) & (share < MIN_COMMON_SHARE_LONG)).tolist():
        own = units.hashes[first[i] : last[i]]
        out["loop"][i] = len(np.unique(own)) <= MAX_DISTINCT_LOOP * len(own)
    short = np.flatnonzero((out["words"] > 0) & (out["words"] <= SHORT_LINE_WORDS))
    out["item"] = np.zeros(len(start), bool)
    text, find = units.text, _ITEM.search
    out["item"][short] = [find(text[a:b]) is not None for a, b in zip(start[short].tolist(), end[short].tolist())]
    return out


def line_reasons(lines: dict[str, np.ndarray], n_docs: int) -> np.ndarray:
    """By line 0 for prose, else 1 + the index of the first rule of REASONS that it breaks."""
    chars = np.maximum(lines["chars"], 1)
    words, doc, cjk = lines["words"], lines["doc"], lines["cjk"]
    is_cjk = cjk * 2 > lines["letters"]
    latin = ~is_cjk
    share = lines["common"] / np.maximum(words, 1)
    wordy = words >= LONG_LINE_WORDS
    rules = [
        latin & (lines["letters"] / chars < MIN_ALPHA_SHARE),
        lines["digits"] / chars > np.where(lines["cjk"] >= MIN_CJK, MAX_DIGIT_SHARE_CJK, MAX_DIGIT_SHARE),
        lines["symbols"] / chars > np.where(lines["chars"] >= LONG_LINE_CHARS, MAX_SYMBOL_SHARE_LONG, MAX_SYMBOL_SHARE),
        ((lines["delimiters"] >= 2) & (lines["delimiters"] * 12 >= words + cjk))
        | (latin & (lines["commas"] >= 2) & ~lines["ends"] & (words <= MAX_WORDS_BY_COMMA * (lines["commas"] + 1)) & (share <= MAX_COMMON_SHARE_ROW)),
        latin & (((words >= 8) & (share < np.where(wordy, np.where(lines["loop"], MIN_COMMON_SHARE_LOOP, MIN_COMMON_SHARE_LONG), MIN_COMMON_SHARE))) | ((words >= 5) & (lines["common"] == 0))),
        latin & (words < MIN_LINE_WORDS),
    ]
    alike = latin & ~np.logical_or.reduce(rules) & (words > 0)
    item, plain = alike & lines["item"], alike & ~lines["item"]

    def mean(mask: np.ndarray) -> np.ndarray:
        mask = mask & lines["first"]
        n = np.bincount(doc[mask], minlength=n_docs)
        return np.bincount(doc[mask], weights=words[mask], minlength=n_docs) / np.maximum(n, 1)

    separated = latin & (lines["separators"] > 0) & ~lines["ends"] & (words > 0)
    filled = np.bincount(doc[words > 0], minlength=n_docs)
    rows = np.bincount(doc[separated], minlength=n_docs)
    rules[3] = rules[3] | (separated & ((rows >= 3) & (rows >= MIN_DELIMITED_LINES * filled))[doc])
    unended = alike & ~lines["ends"] & (words <= SHORT_LINE_WORDS)
    once = unended & lines["first"]  # a line that is said again counts once
    n = np.bincount(doc[once], minlength=n_docs)
    mean_share = np.bincount(doc[once], weights=share[once], minlength=n_docs) / np.maximum(n, 1)
    rules[4] = rules[4] | (unended & ((n >= 3) & (mean_share < MIN_COMMON_SHARE_UNENDED))[doc])
    rules.append((item & (mean(item)[doc] < MEAN_ITEM_WORDS)) | (plain & (mean(plain)[doc] < MEAN_PLAIN_WORDS)))
    run = cjk / np.maximum(lines["cjk_runs"], 1)
    rules.append(is_cjk & ((cjk < MIN_CJK) | ((lines["cjk_ends"] == 0) & (cjk < MIN_CJK_UNENDED)) | (run < MIN_CJK_RUN)))
    reason = np.zeros(len(words), dtype=np.int64)
    for i in range(len(rules) - 1, -1, -1):
        reason[rules[i]] = i + 1
    return reason


# Thresholds of published filters. Rae et al. 2021 (Gopher), Raffel et al. 2020 (C4), Penedo et al. 2024 (FineWeb).
GOPHER_WORDS, GOPHER_WORD_LENGTH, GOPHER_SYMBOLS, GOPHER_BULLETS, GOPHER_ELLIPSES, GOPHER_ALPHA = (50, 100_000), (3, 10), 0.1, 0.9, 0.3, 0.8
GOPHER_STOP_WORDS, GOPHER_STOP_COUNT = "the be to of and that have with", 2
C4_SENTENCES, C4_LINE_WORDS = 3, 5
FINEWEB_ENDED, FINEWEB_SHORT_CHARS, FINEWEB_SHORT, FINEWEB_REPEATED = 0.12, 30, 0.67, 0.1
#: Published rules that a document can break, in the order of `published_rules`.
PUBLISHED = (
    "gopher_word_count", "gopher_word_length", "gopher_symbols", "gopher_bullets", "gopher_ellipses", "gopher_alpha_words", "gopher_stop_words",
    "c4_sentences", "c4_braces", "c4_lorem_ipsum", "c4_lines", "fineweb_ended_lines", "fineweb_short_lines", "fineweb_repeated_lines",
)


def published_rules(units: Units, lines: dict[str, np.ndarray], n: int) -> np.ndarray:
    """(documents, rules of PUBLISHED): which rules each document of a block breaks; one without characters breaks none.

    c4_lines: less than half of the characters are in lines that end in punctuation and have C4_LINE_WORDS words, the
    lines that C4 keeps. gopher_stop_words is of English and breaks in all other languages.
    """
    points, doc, kinds = units.points, lines["doc"], _kinds()[units.points]
    of_unit, full = units.doc, lines["chars"] > 0
    total = lambda mask, weights=None: np.bincount(doc[mask], weights=None if weights is None else weights[mask], minlength=n)
    sums = np.concatenate(([0], np.cumsum(kinds == 1)))
    words = np.maximum(units.counts, 1)
    alpha = np.bincount(of_unit[sums[units.end] > sums[units.start]], minlength=n)
    length = np.bincount(of_unit, weights=units.end - units.start, minlength=n) / words
    stops = sum((np.bincount(of_unit[units.hashes == h], minlength=n) > 0).astype(int) for h in split_units([GOPHER_STOP_WORDS]).hashes.tolist())
    dots = points == ord(".")
    triple = dots[:-2] & dots[1:-1] & dots[2:] & ~np.concatenate(([False], dots[:-3])) if len(points) > 2 else dots[:0]
    signs = (points == ord("#")) | (points == 0x2026)
    signs[np.flatnonzero(triple)] = True
    count = np.maximum(total(full), 1)
    solid = np.flatnonzero(kinds != 0)
    head = solid[np.minimum(np.searchsorted(solid, lines["start"]), max(len(solid) - 1, 0))] if len(solid) else np.zeros(len(doc), np.int64)
    tail = solid[np.maximum(np.searchsorted(solid, lines["end"]) - 1, 0)] if len(solid) else np.zeros(len(doc), np.int64)
    at = lambda where, chars: full & np.isin(points[where], [ord(c) for c in chars]) if len(points) else full
    ellipsis = at(tail, "…") | (at(tail, ".") & (dots[np.maximum(tail - 1, 0)] & dots[np.maximum(tail - 2, 0)] if len(points) else full))
    chars = np.maximum(total(full, lines["chars"]), 1)
    good = full & lines["ends"] & (lines["words"] >= C4_LINE_WORDS)
    ends = np.isin(points, [ord(c) for c in ".!?。！？"])
    sentence_ends = np.flatnonzero(ends & ~np.concatenate((ends[1:], [False]))) if len(points) else np.zeros(0, np.int64)
    borders = np.flatnonzero(points == ord(SEPARATOR))
    per_doc = lambda where: np.bincount(np.searchsorted(borders, where, side="left"), minlength=n)[:n]
    lorem = np.zeros(n, dtype=bool)
    if "lorem ipsum" in units.text:
        lorem = per_doc(np.array([m.start() for m in re.finditer("lorem ipsum", units.text)])) > 0
    short = full & (lines["end"] - lines["start"] < FINEWEB_SHORT_CHARS)
    rules = [
        (units.counts < GOPHER_WORDS[0]) | (units.counts > GOPHER_WORDS[1]),
        (length < GOPHER_WORD_LENGTH[0]) | (length > GOPHER_WORD_LENGTH[1]),
        per_doc(np.flatnonzero(signs)) / words > GOPHER_SYMBOLS,
        total(at(head, "-*+•–—·‣◦")) / count > GOPHER_BULLETS,
        total(ellipsis) / count > GOPHER_ELLIPSES,
        alpha / words < GOPHER_ALPHA,
        stops < GOPHER_STOP_COUNT,
        per_doc(sentence_ends) < C4_SENTENCES,
        per_doc(np.flatnonzero(points == ord("{"))) > 0,
        lorem,
        total(good, lines["chars"]) / chars < MIN_PROSE_SHARE,
        total(full & lines["ends"]) / count <= FINEWEB_ENDED,
        total(short) / count >= FINEWEB_SHORT,
        total(full & ~lines["first"], lines["chars"]) / chars >= FINEWEB_REPEATED,
    ]
    return np.stack(rules, axis=1) & (total(full) > 0)[:, None]


STATS = "n_chars bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_share double, digit_share double, alpha_share double, punctuation_share double, ended_line_share double, item_line_share double, common_share double, prose_share double, reasons array<string>, published array<string>"


def text_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", published: bool = True) -> DataFrame:
    """(id, statistics, prose_share, reasons) of every row, without a shuffle.

    Lengths and shares count the normalised text without markup and white space; n_chars is the length of the
    raw text. prose_share is the share of characters in lines that break no rule, 1 for texts without characters.
    reasons: rules by which lines were judged not to be prose, sorted by name; published: rules of published filters
    that the document breaks (`published_rules`), which prose_share does not use. Both are empty for null and empty texts.
    Repeated rows stay repeated; other columns are dropped; an empty table gives an empty one.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch):
        texts, ids = column(batch, text_col), values(batch, id_col)
        for low, high, units in unit_blocks([clean_markup(t) for t in texts]):
            n = high - low
            lines = line_table(units)
            reason, doc = line_reasons(lines, n), lines["doc"]
            total = {k: np.bincount(doc, weights=lines[k], minlength=n) for k in ("chars", "letters", "digits", "punctuation", "symbols", "words", "common")}
            full = lines["chars"] > 0
            count = np.bincount(doc[full], minlength=n)
            prose = np.bincount(doc[reason == 0], weights=lines["chars"][reason == 0], minlength=n)
            chars, words = np.maximum(total["chars"], 1), np.maximum(total["words"], 1)
            named: list[list[str]] = [[] for _ in range(n)]
            for key in np.unique(doc[full & (reason > 0)] * 16 + reason[full & (reason > 0)]).tolist():
                named[key // 16].append(REASONS[key % 16 - 1])
            yield {
                id_col: ids.slice(low, n),
                "n_chars": [len(t or "") for t in texts[low:high]],
                "n_words": total["words"].astype(np.int64),
                "n_lines": count,
                "mean_word_length": (total["letters"] + total["digits"]) / words,
                "symbol_share": total["symbols"] / chars,
                "digit_share": total["digits"] / chars,
                "alpha_share": total["letters"] / chars,
                "punctuation_share": total["punctuation"] / chars,
                "ended_line_share": np.bincount(doc[full & lines["ends"]], minlength=n) / np.maximum(count, 1),
                "item_line_share": np.bincount(doc[full & lines["item"]], minlength=n) / np.maximum(count, 1),
                "common_share": total["common"] / words,
                "prose_share": np.where(total["chars"] > 0, prose / chars, 1.0),
                "reasons": [sorted(x) for x in named],
                "published": [[PUBLISHED[i] for i in np.flatnonzero(row)] for row in published_rules(units, lines, n)] if published else [[]] * n,
            }

    return map_batches(df.select(id_col, text_col), kernel, f"`{id_col}` {kind}, {STATS}")


def not_prose(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_share: float = MIN_PROSE_SHARE) -> DataFrame:
    """Ids of rows of at least `min_chars` characters of which less than `min_share` are in prose lines."""
    stats = text_quality(df, id_col, text_col, published=False)
    return stats.filter((F.col("n_chars") >= min_chars) & (F.col("prose_share") < min_share)).select(id_col)


def rule_counts(stats: DataFrame, min_chars: int = MIN_CHARS, min_share: float = MIN_PROSE_SHARE) -> DataFrame:
    """(rule, published, documents, not_prose): by rule how many rows of text_quality break it, and how many of these
    not_prose has. A rule that no row breaks has no row."""
    dropped = (F.col("n_chars") >= min_chars) & (F.col("prose_share") < min_share)
    named = lambda c, k: F.transform(c, lambda x: F.struct(x.alias("rule"), F.lit(k).alias("published")))
    rules = F.concat(named("reasons", False), named("published", True))
    return stats.select(dropped.alias("d"), F.explode(rules).alias("r")).groupBy("r.rule", "r.published").agg(F.count("*").alias("documents"), F.count_if("d").alias("not_prose"))
