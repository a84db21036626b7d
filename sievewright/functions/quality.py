"""Rule reasons and prose-form scores as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions.text import SPACE

# A word of the prose score, and the weights, windows and scales of its parts.
PROSE_WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’][\p{L}\p{Nl}\p{No}]+)?"
WEIGHTS = {"length": 0.15, "alphabetic": 0.15, "sentence": 0.25, "unique": 0.30, "trigram": 0.15}
WINDOW = 256
IDEAL_SENTENCE = 25.0


def alpha_ratio(text: Column) -> Column:
    visible = F.length(F.regexp_replace(text, f"[{SPACE}]+", ""))
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.greatest(visible, F.lit(1))


def drop_reason(text: Column, profile: Column, min_words: int, min_alpha: float) -> Column:
    """too_few_words, low_alpha_ratio, repetitive_text in this order, or null for a pass."""
    return (
        F.when(profile["n_units"] < min_words, "too_few_words")
        .when(alpha_ratio(text) < min_alpha, "low_alpha_ratio")
        .when((profile["n_units"] > 4) & (profile["n_distinct"] == 1), "repetitive_text")
    )


def _windows(words: Column) -> Column:
    n = F.size(words)
    three = F.array(F.lit(1), F.floor((n - WINDOW) / 2).cast("int") + 1, n - WINDOW + 1)
    return F.transform(F.when(n <= WINDOW, F.array(F.lit(1))).otherwise(three), lambda s: F.slice(words, s, WINDOW))


def _mean(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)


def _unique(w: Column) -> Column:
    return F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)).cast("double")


def _trigrams(w: Column) -> Column:
    n = F.greatest(F.size(w) - 2, F.lit(0))
    grams = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " ")))
    return F.size(F.array_distinct(grams)) / F.greatest(n, F.lit(1)).cast("double")


def prose_features(text: Column, digits: int | None = 8) -> dict[str, Column]:
    """Columns word_count, utf8_bytes, length_score, alphabetic_score, sentence_density, unique_word_ratio,
    trigram_uniqueness and score of a text that is not null, half-even to `digits`; an empty text has the least values."""
    found = F.regexp_extract_all(text, F.lit(PROSE_WORD), 0)
    words = F.transform(found, lambda w: F.replace(F.lower(w), F.lit("ß"), F.lit("ss")))
    n = F.size(words)
    marks = F.greatest(F.length(F.regexp_replace(text, "[^.!?]+", "")), F.lit(1))
    per_sentence = F.greatest(n / marks, F.lit(1.0))
    sentence = 1 / (1 + F.abs(F.ln(per_sentence / IDEAL_SENTENCE)))
    length = F.least(F.lit(1.0), n / float(WINDOW))
    alpha = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (alpha_ratio(text) - 0.55) / 0.40))
    windows = _windows(words)
    unique, trigram = _mean(F.transform(windows, _unique)), _mean(F.transform(windows, _trigrams))
    parts = {"length": length, "alphabetic": alpha, "sentence": sentence, "unique": unique, "trigram": trigram}
    score = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    cut = lambda c: c if digits is None else F.bround(c, digits)
    names = {"length": "length_score", "alphabetic": "alphabetic_score", "sentence": "sentence_density", "unique": "unique_word_ratio", "trigram": "trigram_uniqueness"}
    return {"word_count": n.cast("bigint"), "utf8_bytes": F.octet_length(text).cast("bigint"), **{names[k]: cut(v) for k, v in parts.items()}, "score": cut(score)}
