"""A logistic quality classifier over document statistics and hashed character n-grams."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions.units import code_points, mix64
from sievewright.operators.splits import label_hold_out
from sievewright.session import cut

DENSE = 8
#: Rows to fit on at most: more are sampled by a hash of the text. The held-out metrics always cover all rows.
MAX_EXAMPLES = 10_000
ROWS = 256


@lru_cache(maxsize=500_000)
def _slot(gram: str, tail: int) -> tuple[int, float]:
    digest = hashlib.blake2b(gram.encode("utf-8", "replace"), digest_size=8).digest()
    return DENSE + int.from_bytes(digest[:4], "little") % tail, 1.0 if digest[4] & 1 else -1.0


def _char_flags(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point whether it is a letter, a digit, punctuation."""
    distinct, where = np.unique(points, return_inverse=True)
    chars = [chr(c) for c in distinct.tolist()]
    kinds = ([c.isalpha() for c in chars], [c.isdigit() for c in chars], [unicodedata.category(c)[0] == "P" for c in chars])
    return tuple(np.array(k, dtype=bool)[where] for k in kinds)


def _grams(padded: list[str], points: np.ndarray, starts: np.ndarray, dim: int) -> np.ndarray:
    """(texts, dim): signed counts of hashed 3- to 5-grams. Only distinct grams of the batch are hashed."""
    n_docs, text = len(padded), "".join(padded)
    doc = np.repeat(np.arange(n_docs), np.diff(starts))
    cells, signs = [], []
    for n in (3, 4, 5):
        size = len(points) - n + 1
        if size <= 0:
            continue
        at = np.flatnonzero(doc[:size] == doc[n - 1 :])
        key = np.zeros(size, dtype=np.uint64)
        for j in range(n):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + points[j : j + size].astype(np.uint64) + np.uint64(1))
        _, first, where = np.unique(key[at], return_index=True, return_inverse=True)
        known = [_slot(text[i : i + n], dim - DENSE) for i in at[first].tolist()]
        slots, sign = np.array([k[0] for k in known], dtype=np.int64), np.array([k[1] for k in known])
        cells.append(doc[at] * dim + slots[where])
        signs.append(sign[where])
    if not cells:
        return np.zeros((n_docs, dim))
    return np.bincount(np.concatenate(cells), weights=np.concatenate(signs), minlength=n_docs * dim).reshape(n_docs, dim)


def features(texts: list[str], dim: int) -> np.ndarray:
    """(texts, dim): eight statistics, then signed counts of hashed 3- to 5-grams scaled to length 1."""
    if dim < 32:
        raise ValueError("at least 32 features")
    folded = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip() for t in texts]
    padded = [f"  {t}  " for t in folded]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in padded]))).astype(np.int64)
    points = code_points("".join(padded))
    out = _grams(padded, points, starts, dim)
    norm = np.linalg.norm(out[:, DENSE:], axis=1, keepdims=True)
    out[:, DENSE:] /= np.where(norm > 0, norm, 1.0)
    count = lambda flag: np.add.reduceat(flag.astype(np.int64), starts[:-1]) if len(texts) else np.zeros(0)
    visible = np.maximum(1, count(points != ord(" ")))
    for i, flag in enumerate(_char_flags(points)):
        out[:, 1 + i] = count(flag) / visible
    for i, t in enumerate(folded):
        words = re.findall(r"[^\W_]+", t)
        n_words = max(1, len(words))
        out[i, 0] = np.log1p(len(t)) / 10
        out[i, 4] = len(set(words)) / n_words
        out[i, 5] = sum(map(len, words)) / n_words / 20
        out[i, 6] = min(10, t.count("http") + t.count("www.")) / 10
        out[i, 7] = min(10, max(Counter(re.findall(r"(.)\1{3}", t, re.S)).values(), default=0)) / 10
    return out


class QualityClassifier:
    def __init__(self, dim: int = 2048):
        self.dim, self.weights, self.bias = dim, np.zeros(dim), 0.0

    @staticmethod
    def _probability(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, texts: list[str], labels: list[int], epochs: int = 40, rate: float = 0.1, l2: float = 1e-4) -> QualityClassifier:
        """Full-batch gradient descent with balanced class weights; at most MAX_EXAMPLES rows."""
        if len(texts) > MAX_EXAMPLES:
            raise ValueError(f"at most {MAX_EXAMPLES} examples; sample them first")
        x = np.concatenate([features(texts[i : i + ROWS], self.dim).astype(np.float32) for i in range(0, len(texts), ROWS)])
        y = np.asarray(labels, dtype=float)
        n, positives = len(y), y.sum()
        balance = np.where(y == 1, n / max(1.0, 2 * positives), n / max(1.0, 2 * (n - positives)))
        for epoch in range(epochs):
            error = (self._probability(x @ self.weights + self.bias) - y) * balance
            step = rate / np.sqrt(1 + epoch / 10)
            self.weights = self.weights - step * (x.T @ error / n + l2 * self.weights)
            self.bias -= step * float(error.mean())
        return self

    def score_texts(self, texts) -> np.ndarray:
        texts = list(texts)
        parts = [self._probability(features(texts[i : i + ROWS], self.dim) @ self.weights + self.bias) for i in range(0, len(texts), ROWS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def score(self, df: DataFrame, text_col: str, out: str = "quality_score") -> DataFrame:
        """Adds the score of each text, null for null."""
        shared = df.sparkSession.sparkContext.broadcast((self.dim, self.weights, self.bias))

        @F.pandas_udf(T.DoubleType())
        def scored(values: pd.Series) -> pd.Series:
            model = QualityClassifier(shared.value[0])
            _, model.weights, model.bias = shared.value
            live = values.notna()
            out = pd.Series([None] * len(values), index=values.index, dtype="float64")
            out[live] = model.score_texts(values[live])
            return out

        return df.withColumn(out, scored(F.col(text_col)))

    def dumps(self, report: dict | None = None) -> str:
        return json.dumps({"bias": self.bias, "format_version": 1, "report": report or {}, "weights": self.weights.tolist()}, sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> QualityClassifier:
        found = json.loads(text)
        if found["format_version"] != 1:
            raise ValueError("unknown format")
        model = cls(len(found["weights"]))
        model.weights, model.bias = np.array(found["weights"]), found["bias"]
        return model


def classifier_metrics(df: DataFrame, label_col: str, score_col: str, threshold: float) -> DataFrame:
    """One row (examples, accuracy, precision, recall); empty denominators count as 1."""
    said, is_ = F.col(score_col) >= threshold, F.col(label_col) == 1
    tp, fp, fn = (F.count_if(c) for c in (said & is_, said & ~is_, ~said & is_))
    one = F.lit(1)
    return df.agg(F.count("*").alias("examples"), F.avg((said == is_).cast("double")).alias("accuracy"), (tp / F.greatest(one, tp + fp)).alias("precision"), (tp / F.greatest(one, tp + fn)).alias("recall"))


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """(label, examples, weight): rows over twice the rows of the label."""
    total = df.agg(F.count("*").alias("n"))
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("examples"))
    return counts.crossJoin(F.broadcast(total)).select("label", "examples", (F.col("n") / (2.0 * F.col("examples"))).alias("weight"))


def check_examples(df: DataFrame) -> DataFrame:
    """The examples (text, label), stripped; fewer than 8, fewer than 4 of a class, or bad rows are an error."""
    rows = df.withColumn("text", F.trim("text"))
    row = rows.agg(F.count_if(F.coalesce(F.col("text"), F.lit("")) == "").alias("empty"), F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("bad"), F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones")).first()
    if row.bad or row.empty:
        raise ValueError("examples need a text and a label 0 or 1")
    if row.zeros + row.ones < 8 or min(row.zeros, row.ones) < 4:
        raise ValueError("at least 8 examples and 4 of each label")
    return rows


def train_classifier(df: DataFrame, dim: int = 2048, epochs: int = 40, rate: float = 0.1, threshold: float = 0.5, max_examples: int = MAX_EXAMPLES) -> tuple[QualityClassifier, dict]:
    """Model and held-out report from examples (text, label).

    A quarter of each label is held out and scored as a whole on the cluster. The model is fitted on the rest, or on
    the `max_examples` of it that come first by a hash of the text.
    """
    parts = cut(label_hold_out(check_examples(df).select("text", "label"), "text", "label"))
    fit = parts.filter("split = 'train'").orderBy(F.sha2("text", 256), "label").limit(max_examples).collect()
    model = QualityClassifier(dim).fit([r["text"] for r in fit], [r["label"] for r in fit], epochs, rate)
    found = classifier_metrics(model.score(parts.filter("split = 'validation'"), "text"), "label", "quality_score", threshold).first().asDict()
    return model, {"train_examples": len(fit), "validation_examples": found.pop("examples"), **found}
