"""Likelihood reports with a pluggable scorer: every token of a document is scored once, in rolling windows.

A scorer is any picklable callable (context ids, first target, end) -> log probabilities of tokens[first:end], given
the ids of the window that ends there. `NgramScorer` is a small one, fitted by counts on the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators.bpe import EOS_ID
from sievewright.operators.reports import corpus_loss, ensemble_summary
from sievewright.operators.spans import sample_windows
from sievewright.session import cut

Scorer = Callable[[Sequence[int], int, int], np.ndarray]
MAX_NGRAMS = 2_000_000


def document_windows(n: int, seq_len: int, stride: int) -> Iterator[tuple[int, int, int]]:
    """(context start, target start, target end) over n tokens behind one end id."""
    for first in range(0, n, stride):
        end = min(n, first + stride)
        yield max(0, end - seq_len), first, end


def score_tokens(tokens: Sequence[int], scorer: Scorer, seq_len: int, stride: int) -> np.ndarray:
    """Log probabilities of all tokens; the first is conditioned on an end id alone."""
    stream = [EOS_ID, *tokens]
    parts = [scorer(stream[context : end + 1], first + 1 - context, end + 1 - context) for context, first, end in document_windows(len(tokens), seq_len, stride)]
    return np.concatenate(parts) if parts else np.zeros(0)


class NgramScorer:
    """Bigrams smoothed by unigrams, both by additive counts."""

    def __init__(self, unigrams: dict[int, int], bigrams: dict[tuple[int, int], int], vocab_size: int, strength: float = 10.0):
        self.uni, self.bi, self.size, self.strength = unigrams, bigrams, vocab_size, strength
        self.total = sum(unigrams.values())
        self.heads: dict[int, int] = {}
        for (left, _), n in bigrams.items():
            self.heads[left] = self.heads.get(left, 0) + n

    def __call__(self, window: Sequence[int], first: int, end: int) -> np.ndarray:
        out = np.empty(end - first)
        for i in range(first, end):
            p = (self.uni.get(window[i], 0) + 1) / (self.total + self.size)
            if i:
                left = window[i - 1]
                p = (self.bi.get((left, window[i]), 0) + self.strength * p) / (self.heads.get(left, 0) + self.strength)
            out[i - first] = math.log(p)
        return out


def fit_ngrams(df: DataFrame, tokens_col: str, vocab_size: int, max_ngrams: int = MAX_NGRAMS) -> NgramScorer:
    """Counts on the cluster; only the counts come to the driver, and more than `max_ngrams` of them are an error."""
    rows = _bigrams(df, tokens_col).groupBy("l", "r").agg(F.count("*").alias("n")).limit(max_ngrams + 1).collect()
    if len(rows) > max_ngrams:
        raise ValueError(f"more than {max_ngrams} bigrams; fit on less text")
    bigrams = {(r["l"], r["r"]): r["n"] for r in rows}
    unigrams: dict[int, int] = {}
    for (_, right), n in bigrams.items():
        unigrams[right] = unigrams.get(right, 0) + n
    return NgramScorer(unigrams, bigrams, vocab_size)


def _bigrams(df: DataFrame, tokens_col: str) -> DataFrame:
    """(l, r): each token behind the one before it, the first behind an end id."""
    zipped = df.select(F.concat(F.array(F.lit(EOS_ID)), tokens_col).alias("l"), F.col(tokens_col).alias("r"))
    return zipped.select(F.inline(F.arrays_zip("l", "r"))).filter("r is not null")


def log_likelihoods(df: DataFrame, id_col: str, tokens_col: str, scorers: dict[str, Scorer], seq_len: int, stride: int) -> DataFrame:
    """(id, n_tokens, a sum of log probabilities for each scorer) of every row; two scorers also give `mixed`, the sum
    over tokens of their even mixture. Rows without tokens have zeros."""
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(scorers))
    names = list(scorers)
    kind = df.schema[id_col].dataType.simpleString()
    pair = len(names) == 2

    def run(batches):
        members = list(cloudpickle.loads(shared.value).values())
        for pdf in batches:
            rows = []
            for key, tokens in zip(pdf[id_col], pdf[tokens_col]):
                found = [score_tokens(list(tokens) if tokens is not None else [], s, seq_len, stride) for s in members]
                rows.append((key, len(found[0]), *[float(x.sum()) for x in found], *([float((np.logaddexp(*found) - math.log(2)).sum())] if pair else [])))
            yield pd.DataFrame(rows, columns=[id_col, "n_tokens", *names, *(["mixed"] if pair else [])])

    sums = ", ".join(f"`{n}` double" for n in [*names, *(["mixed"] if pair else [])])
    return df.select(id_col, tokens_col).mapInPandas(run, f"`{id_col}` {kind}, n_tokens bigint, {sums}")


def evaluate(df: DataFrame, id_col: str, text_col: str, tokens_col: str, scorer: Scorer, seq_len: int, stride: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (by `by`): tokens, loss, perplexity and bits per byte of a held-out corpus; each token is counted once."""
    scored = log_likelihoods(df, id_col, tokens_col, {"score": scorer}, seq_len, stride)
    sizes = df.select(id_col, *by, F.octet_length(F.coalesce(text_col, F.lit(""))).alias("bytes"), F.size(tokens_col).alias("expected"))
    joined = scored.join(sizes, id_col)
    whole = F.when(F.col("n_tokens") == F.col("expected"), -F.col("score")).otherwise(F.raise_error(F.lit("a document was not scored as a whole")).cast("double"))
    return corpus_loss(joined.withColumn("loss", whole), "loss", "n_tokens", "bytes", by)


def evaluate_windows(df: DataFrame, id_col: str, tokens_col: str, scorer: Scorer, seq_len: int, draws: int, seed: int) -> DataFrame:
    """One row (windows, tokens, loss, perplexity): `draws` windows of seq_len tokens at random places, by the mass of
    valid starts of each document; windows are drawn with replacement and may overlap."""
    sized = df.select(id_col, tokens_col, F.size(tokens_col).cast("bigint").alias("_n"), F.lit(0).alias("_tier"))
    drawn = cut(sample_windows(sized, id_col, "_n", "_tier", id_col, draws, seq_len, None, seed))
    cutting = drawn.join(sized, id_col).select(F.col("draw"), F.slice(tokens_col, F.col("window_start").cast("int") + 1, F.lit(seq_len + 1)).alias("_w"))
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(scorer))

    def run(batches):
        score = cloudpickle.loads(shared.value)
        for pdf in batches:
            sums = [float(score(list(w), 1, len(w)).sum()) for w in pdf["_w"]]
            yield pd.DataFrame({"tokens": [len(w) - 1 for w in pdf["_w"]], "loss": [-x for x in sums]})

    scored = cutting.mapInPandas(run, "tokens bigint, loss double")
    loss = F.sum("loss") / F.sum("tokens")
    return scored.agg(F.count("*").alias("windows"), F.sum("tokens").alias("tokens"), loss.alias("loss"), F.exp(F.least(loss, F.lit(20.0))).alias("perplexity"))


def evaluate_ensemble(df: DataFrame, id_col: str, tokens_col: str, scorers: dict[str, Scorer], seq_len: int, stride: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (by `by`) that compares two scorers with their even mixture."""
    if len(scorers) != 2:
        raise ValueError("an ensemble has two members")
    scored = log_likelihoods(df, id_col, tokens_col, scorers, seq_len, stride).filter("n_tokens > 0")
    if by:
        scored = scored.join(df.select(id_col, *by), id_col)
    return ensemble_summary(scored, id_col, list(scorers), "n_tokens", by)
