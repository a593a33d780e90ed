"""Quality scores by Bradley-Terry ranking: a linear score of text features
is learned from preference pairs (a document labelled 1 over one labelled 0)
by the logistic loss on the difference of their features, then a threshold
is set at a quantile of the scores.

Features are shares and means over the whole text (``FEATURES``).  The fit
uses a sample of about ``FIT_DOCS`` labelled documents, as many of either
label if there are; every one labelled 0
is paired with ``PAIRS_EACH`` labelled 1, in rotation.  The threshold comes
from the scores of all labelled rows that may be learned from: with q the
share of label 0 among them, it lies midway between the quantiles q - 0.5 %
and q + 0.5 %, so that as many are rejected as are labelled 0.  A
document's score is the logistic function of its distance from the
threshold, shifted so that the threshold itself scores ``KEEP``.

Defined results: null text counts as empty; empty texts have features (all
zero) and a score like any other; where no pair can be formed every score is
1.0; null labels and labels without a document teach nothing; a document
with the same label twice is learned from once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import count
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.langid import bounded_sample, held_out
from basketry.llm.text import as_bytes, release_memory

#: Expected number of labelled documents in the fit.
FIT_DOCS = 10_000
PAIRS_EACH = 24
RIDGE = 1e-3
#: Score of the threshold.
KEEP = 0.7
#: Words added to a text's length where repeats are counted, so that one
#: repeat in a text of four words says little.
FEW = 10

FEATURES = ("log_words", "distinct_words", "repeats_of_the_word_before", "most_frequent_word", "word_length", "capitals",
            "capitalised_words", "punctuation", "doubled_punctuation", "words_without_letters", "digits", "sentence_ends",
            "beyond_ascii", "distinct_lines")
_DOUBLED = re.compile(rb"([!-/:-@\[-`{-~])\1")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS = b"0123456789"
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_ASCII = bytes(range(128))
_LETTERLESS = re.compile(rb"(?<![^\s])[!-@\[-`{-~]+(?![^\s])")


def features(raw: bytes | None) -> list[float]:
    words = raw.split() if raw else []
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    none = raw.translate
    upper = size - len(none(None, _UPPER))
    lower = size - len(none(None, _LOWER))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        float(np.log1p(n)),
        1 - (n - len(counts)) / (n + FEW),
        sum(map(bytes.__eq__, words, words[1:])) / (n + FEW),
        (max(counts.values()) - 1) / (n + FEW),
        min(size / n, 40.0) / 10,
        upper / max(upper + lower, 1),
        len(re.findall(rb"(?<![^\s])[A-Z]", raw)) / n,
        (size - len(none(None, _PUNCTUATION))) / size,
        min(len(_DOUBLED.findall(raw)) / n, 2.0),
        len(_LETTERLESS.findall(raw)) / n,
        (size - len(none(None, _DIGITS))) / size,
        (raw.count(b".") + raw.count(b",")) / n,
        len(none(None, _ASCII)) / size,
        len(set(lines)) / max(len(lines), 1),
    ]


def feature_column(text: str) -> Column:
    def found(column: pa.Array) -> pa.Array:
        return pa.array([features(raw) for raw in as_bytes(column)], pa.list_(pa.float64()))
    return F.arrow_udf(found, "array<double>")(F.col(text))


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def learn(x: np.ndarray, y: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = RIDGE) -> Ranking | None:
    """Newton's method on the pairwise logistic loss; None without a pair."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    good, bad = (good - mean) / scale, (bad - mean) / scale
    k = min(pairs_each, len(good))
    loser = np.repeat(np.arange(len(bad)), k)
    stride = next(s for s in count(7919) if gcd(s, len(good)) == 1)  # meets every good document
    winner = (np.arange(len(loser)) * stride) % len(good)
    d = good[winner] - bad[loser]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # probability of the other order
        gradient = d.T @ p / len(d) - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Ranking(mean, scale, w)


def _raw_score(ranking: Ranking, text: str) -> Column:
    def found(column: pa.Array) -> pa.Array:
        x = np.array([features(raw) for raw in as_bytes(column)], dtype=np.float64).reshape(-1, len(FEATURES))
        release_memory()
        return pa.array(ranking.raw(x))
    return F.arrow_udf(found, "double")(F.col(text))


def _labelled(labels: DataFrame, doc_id: str, quality: str) -> DataFrame:
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("int").alias("y"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
        fit_docs: int = FIT_DOCS) -> Ranking | None:
    """The ranking, its threshold not yet set."""
    sample = bounded_sample(_labelled(labels, doc_id, quality), ["doc_id"], fit_docs, "y")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # the sample's size is bounded by fit_docs
    rows = rows.join(F.broadcast(sample), "doc_id")
    # once more, as many documents may have one id
    rows = bounded_sample(rows, ["doc_id", "text"], fit_docs, "y").orderBy(F.xxhash64("doc_id", "text"), "y")
    rows = rows.select("y", feature_column("text").alias("x")).collect()
    if not rows:
        return None
    return learn(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]))


def set_threshold(ranking: Ranking, scored: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> Ranking:
    """From ``scored`` (doc_id, s) and all labels that may be learned from."""
    rows = scored.join(_labelled(labels, doc_id, quality), "doc_id")
    at = rows.agg(F.avg(1 - F.col("y"))).first()[0]
    if at is None:
        return ranking
    a, b = max(0.0, at - 0.005), min(1.0, at + 0.005)
    low, high = rows.agg(F.percentile_approx("s", [a, b], 1_000_000)).first()[0]
    ranking.threshold = (low + high) / 2
    return ranking


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
           fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    ranking = fit(docs, labels, doc_id, text, quality, fit_docs)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if ranking is None:
        return rows.select("doc_id", F.lit(1.0).alias("score"))
    scored = rows.select("doc_id", _raw_score(ranking, "text").alias("s")).checkpoint()
    set_threshold(ranking, scored, labels, doc_id, quality)
    return scored.select("doc_id", _score(F.col("s"), ranking).alias("score"))


def _score(s: Column, ranking: Ranking) -> Column:
    return 1 / (1 + F.exp(-(s - F.lit(ranking.threshold))) * F.lit((1 - KEEP) / KEEP))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
              fit_docs: int = FIT_DOCS) -> DataFrame:
    """The documents that score ``KEEP`` or more, with the columns of ``docs``."""
    ranking = fit(docs, labels, doc_id, text, quality, fit_docs)
    if ranking is None:
        return docs
    s = _raw_score(ranking, text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), s.alias("s"))
    set_threshold(ranking, scored.checkpoint(), labels, doc_id, quality)
    return docs.withColumn("__s", s).where(F.col("__s") >= ranking.threshold).select(*docs.columns)
