"""Language identification by words, backing off to character n-grams.

A word is a run of letters, lower-cased.  A known word scores its log
frequency in each language; an unseen one the mean log frequency of its
longest n-grams that are known: those of 5 characters, else of 4, and so on
down to 1 (the word with a mark at either end).  A document's score is the
posterior of its words under equal priors.

The model is fitted on a sample of about ``FIT_DOCS`` labelled documents (a
hash of id and text against a threshold of their language, so that rare
languages are learned too; equal rows count once) and keeps every word and n-gram of
them, so that a language with few documents loses none to the others.  Counts
are summed in Spark, per batch first.  A caller may ask for the ``known`` most
frequent words and as many n-grams of each length only, ties in order of
their text.

Defined results: null text, or text without a letter, is ``und`` with score
0.0; so is every text where nothing was learned; equal posteriors go to the
first language in code-point order; null labels teach nothing.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.text import release_memory

#: Expected number of documents in the fit.
FIT_DOCS = 10_000
LONGEST = 5
SMOOTHING = 0.5
_WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _level(counts: list[int], size: int) -> float:
    """The most rows of a label so that all labels together have ``size``."""
    left = size
    for i, n in enumerate(sorted(counts)):
        if n > left / (len(counts) - i):
            return left / (len(counts) - i)
        left -= n
    return float(max(counts, default=0))


def bounded_sample(rows: DataFrame, key: list[str], size: int, label: str) -> DataFrame:
    """About ``size`` of the distinct rows, at most, by a hash of ``key``.
    Labels with few rows keep them all; the others have about as many each."""
    code = F.xxhash64(*key)
    counts = rows.groupBy(label).agg(F.approx_count_distinct(code).alias("__n")).checkpoint()
    most = _level([r["__n"] for r in counts.select("__n").collect()], size)
    share = F.lit(float(1 << 30)) * F.lit(most) / F.col("__n")
    taken = rows.join(F.broadcast(counts), label).where(F.pmod(code, F.lit(1 << 30)) < share)
    return taken.select(*rows.columns).distinct()


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            found[lang].update(_WORDS.findall(text.lower()))
        rows = []
        for lang, counted in found.items():
            rows += [(0, w, lang, n) for w, n in counted.items()]
            for length in range(1, LONGEST + 1):
                of_length: Counter = Counter()
                for w, n in counted.items():
                    for g in grams(w, length):
                        of_length[g] += n
                rows += [(length, g, lang, n) for g, n in of_length.items()]
        for i in range(0, len(rows), 50_000):
            part = list(zip(*rows[i:i + 50_000]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0], pa.int32()), pa.array(part[1], pa.string()), pa.array(part[2], pa.string()), pa.array(part[3], pa.int64())],
                ["kind", "gram", "lang", "n"])


@dataclass
class Model:
    langs: list[str]
    #: For kind 0 (words) and each n-gram length: text -> row of ``rows``.
    known: list[dict[str, int]]
    #: Log frequencies by language.
    rows: np.ndarray

    def vector(self, word: str) -> np.ndarray:
        found = self.known[0].get(word)
        if found is not None:
            return self.rows[found]
        for n in range(LONGEST, 0, -1):
            of_length = self.known[n]
            parts = [i for g in grams(word, n) if (i := of_length.get(g)) is not None]
            if parts:
                return self.rows.take(parts, axis=0).sum(axis=0) / np.float32(len(parts))
        return np.zeros(len(self.langs), dtype=np.float32)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        fit_docs: int = FIT_DOCS, known: int | None = None) -> Model:
    """A model from the labelled rows of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = bounded_sample(rows.where("lang IS NOT NULL AND text IS NOT NULL"), ["doc_id", "text"], fit_docs, "lang")
    counted = rows.select("text", "lang").mapInArrow(_counts, "kind int, gram string, lang string, n long")
    counted = counted.groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n")).checkpoint()
    sums = counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
    found = counted
    if known is not None:
        totals = counted.groupBy("kind", "gram").agg(F.sum("n").alias("total"))
        best = Window.partitionBy("kind").orderBy(F.col("total").desc(), "gram")
        kept = totals.withColumn("place", F.row_number().over(best)).where(F.col("place") <= known)
        found = counted.join(kept, ["kind", "gram"]).select("kind", "gram", "lang", "n")
    langs = sorted({r["lang"] for r in sums})
    size = {(r["kind"], r["lang"]): r["n"] for r in sums}
    place = {name: i for i, name in enumerate(langs)}
    counts: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
    for r in found.toLocalIterator():
        by_lang = counts[r["kind"]].setdefault(r["gram"], np.zeros(len(langs), dtype=np.float32))
        by_lang[place[r["lang"]]] = r["n"]
    for kind, by_gram in enumerate(counts):
        low = np.array([math.log(size.get((kind, name), 0) + SMOOTHING * (len(by_gram) + 1)) for name in langs], dtype=np.float32)
        for g, n in by_gram.items():
            by_gram[g] = np.log(n + np.float32(SMOOTHING)) - low
    rows = [v for by_gram in counts for v in by_gram.values()]
    number = iter(range(len(rows)))
    numbered = [{g: next(number) for g in by_gram} for by_gram in counts]
    return Model(langs, numbered, np.array(rows, dtype=np.float32).reshape(len(rows), len(langs)))


class _Scorer:
    """Word vectors met so far, as rows of one array; emptied at ``limit`` words."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self):
        self.rows: dict[str, int] = {}
        self.vectors = np.empty((1024, len(self.model.langs)), dtype=np.float32)

    def row(self, word: str) -> int:
        i = self.rows.get(word)
        if i is None:
            i = self.rows[word] = len(self.rows)
            if i == len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.empty_like(self.vectors)))
            self.vectors[i] = self.model.vector(word)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        found = _WORDS.findall(text.lower()) if text else []
        if not self.model.langs or not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0
        if len(self.rows) > self.limit:
            self.clear()
        known = self.rows
        at = [known[w] if w in known else self.row(w) for w in found]
        total = self.vectors[at].sum(axis=0, dtype=np.float64)
        share = np.exp(total - total.max())
        share /= share.sum()
        i = int(share.argmax())
        return self.model.langs[i], float(share[i])


#: The scorer of the model in use, by the model's name: a worker process
#: keeps it, and the words it has met, between tasks.
_SCORERS: dict[str, _Scorer] = {}


def _scorer(name: str, model) -> _Scorer:
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = _Scorer(model.value)
    return _SCORERS[name]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (input columns of these names are
    replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def judge(column: pa.Array) -> pa.Array:
        scorer = _scorer(name, shared)
        found = [scorer.predict(t) for t in column.to_pylist()]
        release_memory()
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                                          ["lang_pred", "score"])

    out = docs.withColumn("__found", F.arrow_udf(judge, "struct<lang_pred:string,score:double>")(F.col(text)))
    return out.withColumns({"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found")
