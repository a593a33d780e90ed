"""Toxicity: a text is as toxic as the worst of its windows, each judged by a
bidirectional gated recurrent network with attention pooling
(``recurrent.py``); all overlapping windows of the whole text are scored.

Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased.
The network is trained on a sample of about ``FIT_DOCS`` labelled documents
(as many of either label if there are), of each at most ``FIT_WINDOWS``
windows, evenly spaced.  Labels are known for documents, not for windows: the
first round takes windows of either label at random, the later ones the
windows that the network holds for the most toxic of each document (and
random ones of clean documents).  Then the logit that best parts the two
labels of the sample is set to score ``TOXIC``.

Defined results: null text counts as empty; a text without words scores 0.0;
where only one label (or none) can be learned from every score is 0.0; null
labels and labels without a document teach nothing; repeated rows of a
document are learned from once and scored each; further columns stay as they
are.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.langid import bounded_sample, held_out
from basketry.llm.recurrent import WIDTH, Adam, Inputs, Network, Words, window_starts
from basketry.llm.text import LOWER_ALNUM, as_bytes, release_memory, words

#: Expected number of labelled documents in the fit.
FIT_DOCS = 3_000
#: Windows of a document in the fit.
FIT_WINDOWS = 32
#: Documents of the sample that must hold a word for it to have a vector.
HOLDERS = 4
#: Share of the known words of a batch that count as unseen in training.
UNSEEN = 0.25
ROUNDS = 5
BATCH = 256
#: Score of the logit that parts the labels.
TOXIC = 0.3


def tokens(raw: bytes | None) -> list[bytes]:
    return words(raw.translate(LOWER_ALNUM)) if raw else []


def _sampled(text: list[bytes]) -> list[list[bytes]]:
    """At most FIT_WINDOWS windows of a text, evenly spaced."""
    starts = window_starts(len(text))
    if len(starts) > FIT_WINDOWS:
        starts = starts[np.linspace(0, len(starts) - 1, FIT_WINDOWS).astype(int)]
    return [text[s:s + WIDTH] for s in starts.tolist()]


def packed(raw: bytes | None) -> bytes:
    """A text's windows for the fit, one a line; empty without words."""
    return b"\n".join(b" ".join(window) for window in _sampled(tokens(raw)))


def _windows(text: pa.Array) -> pa.Array:
    return pa.array([packed(raw) for raw in as_bytes(text)], pa.binary())


def _train(network: Network, adam: Adam, inputs: Inputs, ids: np.ndarray, there: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> float:
    """One pass over windows; ids and there are (windows, WIDTH)."""
    order, losses = rng.permutation(len(ids)), []
    for i in range(0, len(order), BATCH):
        part = order[i:i + BATCH]
        words_, inverse = np.unique(ids[part], return_inverse=True)
        of = inputs.part(words_)
        # now and then a known word is taken for an unseen one
        of.rows = np.where(rng.random(len(of.rows)) < UNSEEN, 0, of.rows)
        loss, gradients = network.gradients(of, inverse.reshape(len(part), WIDTH).T, there[part].T, y[part])
        losses.append(loss)
        adam.step(gradients)
    return float(np.mean(losses))


def learn(documents: list[tuple[int, bytes]], rounds: int = ROUNDS, seed: int = 1) -> Network | None:
    """A network from (label, ``packed`` text) of documents; None without
    both labels."""
    documents = [(y, text) for y, text in documents if text]
    labels = np.array([y for y, _ in documents])
    if len(set(labels.tolist())) < 2:
        return None
    number: dict[bytes, int] = {}
    holders: Counter = Counter()
    counts, flat, lengths = [], [], []
    for _, text in documents:
        windows = text.split(b"\n")
        of = [[number.setdefault(w, len(number)) for w in window.split()] for window in windows]
        holders.update({w for window in of for w in window})
        counts.append(len(of))
        lengths += map(len, of)
        flat.append(np.array([w for window in of for w in window], dtype=np.int32))
    names = list(number)
    # numbered in order of their text, whatever the order of the documents
    network = Network.new({w: i + 1 for i, w in enumerate(sorted(names[k] for k, n in holders.items() if n >= HOLDERS))}, seed)
    adam, rng = Adam(network.params), np.random.default_rng(seed)
    inputs = network.looked_up(names)
    del names, number, holders
    owner = np.repeat(np.arange(len(documents)), counts)
    first = np.searchsorted(owner, np.arange(len(documents)))
    there = np.arange(WIDTH) < np.array(lengths)[:, None]
    ids = np.zeros(there.shape, dtype=np.int32)
    ids[there] = np.concatenate(flat)
    of_owner = np.array(counts)[owner]
    rate = adam.rate
    for turn in range(rounds + 1):
        chance = rng.random(len(ids))
        worth = chance
        if turn:
            projected = network.inputs(inputs) @ network.params["inputs"] + network.params["bias"]
            worth = np.concatenate([network.run(projected, ids[i:i + 2048].T, there[i:i + 2048].T) for i in range(0, len(ids), 2048)])
            worth = worth.astype(np.float64)
        # the places of a document's windows, worst first
        order = np.lexsort((-worth, owner))
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids)) - first[owner[order]]
        toxic = labels[owner] == 1
        if turn == 0:
            taken = place < 4
        elif turn < rounds:
            taken = np.where(toxic, (place == 0) | ((place < 4) & (worth > 0)), (place < 2) | (chance < 2 / of_owner))
        else:
            best = np.maximum.reduceat(worth, first)
            network.cut = _parting(best[labels == 0], best[labels == 1])
            break
        adam.rate = rate * (1 - 0.7 * turn / rounds)
        at = np.flatnonzero(taken)
        for _ in range(2 if turn == 0 else 1):
            _train(network, adam, inputs, ids[at], there[at], toxic[at].astype(np.float32), rng)
    return network


def _parting(clean: np.ndarray, toxic: np.ndarray) -> float:
    """A logit in the best gap between the two labels, near the toxic
    ones, as unseen clean texts are many."""
    values = np.unique(np.concatenate((clean, toxic)))
    middles = np.concatenate((values[:1] - 1, (values[1:] + values[:-1]) / 2, values[-1:] + 1))
    wrong = np.searchsorted(np.sort(toxic), middles) / len(toxic) + 1 - np.searchsorted(np.sort(clean), middles) / len(clean)
    best = middles[wrong <= wrong.min() + 1e-12]
    return float(0.15 * best[0] + 0.85 * best[-1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        fit_docs: int = FIT_DOCS) -> Network | None:
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("y"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
    sample = bounded_sample(marked, ["doc_id"], fit_docs, "y")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # the sample's size is bounded by fit_docs
    rows = rows.join(F.broadcast(sample), "doc_id")
    # once more, as many documents may have one id
    rows = bounded_sample(rows, ["doc_id", "text"], fit_docs, "y").orderBy(F.xxhash64("doc_id", "text"), "y")
    rows = rows.select("y", F.arrow_udf(_windows, "binary")(F.col("text")).alias("windows")).collect()
    return learn([(r["y"], bytes(r["windows"])) for r in rows])


#: The words met by the network in use, by the network's name: a worker
#: process keeps them between tasks.
_WORDS: dict[str, Words] = {}


def _words(name: str, network) -> Words:
    if name not in _WORDS:
        _WORDS.clear()
        _WORDS[name] = Words(network.value)
    return _WORDS[name]


def scores(docs: DataFrame, network: Network | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (an input column of that
    name is replaced)."""
    if network is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    key = uuid.uuid4().hex
    shift = network.cut - math.log(TOXIC / (1 - TOXIC))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        found = _words(key, shared).best([tokens(raw) for raw in as_bytes(column)])
        release_memory()
        return pa.array(1 / (1 + np.exp(np.minimum(shift - found, 700))) * np.isfinite(found))
    return docs.withColumn(name, score(F.col(text)))
