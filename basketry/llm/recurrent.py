"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins the vector of the word (one shared vector for words
outside the vocabulary) and the mean vector of its character n-grams of 3 to
5 bytes, marked at both ends and hashed to ``BUCKETS`` rows, so unseen words
have an input too.  A window of ``WIDTH`` words runs through one recurrent
unit forwards and one backwards; attention weighs the joined states, and
their weighted mean gives one logit.

As the recurrent unit sees a word's input only through one linear map, that
map is applied once a distinct word (``Words``), not once an occurrence.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WIDTH = 32
STRIDE = 16
STATE = 8
WORD = 8
CHARS = 12
BUCKETS = 1 << 14
GRAMS = (3, 4, 5)


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, and where each word's begin (every word has
    one at least: shorter than 3 bytes means shorter than its marks allow)."""
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint32)
    ends = np.repeat(np.cumsum(sizes), sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(raw))
    codes, owner = [], []
    h = np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        size = len(raw) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint32(0x01000193) ^ raw[n - 1:n - 1 + size]
        if n in GRAMS:
            inside = place[:size] + n <= ends[:size]
            mixed = h[inside] * np.uint32(0x9E3779B1)
            codes.append((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BUCKETS))
            owner.append(word[:size][inside])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    codes, owner = np.concatenate(codes).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return codes[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def window_starts(n: int) -> np.ndarray:
    """Starts of all windows of a text of n words: each overlaps the next by
    WIDTH - STRIDE words, the last holds the last word."""
    return np.arange(0, max(1, n - WIDTH + STRIDE) if n > WIDTH else 1, STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by the row of the result they go to."""
    out = np.zeros((n, values.shape[1]), dtype=values.dtype)
    order = np.argsort(at, kind="stable")
    present, starts = np.unique(at[order], return_index=True)
    if len(present):
        out[present] = np.add.reduceat(values[order], starts, axis=0)
    return out


@dataclass
class Inputs:
    """Words by their rows, and the buckets codes[at[i]:at[i + 1]] of word i."""

    rows: np.ndarray
    codes: np.ndarray
    at: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        return (1 / np.sqrt(np.diff(self.at))).astype(np.float32)[:, None]

    def part(self, words: np.ndarray) -> Inputs:
        sizes = np.diff(self.at)[words]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return Inputs(self.rows[words], self.codes[np.repeat(self.at[words] - ends[:-1], sizes) + np.arange(ends[-1])], ends)


@dataclass
class Network:
    """``words``: word -> row of ``word``; row 0 stands for all others."""

    words: dict[bytes, int]
    params: dict[str, np.ndarray] = field(default_factory=dict)
    #: Logit that scores as the threshold asks (set after training).
    cut: float = 0.0

    @classmethod
    def new(cls, words: dict[bytes, int], seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)

        def random(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)
        h = STATE
        bias = np.zeros(6 * h, np.float32)
        bias[:h] = bias[3 * h:4 * h] = -1.0  # states change readily at first
        return cls(words, {
            "word": random(len(words) + 1, WORD, scale=0.05), "chars": random(BUCKETS, CHARS, scale=0.3),
            "inputs": random(WORD + CHARS, 6 * h, scale=0.4), "bias": bias,
            "forwards": random(h, 3 * h, scale=0.3), "backwards": random(h, 3 * h, scale=0.3),
            "attention": random(2 * h, scale=0.3), "out": random(2 * h, scale=0.3), "offset": np.zeros(1, np.float32)})

    def looked_up(self, words: list[bytes]) -> Inputs:
        rows = np.fromiter((self.words.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        return Inputs(rows, *char_grams(words))

    def inputs(self, of: Inputs) -> np.ndarray:
        """The joined vectors of words."""
        sums = np.add.reduceat(self.params["chars"][of.codes], of.at[:-1], axis=0)
        return np.concatenate((self.params["word"][of.rows], sums * of.scale), axis=1)

    def project(self, words: list[bytes]) -> np.ndarray:
        return self.inputs(self.looked_up(words)) @ self.params["inputs"] + self.params["bias"]

    def run(self, projected: np.ndarray, ids: np.ndarray, there: np.ndarray | None, keep: bool = False):
        """Logits of windows: ids (WIDTH, windows) are rows of ``projected``;
        ``there`` is False at places beyond a text's end."""
        h, (size, n) = STATE, ids.shape
        x = projected[ids]
        states = np.empty((size, n, 2 * h), dtype=np.float32)
        kept = []
        for side, name in enumerate(("forwards", "backwards")):
            u, state = self.params[name], np.zeros((n, h), dtype=np.float32)
            for t in range(size) if side == 0 else range(size - 1, -1, -1):
                g = state @ u
                now = x[t, :, 3 * h * side:3 * h * (side + 1)]
                gates = _sigmoid(now[:, :2 * h] + g[:, :2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(now[:, 2 * h:] + r * g[:, 2 * h:])
                after = new + z * (state - new)
                if there is not None:
                    after = np.where(there[t][:, None], after, state)
                if keep:
                    kept.append((side, t, state, gates, new, g[:, 2 * h:]))
                states[t, :, h * side:h * (side + 1)] = state = after
        e = states @ self.params["attention"]
        if there is not None:
            e = np.where(there, e, np.float32(-1e9))
        weight = np.exp(e - e.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logits = pooled @ self.params["out"] + self.params["offset"][0]
        return (logits, (states, weight, pooled, kept)) if keep else logits

    def gradients(self, of: Inputs, ids: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss of windows over the words ``of`` and its
        gradients; ids count these words."""
        h, p = STATE, self.params
        inputs = self.inputs(of)
        projected = inputs @ p["inputs"] + p["bias"]
        logits, (states, weight, pooled, kept) = self.run(projected, ids, there, keep=True)
        guess = _sigmoid(logits)
        loss = float(np.mean(np.logaddexp(0, logits) - y * logits))
        d_logit = ((guess - y) / len(y)).astype(np.float32)
        out = {"out": pooled.T @ d_logit, "offset": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        out["attention"] = np.einsum("tn,tnh->h", d_e, states)
        d_states = weight[:, :, None] * d_pooled + d_e[:, :, None] * p["attention"]
        d_x = np.empty((*ids.shape, 6 * h), dtype=np.float32)
        back = {"forwards": np.zeros((h, 3 * h), np.float32), "backwards": np.zeros((h, 3 * h), np.float32)}
        d_state, last = np.zeros((ids.shape[1], h), np.float32), None
        for side, t, state, gates, new, g in reversed(kept):
            if side != last:
                d_state, last = np.zeros_like(d_state), side
            u, du = (p["forwards"], back["forwards"]) if side == 0 else (p["backwards"], back["backwards"])
            d_after = d_state + d_states[t, :, h * side:h * (side + 1)]
            here = there[t][:, None]
            d_here = d_after * here
            z, r = gates[:, :h], gates[:, h:]
            d_new = d_here * (1 - z) * (1 - new * new)
            d_gates = np.concatenate((d_here * (state - new), d_new * g), axis=1) * gates * (1 - gates)
            d_g = np.concatenate((d_gates, d_new * r), axis=1)
            d_x[t, :, 3 * h * side:3 * h * (side + 1)] = np.concatenate((d_gates, d_new), axis=1)
            du += state.T @ d_g
            d_state = d_here * z + d_after * ~here + d_g @ u.T
        out |= back
        d_projected = _sums(d_x.reshape(-1, 6 * h), ids.ravel(), len(of.rows))
        out["bias"] = d_projected.sum(axis=0)
        out["inputs"] = inputs.T @ d_projected
        d_inputs = d_projected @ p["inputs"].T
        out["word"] = _sums(d_inputs[:, :WORD], of.rows, len(p["word"]))
        out["chars"] = _sums(np.repeat(d_inputs[:, WORD:] * of.scale, np.diff(of.at), axis=0), of.codes, BUCKETS)
        return loss, out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.steps = params, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients.values()))
        shrink = np.float32(min(1.0, 1.0 / max(norm, 1e-12)))
        rate = self.rate * np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        for k, g in gradients.items():
            g = g * shrink
            self.mean[k] += np.float32(0.1) * (g - self.mean[k])
            self.square[k] += np.float32(0.001) * (g * g - self.square[k])
            self.params[k] -= np.float32(rate) * self.mean[k] / (np.sqrt(self.square[k]) + np.float32(1e-8))


class Words:
    """Projected inputs of the words met most recently, as rows of one array;
    emptied when it passes ``limit`` words, so memory is bounded."""

    def __init__(self, network: Network, limit: int = 200_000):
        self.network, self.limit = network, limit
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.projected = np.zeros((1024, 6 * STATE), dtype=np.float32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.rows) > self.limit:
            self.clear()
        rows = self.rows
        new = list(set(words).difference(rows))
        if new:
            n = len(rows)
            rows.update(zip(new, range(n, n + len(new))))
            if len(rows) > len(self.projected):
                more = np.zeros((2 * len(rows), 6 * STATE), dtype=np.float32)
                more[:n] = self.projected[:n]
                self.projected = more
            for i in range(0, len(new), 20_000):
                part = new[i:i + 20_000]
                self.projected[n + i:n + i + len(part)] = self.network.project(part)
        return np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))

    def logits(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """Of the windows that begin at ``starts``, in texts that end before ``ends``."""
        out = np.empty(len(starts), dtype=np.float32)
        whole = starts + WIDTH <= ends
        reach = np.arange(WIDTH)[:, None]
        for full in (True, False):
            mine = np.flatnonzero(whole == full)
            for i in range(0, len(mine), at_once):
                part = mine[i:i + at_once]
                places = starts[part] + reach
                there = None if full else places < ends[part]
                if not full:
                    places = np.minimum(places, ends[part] - 1)
                out[part] = self.network.run(self.projected, ids[places], there)
        return out

    def best(self, texts: list[list[bytes]]) -> np.ndarray:
        """The largest logit of each text's windows; -inf without words."""
        out = np.full(len(texts), -np.inf)
        i = 0
        while i < len(texts):  # about a million words at once, one text at least
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= 1_000_000):
                size += len(texts[j])
                j += 1
            part = [k for k in range(i, j) if texts[k]]
            i = j
            if not part:
                continue
            ids = self.ids([w for k in part for w in texts[k]])
            ends = np.cumsum([len(texts[k]) for k in part])
            counts, starts = [], []
            for k, end in zip(part, ends.tolist()):
                at = window_starts(len(texts[k]))
                starts.append(at + (end - len(texts[k])))
                counts.append(len(at))
            found = self.logits(ids, np.concatenate(starts), np.repeat(ends, counts))
            out[part] = np.maximum.reduceat(found, np.concatenate(([0], np.cumsum(counts)[:-1])))
        return out
