"""Brute-force versions of the contracts, on plain Python rows."""

import base64
import hashlib
import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def simhash(rows):
    """[(doc_id, text)] -> [(doc_id, fingerprint, component_id)]"""
    prints = []
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate(A_TO_Z))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        prints.append((doc_id, fp))
    distinct = sorted({fp for _, fp in prints})
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for doc_id, fp in prints:
        if doc_id is not None:
            least[root(fp)] = min(least.get(root(fp), doc_id), doc_id)
    return [(d, f"{fp:016x}", least.get(root(fp))) for d, fp in prints]


def repeats(rows, width=13):
    """[(doc_id, text)] -> [(doc_id, n_words, n_removed, kept_sha256)]"""
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - width + 1):
                g = tuple(w[i:i + width])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - width + 1):
                if first[tuple(w[i:i + width])] < d:
                    gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def edited(rows):
    """[(doc_id, text)] -> [(doc_id, n_chars, edited text, next text)]"""
    order = sorted(((d, t or "") for d, t in rows if d is not None))
    out = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(t) // 4
        out.append((d, len(t), t[:len(t) - k] + after[:k], after))
    return out + [(None, len(t or ""), (t or "")[:len(t or "") - len(t or "") // 4], "") for d, t in rows if d is None]


def shingles(text, n=5):
    words = WORD.findall(text)
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def hard_negatives(rows, anchor, k=5):
    """[(vec_id, vector of whole numbers, label)] -> the contract's rows"""
    out = []
    last = (True, 0)

    def order(x):
        return (-x[0], last if x[1] is None else (False, x[1]))
    for i, (a, va, la) in enumerate(rows):
        if a is None or not anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(va, v)), b, lab == la) for j, (b, v, lab) in enumerate(rows) if j != i and len(v) == len(va)]
        for p, pid, _ in sorted((x for x in scored if x[2]), key=order)[:k]:
            fit = sorted((x for x in scored if not x[2] and 80 * p <= 100 * x[0] <= 100 * p), key=order)[:k]
            out += [(a, pid, place, b, p, s) for place, (s, b, _) in enumerate(fit, 1)]
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=50):
    """[(doc_id, text)], [(item_id, text)] -> [(item_id, rank, doc_id, score)]"""
    split = [(d, TERM.findall((t or "").translate(A_TO_Z))) for d, t in docs]
    n, length = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = {}
    for _, w in split:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        asked, scored = set(TERM.findall((text or "").translate(A_TO_Z))), []
        for d, w in split:
            m = 50 + 50 * len(w) * n // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in asked if t in w)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, place, d, -s) for place, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def fingerprint(text, scale=2):
    """The sketch by its definition, in plain integers."""
    full = 1 << 64
    codes = [xxhash.xxh64_intdigest(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    width, found = min(5, len(codes)), set()
    for i in range(len(codes) - width + 1 if codes else 0):
        h = 0
        for c in codes[i:i + width]:
            h = (h * 0x9E3779B97F4A7C15 + c) % full
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % full
        h = (h ^ h >> 27) * 0x94D049BB133111EB % full
        found.add((h ^ h >> 31) >> 16)
    return base64.b64encode(b"".join(h.to_bytes(6, "big") for h in sorted(found) if h * scale < 1 << 48)).decode()
