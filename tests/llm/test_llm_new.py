"""Cover trees and hard negatives, the recurrent network, shared ranked search."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import covertree, negatives, recurrent, search, toxicity

# ---- cover trees


def forest(rng, n, size, spread, labels=4):
    points = np.unique(np.array([[rng.randint(-spread, spread) for _ in range(size)] for _ in range(n)], dtype=np.int64).reshape(n, size), axis=0)
    points = np.concatenate((points, points[:max(1, len(points) // 5)]))  # equal vectors of several labels
    marks = np.array([rng.randrange(labels) for _ in points])
    ids = [sorted(rng.sample(range(1000), rng.randint(1, 3))) for _ in points]
    return points, marks, ids


@pytest.mark.parametrize("n, size, spread", [(1, 3, 5), (2, 1, 3), (60, 2, 6), (300, 4, 50), (200, 16, 100), (50, 3, 0), (40, 2, 1 << 30)])
def test_tree_finds_what_a_scan_finds(n, size, spread):
    rng = random.Random(n)
    points, labels, ids = forest(rng, n, size, spread)
    tree = covertree.Tree.unpack(covertree.Tree.build(points, labels, ids).pack())
    for _ in range(25):
        q = np.array([rng.randint(-spread, spread) for _ in range(size)], dtype=np.int64)
        scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(p, q))), i, int(y)) for p, y, of in zip(points, labels, ids) for i in of)
        for same in (True, False):
            label, k = rng.randrange(4), rng.randint(1, 6)
            low, high = sorted(rng.choices([-s for s, _, _ in scored], k=2))
            for a, b in ((None, None), (low, high), (high, high), (None, low)):
                want = [(-s, i) for s, i, y in scored if (y == label) == same and (a is None or -s >= a) and (b is None or -s <= b)][:k]
                assert tree.query(q).search(k, label, same, a, b) == want


def test_tree_radii_cover_and_levels_part():
    points, labels, ids = forest(random.Random(2), 400, 3, 40)
    tree = covertree.Tree.build(points, labels, ids)
    at, _ = covertree._unit(points)

    def below(node):
        if tree.first[node] == tree.last[node]:
            return [tree.point[node]]
        return [p for c in range(tree.first[node], tree.last[node]) for p in below(c)]
    assert sorted(below(0)) == list(range(len(points)))
    for node in range(len(tree.point)):
        under = below(node)
        assert covertree._angles(at[tree.point[node]], at[under]).max() <= tree.radius[node] + 1e-7 or len(under) == 1
        assert tree.low_label[node] == labels[under].min() and tree.high_label[node] == labels[under].max()


def test_descent_skips_nodes_on_clustered_vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 1000
    points = np.unique(np.round(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 8))).astype(np.int64), axis=0)
    tree = covertree.Tree.build(points, np.zeros(len(points), np.int64), [[i] for i in range(len(points))])
    q = tree.query(points[7])
    got = q.search(5, 0, True)
    want = sorted(((-int(p @ points[7]), i) for i, p in enumerate(points)))[:5]
    assert got == [(-s, i) for s, i in want]
    assert sum(len(x) for x in q.met.values()) < len(points) / 3


def test_small_trees_and_blocks_give_the_same_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randint(-9, 9) for _ in range(3)], rng.randrange(3)) for i in range(400)] + [(i, [5, 5, 5], 1) for i in range(400, 600)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>, label int").repartition(5)
    anchor = F.col("vec_id") % 40 == 0
    one = sorted(map(tuple, negatives.mine(df, anchor).collect()))
    many = sorted(map(tuple, negatives.mine(df, anchor, tree_rows=60, block=8).collect()))
    assert one == many == sorted(brute.hard_negatives(rows, lambda i: i % 40 == 0))


def test_wide_products_stay_exact(spark):
    big = 1 << 28
    rows = [(0, [big, big - 1], 1), (1, [big, big - 2], 1), (2, [big, big - 3], 2), (3, [big - 1, big - 3], 2)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>, label int")
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") == 0).collect())) == sorted(brute.hard_negatives(rows, lambda i: i == 0))


# ---- the recurrent network

def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = recurrent.Network.new({b"abc": 1, b"zz": 2})
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    of = net.looked_up([b"abc", b"zz", b"q", b"hello", "é".encode()])
    ids, there = rng.integers(0, 5, (recurrent.WIDTH, 6)), np.ones((recurrent.WIDTH, 6), bool)
    there[20:, 2] = there[1:, 4] = False
    y = np.array([0, 1, 1, 0, 1, 0.0])
    _, gradients = net.gradients(of, ids, there, y)
    for name, g in gradients.items():
        flat = net.params[name].reshape(-1)
        for i in np.argsort(-np.abs(g.reshape(-1)))[:3]:
            kept, ends = flat[i], []
            for step in (1e-3, -1e-3):
                flat[i] = kept + step
                ends.append(net.gradients(of, ids, there, y)[0])
            flat[i] = kept
            assert g.reshape(-1)[i] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=2e-3, abs=1e-6)


def test_windows_overlap_and_hold_every_word():
    for n in [*range(1, 120), 1000]:
        starts = recurrent.window_starts(n)
        assert {w for s in starts for w in range(s, min(n, s + recurrent.WIDTH))} == set(range(n))
        assert all(b - a == recurrent.STRIDE for a, b in zip(starts, starts[1:])) and starts[-1] < n
        assert len(starts) == 1 or starts[-2] + recurrent.WIDTH < n


def test_char_grams_by_word():
    words = [b"a", b"abc", "é".encode(), b"abcabc"]
    codes, at = recurrent.char_grams(words)
    for i, w in enumerate(words):
        alone, _ = recurrent.char_grams([w])
        assert sorted(codes[at[i]:at[i + 1]]) == sorted(alone)
        marked = len(w) + 2
        assert len(alone) == sum(max(0, marked - n + 1) for n in recurrent.GRAMS)


def test_a_text_scores_as_its_worst_window_however_it_is_batched():
    rng = random.Random(1)
    net = recurrent.Network.new({b"w1": 1})
    texts = [[f"w{rng.randrange(300)}".encode() for _ in range(n)] for n in (1, 5, 32, 33, 48, 49, 700, 0, 2000)]
    got = recurrent.Words(net).best(texts)
    assert got[7] == -np.inf
    for text, score in zip(texts, got):
        if text:
            alone = []
            for s in recurrent.window_starts(len(text)):
                part = text[s:s + recurrent.WIDTH]
                alone.append(net.run(net.project(part), np.arange(len(part))[:, None], None)[0])
            assert score == pytest.approx(max(alone), abs=1e-4)
    few = recurrent.Words(net, limit=50)
    assert np.allclose(few.best(texts)[:7], got[:7], atol=1e-4)


def insults(n, seed, stem="grumble"):
    """Clean texts, and toxic ones with a few words of one stem in them."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = [rng.choice("abcdefgh") + rng.choice(["lo", "mi", "ta", "ne"]) + str(rng.randrange(60)) for _ in range(rng.randint(5, 150))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = stem + rng.choice("xyzuvw") + rng.choice("klmnp") + str(rng.randrange(9))
        out.append((i, " ".join(text), int(i % 4 == 0)))
    return out


def test_toxic_words_of_an_unseen_ending_are_found(spark):
    rows = insults(800, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    network = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score >= toxicity.TOXIC for r in toxicity.scores(docs, network).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100
    assert np.mean([g for g, y in held if y]) > 0.9 and np.mean([not g for g, y in held if not y]) > 0.95


def test_one_label_teaches_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert [r.score for r in toxicity.scores(docs, None).collect()] == [0.0, 0.0]


# ---- ranked search

def test_shared_sums_equal_plain_sums():
    rng = random.Random(6)
    for n in (0, 1, 2, 30, 120):
        items = [{rng.randrange(int(rng.choice([5, 20, 200]))) for _ in range(rng.randint(0, 30))} for _ in range(n)]
        items += [set(x) for x in items[:5]]
        plan, value = search.Plan.share(items), {t: rng.getrandbits(40) for t in range(200)}
        node = [sum(value[t] for t in s) for s in plan.sets]
        for a, b in plan.pairs:
            node.append(node[a] + node[b])
        assert [sum(node[x] for x in nodes) for nodes in plan.items] == [sum(value[t] for t in item) for item in items]
        if n > 20:
            assert plan.additions() < sum(map(len, items)) * (0.8 if n > 100 else 1)


def test_many_passes_and_small_slices_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(8)
    common = ["the", "of", "and", "to"]
    docs = [(i if i % 17 else None, " ".join(rng.choice(common + [f"t{rng.randrange(80)}"]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, "the same text t1 t2") for i in range(150)] + [(5, None)]
    items = [(i % 7, " ".join(rng.choice(common + [f"T{rng.randrange(90)}"]) for _ in range(rng.randint(0, 12)))) for i in range(20)] + [(None, "t1"), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.ranked(docs, items, 50), key=str)
    assert sorted(map(tuple, search.search(d, q).collect()), key=str) == want
    assert sorted(map(tuple, search.search(d, q, block_words=60).collect()), key=str) == want
    ranker = search.Ranker(search.Plan.share([{0}]), np.array([3]), 10, 100, 2, cells=1)
    ids = np.zeros(200, dtype=search.ID)
    ids["id"] = np.arange(200)[::-1]
    ranker.add(ids, np.full(200, 10), np.arange(200), np.zeros(200, np.int64), np.ones(200, np.int64))
    assert ranker.rows == 64 and ranker.best[0][1]["id"].tolist() == [0, 1]
