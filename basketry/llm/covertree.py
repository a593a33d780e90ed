"""A cover tree over integer vectors, for inner products.

Every vector x gets one more coordinate sqrt(M*M - |x|*|x|), M being the
largest norm of the tree, so that all lie on a sphere of radius M while their
inner products with a query (whose own extra coordinate is 0) stay the same.
Distances are angles on that sphere.

A node is a point at a level: it covers its points within its radius, its
children (the point itself one level down, and further points) cover theirs
within the next smaller power of ``STEP``, and the centres of siblings are
farther apart than that.  The radius kept is the largest angle that occurs.
With t the angle of query and centre, the inner products of a node's points
lie between |q| M cos(t + radius) and |q| M cos(t - radius).

``Tree.search`` descends best first: nodes whose bounds lie outside the
window, or below what was found, are skipped; leaves are compared by their
exact integer inner products.
"""

from __future__ import annotations

import heapq
import io
from dataclasses import dataclass

import numpy as np

#: Ratio of the covering radii of two levels.
STEP = 1.5
#: Added to every radius, so that rounding never makes a bound too tight.
SLACK = 1e-6


def _unit(points: np.ndarray) -> tuple[np.ndarray, float]:
    """The points on the unit sphere with their extra coordinate, and M."""
    x = points.astype(np.float64)
    squares = np.einsum("ij,ij->i", x, x)
    most = float(np.sqrt(squares.max(initial=0.0)))
    if most == 0:
        return np.column_stack((x, np.ones(len(x)))), 0.0
    x /= most
    rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", x, x)))
    return np.column_stack((x, rest)), most


def _angles(centre: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(others @ centre, -1.0, 1.0))


@dataclass
class Tree:
    #: Distinct (label, vector) pairs: their vectors, labels and smallest ids.
    points: np.ndarray
    labels: np.ndarray
    ids: list[list[int | None]]
    #: Nodes: their point, radius, the slice of their children, and the
    #: smallest and largest label below them.
    point: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low_label: np.ndarray
    high_label: np.ndarray
    most: float

    @classmethod
    def build(cls, points: np.ndarray, labels: np.ndarray, ids: list[list[int | None]]) -> Tree:
        at, most = _unit(points)
        point, radius, first, last, members = [0], [0.0], [0], [0], [np.arange(len(points))]
        low, high = [], []
        angle = [_angles(at[0], at)]
        done = 0
        while done < len(point):
            inside, from_centre = members[done], angle[done]
            members[done] = angle[done] = None
            low.append(labels[inside].min())
            high.append(labels[inside].max())
            reach = float(from_centre.max())
            radius[done] = reach + SLACK if len(inside) > 1 else 0.0
            first[done] = len(point)
            if len(inside) > 1:
                # the next smaller power of STEP, always less than the reach; equal vectors part at once
                small = min(STEP ** (np.ceil(np.log(reach) / np.log(STEP)) - 1), 0.999 * reach) if reach > SLACK else -1.0
                near = from_centre <= small
                near[0] = True  # the centre comes first
                groups = [(point[done], inside[near], from_centre[near])]
                rest = inside[~near]
                while len(rest):
                    from_new = _angles(at[rest[0]], at[rest])
                    near = from_new <= small
                    near[0] = True
                    groups.append((int(rest[0]), rest[near], from_new[near]))
                    rest = rest[~near]
                for centre, group, away in groups:
                    point.append(centre)
                    radius.append(0.0)
                    first.append(0)
                    last.append(0)
                    members.append(group)
                    angle.append(away)
            last[done] = len(point)
            done += 1
        return cls(points, labels, ids, np.array(point), np.array(radius), np.array(first), np.array(last),
                   np.array(low), np.array(high), most)

    def pack(self) -> bytes:
        out = io.BytesIO()
        counts = np.array([len(x) for x in self.ids], dtype=np.int32)
        flat = [i for x in self.ids for i in x]
        small = np.min_scalar_type(int(np.abs(self.points).max(initial=0)))
        signed = {1: np.int16, 2: np.int32}.get(small.itemsize, np.int64)
        np.savez(out, points=self.points.astype(signed), labels=self.labels, counts=counts,
                 ids=np.array([0 if i is None else i for i in flat], dtype=np.int64), known=np.array([i is not None for i in flat], dtype=bool),
                 point=self.point.astype(np.int32), radius=self.radius, first=self.first.astype(np.int32), last=self.last.astype(np.int32),
                 low=self.low_label, high=self.high_label, most=np.array(self.most))
        return out.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> Tree:
        x = np.load(io.BytesIO(blob))
        flat = [i if known else None for i, known in zip(x["ids"].tolist(), x["known"].tolist())]
        ends = np.cumsum(x["counts"]).tolist()
        ids = [flat[a:b] for a, b in zip([0, *ends], ends)]
        return cls(x["points"].astype(np.int64), x["labels"], ids, x["point"], x["radius"], x["first"], x["last"],
                   x["low"], x["high"], float(x["most"]))

    def nodes(self) -> np.ndarray:
        """The vector of every node's point, in the order of the nodes."""
        if not hasattr(self, "_nodes"):
            at = self.points[self.point]
            # whole numbers in doubles are exact while sums stay below 2**53
            self._nodes = at.astype(np.float64)
            self._at_labels = self.labels[self.point]
            self._leaf = self.first == self.last
        return self._nodes

    def query(self, vector: np.ndarray) -> Query:
        return Query(self, vector)


class Query:
    """One query on one tree; inner products of visited nodes are kept, so
    that several windows share them."""

    def __init__(self, tree: Tree, vector: np.ndarray):
        self.tree, self.vector = tree, vector
        self.norm = float(np.sqrt((vector.astype(np.float64) ** 2).sum()))
        self.exact = self.norm * max(tree.most, 1.0) < 2.0 ** 52
        self.floats = vector.astype(np.float64)
        self.met: dict[int, np.ndarray] = {}

    def scores(self, node: int) -> np.ndarray:
        """Inner products of a node's children, whole numbers."""
        found = self.met.get(node)
        if found is None:
            tree, (a, b) = self.tree, (self.tree.first[node], self.tree.last[node])
            if self.exact:
                found = tree.nodes()[a:b] @ self.floats
            else:
                found = tree.points[tree.point[a:b]].astype(object) @ self.vector.astype(object)
            self.met[node] = found
        return found

    def _bounds(self, scores: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.norm * self.tree.most
        if size == 0:
            return np.zeros(len(scores)), np.zeros(len(scores))
        away = np.arccos(np.clip(scores.astype(np.float64) / size, -1.0, 1.0))
        more = size * 1e-12
        return (size * np.cos(np.minimum(np.pi, away + radius)) - more, size * np.cos(np.maximum(0.0, away - radius)) + more)

    def search(self, k: int, label: int, same: bool, low: int | None = None, high: int | None = None) -> list[tuple[int, int | None]]:
        """The first k (inner product, id), highest first, smaller ids first
        (null last), among the points of the same label or of other labels,
        with low <= inner product <= high."""
        tree = self.tree
        tree.nodes()
        floor = -np.inf if low is None else low
        roof = np.inf if high is None else high
        found: list[tuple[int, bool, int, int | None]] = []
        if len(tree.points) == 0:
            return []
        heap = [(-np.inf, 0)]
        if tree.first[0] == tree.last[0]:  # a tree of one point: a leaf, and its own parent
            heap = []
            self._take(found, np.array([self.alone()]), np.array([0]), k, label, same, floor, roof)
        while heap:
            best, node = heapq.heappop(heap)
            if len(found) == k and -best < -found[-1][0]:
                break
            a, b = tree.first[node], tree.last[node]
            scores = self.scores(node)
            leaf = tree._leaf[a:b]
            self._take(found, scores[leaf], np.flatnonzero(leaf) + a, k, label, same, floor, roof)
            inner = np.flatnonzero(~leaf)
            if not len(inner):
                continue
            lower, upper = self._bounds(scores[inner], tree.radius[a:b][inner])
            lo, hi = tree.low_label[a:b][inner], tree.high_label[a:b][inner]
            held = (lo <= label) & (label <= hi) if same else (lo != label) | (hi != label)
            key = np.minimum(upper, roof)
            held &= (upper >= floor) & (lower <= roof)
            if len(found) == k:
                held &= key >= -found[-1][0]
            for i in np.flatnonzero(held).tolist():
                heapq.heappush(heap, (-float(key[i]), int(a + inner[i])))
        return [(-x[0], x[3]) for x in found]

    def alone(self):
        if self.exact:
            return float(self.tree.nodes()[0] @ self.floats)
        return int(self.tree.points[0].astype(object) @ self.vector.astype(object))

    def _take(self, found: list, scores: np.ndarray, at: np.ndarray, k: int, label: int, same: bool, floor, roof) -> None:
        """Put leaves into ``found``, which keeps the first k in order."""
        if not len(at):
            return
        tree = self.tree
        ok = (scores >= floor) & (scores <= roof)
        ok &= (tree._at_labels[at] == label) if same else (tree._at_labels[at] != label)
        if len(found) == k:
            ok &= scores >= -found[-1][0]
        ok = np.flatnonzero(ok.astype(bool))
        if len(ok) > 4 * k:  # all that tie with the k-th stay
            least = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
            ok = ok[(scores[ok] >= least).astype(bool)]
        if not len(ok):
            return
        for i in ok.tolist():
            s = -int(scores[i])
            found += [(s, x is None, 0 if x is None else x, x) for x in tree.ids[tree.point[at[i]]]]
        found.sort(key=lambda x: x[:3])
        del found[k:]
