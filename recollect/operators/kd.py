"""k-d splits of points on the sphere, and a local k-d tree that answers all its queries at once."""

from __future__ import annotations

import numpy as np

EARTH_M = 6_371_008.8


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """(n, 3) unit vectors of degrees."""
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], axis=1)


def chord(metres: float, radius: float = EARTH_M) -> float:
    """The straight line between two points of the unit sphere that are so far apart along it."""
    return 2.0 * np.sin(min(metres / (2.0 * radius), np.pi / 2))


class Splits:
    """Axis-parallel cells from recursive median cuts of a sample; every point of space lies in exactly one.

    least: cuts lie on multiples of it, so no cell is narrower: a box of that size touches at most two cells an axis,
    however dense the points. A crowd within `least` stays in one cell."""

    def __init__(self, sample: np.ndarray, cells: int, least: float = 0.0):
        dim = sample.shape[1]
        axis, cut, left, right, lo, hi = [], [], [], [], [], []
        # (points, cells to make of them, box, node above, whether it is that node's right child)
        todo = [(sample, max(1, cells), np.full(dim, -np.inf), np.full(dim, np.inf), -1, False)]
        root = 0
        while todo:
            pts, n, low, high, above, is_right = todo.pop()
            found = self._cut(pts, least) if n > 1 and len(pts) > 1 else None
            if found is None:
                node = -1 - len(lo)
                lo.append(low)
                hi.append(high)
            else:
                node = len(axis)
                k, at = found
                axis.append(k)
                cut.append(at)
                left.append(0)
                right.append(0)
                below = pts[:, k] < at
                mid_hi, mid_lo = high.copy(), low.copy()
                mid_hi[k] = mid_lo[k] = at
                share = min(n - 1, max(1, round(n * np.count_nonzero(below) / len(pts))))
                todo.append((pts[below], share, low, mid_hi, node, False))
                todo.append((pts[~below], n - share, mid_lo, high, node, True))
            if above < 0:
                root = node
            else:
                (right if is_right else left)[above] = node
        self.root, self.cells = root, len(lo)
        self.axis, self.cut = np.array(axis, np.int64), np.array(cut, float)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.lo_a, self.hi_a = np.array(lo), np.array(hi)

    @staticmethod
    def _cut(pts: np.ndarray, least: float) -> tuple[int, float] | None:
        low, high = pts.min(0), pts.max(0)
        for k in np.argsort(low - high, kind="stable"):
            if high[k] <= low[k]:
                return None
            at = float(np.partition(pts[:, k], len(pts) // 2)[len(pts) // 2])
            if least > 0:
                at = float(np.floor(at / least) * least)
                if at <= low[k]:
                    at += least
            elif at <= low[k]:  # more than half of them lie at the low end
                at = float(pts[pts[:, k] > low[k], k].min())
            if low[k] < at <= high[k]:
                return int(k), at
        return None

    def home(self, pts: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.full(len(pts), self.root, np.int64)
        going = np.flatnonzero(node >= 0)
        while len(going):
            at = node[going]
            below = pts[going, self.axis[at]] < self.cut[at]
            node[going] = np.where(below, self.left[at], self.right[at])
            going = going[node[going] >= 0]
        return -1 - node

    def reached(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that the box lo[row]..hi[row] touches."""
        rows, cells = [], []
        row, node = np.arange(len(lo)), np.full(len(lo), self.root, np.int64)
        while len(row):
            end = node < 0
            rows.append(row[end])
            cells.append(-1 - node[end])
            row, node = row[~end], node[~end]
            axis, cut = self.axis[node], self.cut[node]
            below, above = lo[row, axis] < cut, hi[row, axis] >= cut
            row, node = np.concatenate([row[below], row[above]]), np.concatenate([self.left[node[below]], self.right[node[above]]])
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, int), np.zeros(0, int))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: float, leaf: int = 48, step: int = 1_000_000):
    """Yields (i, j, squared distance) arrays of all a[i], b[j] at most radius apart, by walking two k-d trees together.

    At most about `step` distances are held at once, however many pairs there are."""
    if not len(a) or not len(b):
        return
    ta, tb = _Tree(a, leaf), _Tree(b, leaf)
    r2 = radius * radius * (1 + 1e-12)
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    ready: list[tuple[np.ndarray, np.ndarray]] = []
    while len(x):
        gap = np.maximum(0, np.maximum(ta.lo[x] - tb.hi[y], tb.lo[y] - ta.hi[x]))
        near = np.einsum("ij,ij->i", gap, gap) <= r2
        x, y = x[near], y[near]
        ends = (ta.kid[x] < 0) & (tb.kid[y] < 0)
        ready.append((x[ends], y[ends]))
        x, y = x[~ends], y[~ends]
        # the larger side is opened
        first = (ta.kid[x] >= 0) & ((tb.kid[y] < 0) | (ta.size[x] >= tb.size[y]))
        xa, ya, xb, yb = x[first], y[first], x[~first], y[~first]
        x = np.concatenate([ta.kid[xa], ta.kid[xa] + 1, xb, xb])
        y = np.concatenate([ya, ya, tb.kid[yb], tb.kid[yb] + 1])
    x, y = (np.concatenate(z) for z in zip(*ready))
    todo = ta.size[x] * tb.size[y]
    at = 0
    total = np.cumsum(todo)
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step)))
        i, j = _expand(ta.start[x[at:to]], ta.size[x[at:to]], tb.start[y[at:to]], tb.size[y[at:to]])
        i, j = ta.order[i], tb.order[j]
        d = a[i] - b[j]
        d2 = np.einsum("ij,ij->i", d, d)
        near = d2 <= r2
        yield i[near], j[near], d2[near]
        at = to


def close_totals(a: np.ndarray, b: np.ndarray, weight: np.ndarray, radius: float, leaf: int = 48, step: int = 1_000_000) -> np.ndarray:
    """For each a[i] the total weight of the b[j] at most radius apart, without naming the pairs: two nodes that lie wholly
    within the radius of each other count at once."""
    out = np.zeros(len(a), np.int64)
    if not len(a) or not len(b):
        return out
    ta, tb = _Tree(a, leaf), _Tree(b, leaf)
    run = np.concatenate([[0], np.cumsum(weight[tb.order].astype(np.int64))])
    mass = run[tb.start + tb.size] - run[tb.start]
    whole = np.zeros(len(a) + 1, np.int64)  # differences over ta.order
    r2 = radius * radius * (1 + 1e-12)
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(x):
        gap = np.maximum(0, np.maximum(ta.lo[x] - tb.hi[y], tb.lo[y] - ta.hi[x]))
        far = np.maximum(ta.hi[x] - tb.lo[y], tb.hi[y] - ta.lo[x])
        near = np.einsum("ij,ij->i", gap, gap) <= r2
        full = np.einsum("ij,ij->i", far, far) <= r2
        np.add.at(whole, ta.start[x[full]], mass[y[full]])
        np.subtract.at(whole, ta.start[x[full]] + ta.size[x[full]], mass[y[full]])
        x, y = x[near & ~full], y[near & ~full]
        ends = (ta.kid[x] < 0) & (tb.kid[y] < 0)
        ex, ey = x[ends], y[ends]
        total = np.cumsum(ta.size[ex] * tb.size[ey])
        at = 0
        while at < len(ex):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step)))
            i, j = _expand(ta.start[ex[at:to]], ta.size[ex[at:to]], tb.start[ey[at:to]], tb.size[ey[at:to]])
            i, j = ta.order[i], tb.order[j]
            d = a[i] - b[j]
            hit = np.einsum("ij,ij->i", d, d) <= r2
            np.add.at(out, i[hit], weight[j[hit]])
            at = to
        x, y = x[~ends], y[~ends]
        first = (ta.kid[x] >= 0) & ((tb.kid[y] < 0) | (ta.size[x] >= tb.size[y]))
        xa, ya, xb, yb = x[first], y[first], x[~first], y[~first]
        x = np.concatenate([ta.kid[xa], ta.kid[xa] + 1, xb, xb])
        y = np.concatenate([ya, ya, tb.kid[yb], tb.kid[yb] + 1])
    out[ta.order] += np.cumsum(whole[:-1])
    return out


def _expand(s1: np.ndarray, n1: np.ndarray, s2: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = n1 * n2
    base = np.repeat(np.cumsum(n) - n, n)
    k = np.arange(int(n.sum())) - base
    w = np.repeat(n2, n)
    return np.repeat(s1, n) + k // w, np.repeat(s2, n) + k % w


class _Tree:
    """Median-split tree over pts in arrays: nodes hold order[start:start+size]; kid is the first of two children or -1."""

    def __init__(self, pts: np.ndarray, leaf: int):
        self.order = np.arange(len(pts))
        start, size, kid = [0], [len(pts)], [-1]
        lo, hi = [pts.min(0)], [pts.max(0)]
        at = 0
        while at < len(start):
            s, n = start[at], size[at]
            if n > leaf:
                ids = self.order[s : s + n]
                axis = int((hi[at] - lo[at]).argmax())
                if hi[at][axis] > lo[at][axis]:
                    half = n // 2
                    ids = ids[np.argpartition(pts[ids, axis], half)]
                    self.order[s : s + n] = ids
                    kid[at] = len(start)
                    for s2, part in ((s, ids[:half]), (s + half, ids[half:])):
                        start.append(s2)
                        size.append(len(part))
                        kid.append(-1)
                        lo.append(pts[part].min(0))
                        hi.append(pts[part].max(0))
            at += 1
        self.start, self.size, self.kid = np.array(start), np.array(size), np.array(kid)
        self.lo, self.hi = np.array(lo), np.array(hi)
