"""One regression tree at a time over quantised features, in numpy.

The trees are those of Spark's own learner with a variance impurity, bit for bit where all
rows come in one block: sums run in the order of the rows, a split is the first of the best
by feature and cut, and a cut lies half way between two values that occur in the rows.
Nothing here holds more than the rows it is given, their histograms and the trees.

For more rows than one block there is ``Bundles``: features that together have few values
share one code, and of two children only the smaller is counted. The sums are the same, but
not the order in which they run, so equal splits may fall to another feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

#: Values that the features of a bundle may have together; rows that are counted at a time.
CODES, AT_ONCE = 2048, 1 << 14
#: Statistics of a bin: weight, weighted sum, weighted sum of squares, rows.
STATS = 4
_EPSILON = np.finfo(float).eps
_MOST = np.finfo(float).max


def strict_exp(x: np.ndarray) -> np.ndarray:
    """e**x to the last bit as the JVM's ``StrictMath.exp`` (fdlibm), and so SQL's ``exp``, has it."""
    high = (np.ascontiguousarray(x, dtype=float).view(np.int64) >> 32) & 0x7FFFFFFF
    small = high <= 0x3FD62E42
    with np.errstate(all="ignore"):
        k = np.where(high < 0x3FF0A2B2, np.sign(x), np.trunc(1.44269504088896338700e00 * x + np.copysign(0.5, x)))
        k = np.where(small, 0.0, np.clip(np.nan_to_num(k), -2000, 2000))
        hi, lo = x - k * 6.93147180369123816490e-01, k * 1.90821492927058770002e-10
        r = np.where(small, x, hi - lo)
        t = r * r
        c = 4.13813679705723846039e-08
        for p in (-1.65339022054652515390e-06, 6.61375632143793436117e-05, -2.77777777770155933842e-03, 1.66666666666666019037e-01):
            c = p + t * c
        c = r - t * c
        near = 1.0 - ((r * c) / (c - 2.0) - r)
        far = 1.0 - ((lo - (r * c) / (2.0 - c)) - hi)
        out = np.where(high < 0x3E300000, 1.0 + x, np.where(small, near, np.ldexp(far, k.astype(np.int64))))
    out = np.where(x > 7.09782712893383973096e02, np.inf, np.where(x < -7.45133219101941108420e02, 0.0, out))
    return np.where(np.isnan(x), x, out)


def gradient(label: np.ndarray, margin: np.ndarray, first: bool) -> np.ndarray:
    """What the next tree is fitted to: the labels as -1 and 1, then the gradient of the log loss."""
    out = 2 * label - 1
    for start in range(0, 0 if first else len(out), AT_ONCE):  # a few rows at a time: there are many steps
        part = slice(start, start + AT_ONCE)
        sign = out[part]
        out[part] = (4 * sign) / (1 + strict_exp((2 * sign) * margin[part]))
    return out


def area(label: np.ndarray, score: np.ndarray) -> float | None:
    """ROC-AUC, ties counting half; None with one class only. Labels other than 0 and 1 don't count."""
    total, pairs, _ = ranked(*counted(label, score))
    return float(pairs / (float(total[0]) * total[1])) if total.all() else None


def counted(label: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, positives, negatives) by distinct score, from the highest down."""
    known = (label == 0) | (label == 1)
    value, at = np.unique(score[known], return_inverse=True)
    n = np.bincount(at, minlength=len(value))
    positive = np.bincount(at, label[known], minlength=len(value)).astype(np.int64)
    return value[::-1], positive[::-1], (n - positive)[::-1]


def ranked(score: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Positives and negatives in all, the pairs they rank rightly, and up to 64 scores that part
    them evenly, from counts by score in any order; a score may come more than once."""
    value, at = np.unique(score, return_inverse=True)
    tp = np.bincount(at, positive, minlength=len(value))[::-1]
    fp = np.bincount(at, negative, minlength=len(value))[::-1]
    pairs = float((fp * (tp.cumsum() - tp + tp / 2)).sum())
    steps = np.searchsorted((tp + fp).cumsum(), np.linspace(0, (tp + fp).sum(), 66)[1:-1])
    marks = np.unique(value[::-1][np.minimum(steps, len(value) - 1)]) if len(value) else value
    return np.array([tp.sum(), fp.sum()], np.int64), pairs, marks


def histograms(x: np.ndarray, weight: np.ndarray, left: np.ndarray, at: np.ndarray, nodes: Sequence[int], bins: int) -> np.ndarray:
    """(nodes, STATS, features, bins) of the rows that are at ``nodes``; ``x`` is features x rows."""
    slots = np.full(max(int(at.max(initial=0)), *nodes) + 1, -1, np.intp)
    slots[list(nodes)] = np.arange(len(nodes))
    slot = slots[at]
    rows = np.flatnonzero(slot >= 0)
    if len(rows) == len(slot):
        rows = slice(None)
    base, w, y = slot[rows] * bins, weight[rows], left[rows]
    wy = w * y
    wyy = wy * y
    out = np.empty((STATS, len(x), len(nodes) * bins))
    for f, column in enumerate(x):
        key = base + column[rows]
        for stat, of in enumerate((w, wy, wyy, None)):
            out[stat, f] = np.bincount(key, of, minlength=len(nodes) * bins)
    return np.ascontiguousarray(out.reshape(STATS, len(x), len(nodes), bins).transpose(2, 0, 1, 3))


def _impurity(stats: np.ndarray) -> np.ndarray:
    """Variance; ``stats`` has the STATS first."""
    n = np.where(stats[0] == 0, 1.0, stats[0])
    return np.where(stats[0] == 0, 0.0, (stats[2] - (stats[1] * stats[1]) / n) / n)


@dataclass
class Split:
    """The best split of a node, if any is valid; ``own`` are the node's statistics, ``cut`` the
    last bin to the left, ``lefts`` the categories to the left, ``present`` which bins of which
    feature have rows (of the root)."""

    gain: float
    own: np.ndarray
    feature: int = -1
    cut: int = 0
    lefts: np.ndarray | None = None
    left: np.ndarray | None = None
    right: np.ndarray | None = None
    present: np.ndarray | None = None


def best_split(hist: np.ndarray, own: np.ndarray | None, categories: Mapping[int, int], min_rows: int) -> Split:
    """The first of the best splits of a node from its histogram (STATS, features, bins). ``own``
    are its statistics as its parent's split left them, None for the root."""
    present = hist[3] > 0 if own is None else None
    if present is not None and not present.any():
        raise ValueError("a series has no row to learn from")
    ranks = {}
    if categories:
        hist = hist.copy()
    for f in categories:
        n = hist[0, f]
        centre = np.where(n != 0, hist[1, f] / np.where(n != 0, n, 1.0), _MOST)
        ranks[f] = np.argsort(centre, kind="stable")
        hist[:, f] = hist[:, f, ranks[f]]
    upto = hist.cumsum(axis=2)
    left = upto[:, :, :-1]
    right = upto[:, :, -1:] - left
    if own is None:
        f = next((f for f, bins in enumerate(present) if f in categories or bins.sum() > 1), None)
        if f is None:
            own = upto[:, 0, -1].copy()
        else:
            at = 0 if f in categories else int(np.argmax(present[f]))
            own = left[:, f, at] + right[:, f, at]
    whole = left[0] + right[0]
    whole = np.where(whole == 0, 1.0, whole)
    gain = _impurity(own) - left[0] / whole * _impurity(left) - right[0] / whole * _impurity(right)
    gain[(left[3] < min_rows) | (right[3] < min_rows) | ~(gain >= 0)] = -_MOST
    f, at = divmod(int(np.argmax(gain)), gain.shape[1]) if gain.size else (0, 0)
    best = float(gain[f, at]) if gain.size else -_MOST
    if best <= 0:
        return Split(best, own, present=present)
    lefts = ranks[f][: at + 1] if f in ranks else None
    return Split(best, own, f, at, lefts, left[:, f, at].copy(), right[:, f, at].copy(), present)


@dataclass
class Tree:
    """A tree while it grows, by level. ``feature`` is -1 at a leaf; the right child follows the
    left one; ``rights`` tells of every bin whether it goes right. Once no node is open, the
    lists are arrays."""

    depth: int
    bins: int
    feature: list[int] = field(default_factory=lambda: [-1])
    child: list[int] = field(default_factory=lambda: [-1])
    rights: list[np.ndarray | None] = field(default_factory=lambda: [None])
    value: list[float] = field(default_factory=lambda: [0.0])
    open: dict[int, np.ndarray | None] = field(default_factory=lambda: {0: None})
    level: int = 0
    present: np.ndarray | None = None

    def take(self, found: Mapping[int, Split]) -> None:
        """Splits the open nodes as found, and opens their children."""
        self.level += 1
        after: dict[int, np.ndarray | None] = {}
        for node, split in found.items():
            if split.present is not None:
                self.present = split.present
                self.value[node] = _mean(split.own)
            if split.gain <= 0:
                continue
            self.feature[node], self.child[node] = split.feature, len(self.feature)
            self.rights[node] = self.goes(split)
            for own in (split.left, split.right):
                if self.level < self.depth and not abs(_impurity(own)) < _EPSILON:
                    after[len(self.feature)] = own
                self.feature.append(-1)
                self.child.append(-1)
                self.rights.append(None)
                self.value.append(_mean(own))
        self.open = after
        if not after:
            none = np.zeros(self.bins, bool)
            self.rights = np.array([none if x is None else x for x in self.rights])
            self.feature, self.child, self.value, self.present = np.array(self.feature), np.array(self.child), np.array(self.value), None

    def goes(self, split: Split) -> np.ndarray:
        """Of every bin, whether it goes right."""
        if split.lefts is not None:
            return ~np.isin(np.arange(self.bins), split.lefts)
        here = np.flatnonzero(self.present[split.feature])
        following = here[np.searchsorted(here, split.cut, side="right")]
        return np.arange(self.bins) > (split.cut + following) / 2

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node at which every row ends."""
        at = np.zeros(x.shape[1], np.intp)
        parts = [(0, np.arange(x.shape[1]))]
        while parts:
            node, rows = parts.pop()
            if self.feature[node] < 0:
                at[rows] = node
                continue
            goes = self.rights[node][x[self.feature[node]][rows]]
            parts.append((self.child[node], rows[~goes]))
            parts.append((self.child[node] + 1, rows[goes]))
        return at

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaves(x)]


def _mean(stats: np.ndarray) -> float:
    return float(stats[1] / stats[0]) if stats[0] != 0 else 0.0


def added(margin: np.ndarray, trees: Sequence[Tree], x: np.ndarray, rate: float, before: int = 0) -> np.ndarray:
    """The margins with ``trees`` added, the first of all at its full value; ``before`` are
    the trees that the margins hold already."""
    for i, tree in enumerate(trees, before):
        margin = margin + (1.0 if i == 0 else rate) * tree.values(x)
    return margin


def fitted(x: np.ndarray, weight: np.ndarray, left: np.ndarray, depth: int, bins: int, categories: Mapping[int, int], min_rows: int) -> Tree:
    """A whole tree from one block of rows."""
    tree = Tree(depth, bins)
    while tree.open:
        nodes = list(tree.open)
        hist = histograms(x, weight, left, tree.leaves(x), nodes, bins)
        tree.take({n: best_split(h, tree.open[n], categories, min_rows) for n, h in zip(nodes, hist)})
    return tree


class Bundles:
    """Features that share codes. ``take`` gives the columns one by one, which are not kept."""

    def __init__(self, take: Callable[[int], np.ndarray], features: int, bins: int):
        self.features, self.bins = features, bins
        self.codes: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []  # by bundle: the bin of each feature by code, from ``firsts`` on
        self.firsts: list[int] = []
        for f in range(features):
            column = take(f)
            if self.codes:
                last = self.bits[-1]
                both = self.codes[-1].astype(np.uint32) * bins + column
                seen = np.flatnonzero(np.bincount(both, minlength=last.shape[1] * bins))
                if len(seen) <= CODES:
                    code = np.zeros(last.shape[1] * bins, np.uint16)
                    code[seen] = np.arange(len(seen))
                    self.codes[-1] = code[both]
                    self.bits[-1] = np.vstack([last[:, seen // bins], seen % bins])
                    continue
            self.codes.append(column.astype(np.uint16))
            self.bits.append(np.arange(bins)[None])
            self.firsts.append(f)

    def goes(self, feature: int, rights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which rows go right."""
        b = int(np.searchsorted(self.firsts, feature, side="right")) - 1
        return rights[self.bits[b][feature - self.firsts[b]]][self.codes[b][rows]]

    def histogram(self, rows: np.ndarray, weights: Weights, wy: np.ndarray) -> np.ndarray:
        """(STATS, features, bins) of the rows; the sums of squares, which no comparison of
        splits needs, are left at 0."""
        cells = [np.zeros((len(weights.columns) + 1, bits.shape[1])) for bits in self.bits]
        for start in range(0, len(rows), AT_ONCE):
            part = rows[start : start + AT_ONCE]
            of = [w if w is None else w[part] for w in weights.columns] + [wy[part]]
            for code, cell in zip(self.codes, cells):
                key = code[part].astype(np.intp)
                for stat, values in zip(cell, of):
                    stat += np.bincount(key, values, minlength=len(stat))
        out = np.zeros((STATS, self.features, self.bins))
        for first, bits, cell in zip(self.firsts, self.bits, cells):
            for f, bit in enumerate(bits, first):
                own = np.array([np.bincount(bit, stat, minlength=self.bins) for stat in cell])
                out[0, f], out[3, f] = weights.unpacked(own[:-1])
                out[1, f] = own[-1]
        return out

    def ends(self, tree: Tree, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves of a tree and their rows."""
        parts = [(0, rows)]
        while parts:
            node, rows = parts.pop()
            if tree.feature[node] < 0:
                yield node, rows
                continue
            goes = self.goes(tree.feature[node], tree.rights[node], rows)
            parts.append((tree.child[node], rows[~goes]))
            parts.append((tree.child[node] + 1, rows[goes]))

    def fitted(
        self, rows: np.ndarray, weights: Weights, left: np.ndarray, depth: int, categories: Mapping[int, int], min_rows: int
    ) -> tuple[Tree, list[tuple[int, np.ndarray]]]:
        """A tree from ``rows``, and its leaves with their rows. ``left`` is by row of the whole table."""
        tree, wy = Tree(depth, self.bins), weights.whole * left
        at, hists = {0: rows}, {0: self.histogram(rows, weights, wy)}
        while tree.open:
            found = {n: best_split(hists[n], own if own is None else own * (1, 1, 0, 1), categories, min_rows) for n, own in tree.open.items()}
            parts = {}
            for node, split in found.items():
                if split.present is not None:
                    tree.present = split.present
                here = at[node]
                if split.gain > 0:
                    goes = self.goes(split.feature, tree.goes(split), here)
                    parts[node] = here[~goes], here[goes]
                    for own, part in zip((split.left, split.right), parts[node]):
                        own[2] = wy[part] @ left[part]
            tree.take(found)
            for node, (lefts, rights) in parts.items():
                first, whole = int(tree.child[node]), hists.pop(node)
                at[first], at[first + 1] = lefts, rights
                del at[node]
                if first in tree.open or first + 1 in tree.open:
                    small = first if len(lefts) <= len(rights) else first + 1
                    hists[small] = self.histogram(at[small], weights, wy)
                    rest = whole - hists[small]
                    hists[2 * first + 1 - small] = np.where(rest[3] > 0, rest, 0.0)
        return tree, list(at.items())


class Weights:
    """Weights in as few columns to add up as they need: two different ones ride along with
    the number of rows in one column of whole numbers."""

    _SHIFT = float(1 << 26)

    def __init__(self, whole: np.ndarray):
        self.whole = whole
        self.kinds = np.unique(whole)
        self.two = len(self.kinds) <= 2 and len(whole) < self._SHIFT
        self.columns = [1.0 + self._SHIFT * (whole == self.kinds[-1])] if self.two else [None, whole]

    def unpacked(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and rows from the sums of ``columns``."""
        if not self.two:
            return sums[1], sums[0]
        last = np.floor(sums[0] / self._SHIFT)
        rows = sums[0] - last * self._SHIFT
        return (rows - last) * self.kinds[0] + last * self.kinds[-1], rows
