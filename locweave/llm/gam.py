"""A generalised additive model with pairwise terms, kept as lookup tables over feature bins.

Boosting goes round the features in turn; each step fits a shallow tree of one feature (or of a pair)
to the gradient and adds a small part of it to that feature's table. What is left after training is
one table a feature and one a pair, so that a score is a sum of looked-up numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Gam:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, features: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        bins = self.bins(features)
        total = np.full(len(bins), self.base)
        for k, table in enumerate(self.tables):
            total += table[bins[:, k]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[:, a], bins[:, b]]
        return 1 / (1 + np.exp(-total))


def _gain(grad: np.ndarray, hess: np.ndarray, smooth: float) -> np.ndarray:
    return grad * grad / (hess + smooth)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """The step of a tree with so many leaves over the bins of one feature, grown best split first."""
    cuts, n = [0, len(grad)], len(grad)
    cg, ch = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    while len(cuts) <= leaves:
        best = (1e-9, -1)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            at = np.arange(lo + 1, hi)
            if len(at):
                g = _gain(cg[at] - cg[lo], ch[at] - ch[lo], smooth) + _gain(cg[hi] - cg[at], ch[hi] - ch[at], smooth) - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo], smooth)
                best = max(best, (float(g.max()), int(at[g.argmax()])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(n)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        step[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + smooth)
    return step


def _pair_tree(grad: np.ndarray, hess: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """The best step with four leaves on a grid: a cut of the first feature, and one of the second on either side."""
    best, out = 0.0, np.zeros_like(grad)
    rows_g, rows_h = np.cumsum(grad, axis=0), np.cumsum(hess, axis=0)
    for r in range(len(grad) - 1):
        gain, parts = 0.0, []
        for g, h in ((rows_g[r], rows_h[r]), (rows_g[-1] - rows_g[r], rows_h[-1] - rows_h[r])):
            cg, ch = np.cumsum(g), np.cumsum(h)
            split = _gain(cg[:-1], ch[:-1], smooth) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1], smooth)
            c = int(split.argmax())
            gain += float(split[c])
            parts.append((c + 1, cg[c] / (ch[c] + smooth), (cg[-1] - cg[c]) / (ch[-1] - ch[c] + smooth)))
        if gain > best:
            best, out = gain, np.empty_like(grad)
            for side, (c, left, right) in zip((slice(0, r + 1), slice(r + 1, None)), parts, strict=True):
                out[side, :c], out[side, c:] = left, right
    return best, out


#: Rows from which on a fifth is set aside to find how many rounds generalise.
LEAST_TO_SPLIT = 200


class _Boosting:
    """A model in the making: the rows' bins and their scores so far."""

    def __init__(self, features: np.ndarray, y: np.ndarray, edges: list[np.ndarray], rate: float, leaves: int, smooth: float):
        prior = (y.sum() + 1) / (len(y) + 2)
        self.model = Gam(edges, float(np.log(prior / (1 - prior))), [np.zeros(len(e) + 1) for e in edges])
        self.y, self.at, self.total = y, self.model.bins(features), np.full(len(y), self.model.base)
        self.rate, self.leaves, self.smooth = rate, leaves, smooth

    def _sums(self, flat: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-self.total))
        return np.bincount(flat, self.y - p, size), np.bincount(flat, p * (1 - p), size)

    def round(self) -> None:
        """A step of each feature in turn."""
        for k, table in enumerate(self.model.tables):
            step = self.rate * _tree(*self._sums(self.at[:, k], len(table)), self.leaves, self.smooth)
            table += step
            self.total += step[self.at[:, k]]

    def _grid(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(self.model.tables[a]), len(self.model.tables[b])
        return tuple(x.reshape(shape) for x in self._sums(self.at[:, a] * shape[1] + self.at[:, b], shape[0] * shape[1]))

    def take_pairs(self, most: int) -> None:
        """The pairs of features whose first step would gain most."""
        wide = [k for k, table in enumerate(self.model.tables) if len(table) > 1]
        ranked = sorted(((_pair_tree(*self._grid(a, b), self.smooth)[0], a, b) for i, a in enumerate(wide) for b in wide[i + 1 :]), reverse=True)
        self.model.pairs = [(a, b) for _, a, b in ranked[:most]]
        self.model.pair_tables = [np.zeros((len(self.model.tables[a]), len(self.model.tables[b]))) for a, b in self.model.pairs]

    def pair_round(self) -> None:
        """A step of each pair in turn."""
        for (a, b), table in zip(self.model.pairs, self.model.pair_tables, strict=True):
            step = self.rate * _pair_tree(*self._grid(a, b), self.smooth)[1]
            table += step
            self.total += step[self.at[:, a], self.at[:, b]]


def _loss(model: Gam, features: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(model.score(features), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _best(step, loss, most: int, start: int = 0) -> int:
    """After how many steps, start at least, the loss is least; it stops when there was no gain for a fifth of the most."""
    best, at = loss() if not start else np.inf, start
    for k in range(1, most + 1):
        step()
        if k >= start and (now := loss()) < best - 1e-6:
            best, at = now, k
        if k - at > max(5, most // 5):
            break
    return at


def fit(
    features: np.ndarray, labels: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, leaves: int = 4, smooth: float = 4.0
) -> Gam:
    """Learn a model; with no rows, or one label only, a constant with a weak prior of one row each.

    rounds and pair_rounds are the most: where rows are many enough, a fifth of them tells how many of
    these lower the loss on rows not learned from, and all rows are then fitted so far.
    """
    n, width = features.shape
    y = labels.astype(float)
    edges = [np.unique(np.quantile(features[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for k in range(width)]
    whole = _Boosting(features, y, edges, rate, leaves, smooth)
    if n == 0 or y.min() == y.max():
        return whole.model
    aside = np.arange(n) % 5 == 4
    if n >= LEAST_TO_SPLIT and y[~aside].min() < y[~aside].max():
        part = lambda: _Boosting(features[~aside], y[~aside], edges, rate, leaves, smooth)
        trial = part()
        rounds = _best(trial.round, lambda: _loss(trial.model, features[aside], y[aside]), rounds, 5)
        again = part()
        for _ in range(rounds):
            again.round()
        again.take_pairs(pairs)
        pair_rounds = _best(again.pair_round, lambda: _loss(again.model, features[aside], y[aside]), pair_rounds)
    for _ in range(rounds):
        whole.round()
    whole.take_pairs(pairs if pair_rounds else 0)
    for _ in range(pair_rounds):
        whole.pair_round()
    return whole.model
