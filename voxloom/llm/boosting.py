"""Gradient boosted trees on counted rows of small integer features.

The rows are the distinct combinations of binned features with the number of
positives and negatives that Spark counted for each, so fitting takes the same
time whatever the size of the corpus. Fitted trees become one SQL expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Inner node: feature >= cut goes right. Leaf: feature is None."""

    value: float = 0.0
    feature: str | None = None
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def sql(self, prefix: str) -> str:
        if self.feature is None:
            return f"{self.value!r}D"
        return f"CASE WHEN {prefix}{self.feature} >= {self.cut} THEN {self.right.sql(prefix)} ELSE {self.left.sql(prefix)} END"

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        if self.feature is None:
            return np.full(len(next(iter(x.values()))), self.value)
        return np.where(x[self.feature] >= self.cut, self.right.predict(x), self.left.predict(x))


@dataclass
class Boosted:
    base: float
    trees: list[Tree] = field(default_factory=list)
    threshold: float = 1.0
    #: Of parts of the rows, where they were calibrated apart.
    thresholds: dict[int, float] = field(default_factory=dict)

    def sql(self, prefix: str = "") -> str:
        """The probability as SQL over columns prefix + feature."""
        total = " + ".join([f"{self.base!r}D", *(t.sql(prefix) for t in self.trees)])
        return f"1D / (1D + exp(-({total})))"

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum(t.predict(x) for t in self.trees))))


def fit(x: dict[str, np.ndarray], positive: np.ndarray, negative: np.ndarray, *, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 5.0, precision: float = 0.995) -> Boosted:
    """Logistic boosting by Newton steps; the threshold is the least with that precision over all counted rows.

    x: columns of small integers. Without both kinds of rows nothing is selected.
    """
    p, n = positive.astype(float), negative.astype(float)
    if not len(p) or not p.sum() or not n.sum():
        return Boosted(-30.0)
    model = Boosted(math.log(p.sum() / n.sum()))
    margin = np.full(len(p), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        tree = _grow(x, p * (1 - q) - n * q, (p + n) * q * (1 - q), np.ones(len(p), bool), depth, rate, ridge)
        model.trees.append(tree)
        margin = margin + tree.predict(x)
    model.threshold = calibrated(model, x, p, n, precision=precision)
    return model


def calibrated(model: Boosted, x: dict[str, np.ndarray], positive: np.ndarray, negative: np.ndarray, *, precision: float, spare: float = 0.0) -> float:
    """The least threshold with that precision over the counted rows, ``spare`` more negatives supposed; above all scores if there is none, or nothing is counted."""
    if not len(positive) or not model.trees:
        return 1.0
    score = model.predict(x)
    order = np.argsort(-score, kind="stable")
    upto = np.cumsum(positive[order]) / np.maximum(np.cumsum(positive[order] + negative[order]) + spare, 1e-9)
    # Equal scores stand or fall together.
    last = np.append(score[order][1:] != score[order][:-1], True)
    good = np.flatnonzero(last & (upto >= precision))
    return float(score[order][good[-1]]) - 1e-9 if len(good) else 1.0


def _grow(x: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, here: np.ndarray, depth: int, rate: float, ridge: float) -> Tree:
    def gain(a: float, b: float) -> float:
        return a * a / (b + ridge)

    total_g, total_h = g[here].sum(), h[here].sum()
    best: tuple[float, str | None, int] = (1e-3, None, 0)
    if depth:
        for name, column in x.items():
            values = column[here]
            # Cuts lie in the middle between neighbouring values, for values that fitting has not seen.
            known = np.unique(values)
            for cut in (known[:-1] + known[1:] + 1) // 2:
                right = values >= cut
                rg, rh = g[here][right].sum(), h[here][right].sum()
                won = gain(rg, rh) + gain(total_g - rg, total_h - rh) - gain(total_g, total_h)
                if won > best[0]:
                    best = (won, name, int(cut))
    if best[1] is None:
        return Tree(float(rate * total_g / (total_h + ridge)))
    side = x[best[1]] >= best[2]
    return Tree(0.0, best[1], best[2], _grow(x, g, h, here & ~side, depth - 1, rate, ridge), _grow(x, g, h, here & side, depth - 1, rate, ridge))
