"""Gradient-boosted depth-two trees over small integer features, scored as a SQL expression.

Spark counts how often each feature vector occurs with each label; the table of distinct vectors has
a size that the feature ranges bound, so boosting runs on it with exact weights of all rows.
"""

from __future__ import annotations

import math


def _halves(rows: list, feature: int, cut: int) -> tuple[list, list]:
    low, high = [], []
    for r in rows:
        (low if r[0][feature] <= cut else high).append(r)
    return low, high


def _gain(rows: list) -> float:
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    return g * g / (h + 1.0)


def _best(rows: list, ranges: list[int]) -> tuple[float, int, int] | None:
    found, whole = None, _gain(rows)
    for f, top in enumerate(ranges):
        for cut in range(top):
            low, high = _halves(rows, f, cut)
            if low and high:
                gain = _gain(low) + _gain(high) - whole
                if gain > 1e-9 and (found is None or gain > found[0]):
                    found = (gain, f, cut)
    return found


def fit(table: list[tuple[tuple[int, ...], float, float]], ranges: list[int], rounds: int = 20, rate: float = 0.4) -> list:
    """Trees [(path, value), ...] from rows (features, weight of label 1, weight of label 0).

    ``ranges`` has each feature's largest value; a path is a list of (feature, cut, at most).
    """
    scores, trees = [0.0] * len(table), []
    for _ in range(rounds):
        rows = []
        for (x, one, zero), s in zip(table, scores):
            p = 1 / (1 + math.exp(-s))
            rows.append((x, one - (one + zero) * p, (one + zero) * p * (1 - p)))
        split = _best(rows, ranges)
        if split is None:
            break
        leaves = []
        for part, most in zip(_halves(rows, split[1], split[2]), (True, False)):
            deeper = _best(part, ranges)
            pieces = [(part, [])] if deeper is None else [(p, [(deeper[1], deeper[2], m)]) for p, m in zip(_halves(part, deeper[1], deeper[2]), (True, False))]
            for rest, path in pieces:
                g, h = sum(r[1] for r in rest), sum(r[2] for r in rest)
                leaves.append(([(split[1], split[2], most), *path], rate * max(-4.0, min(4.0, g / (h + 1.0)))))
        trees.append(leaves)
        scores = [s + tree_value(leaves, x) for (x, _, _), s in zip(table, scores)]
    return trees


def tree_value(leaves: list, x: tuple[int, ...]) -> float:
    return next(v for path, v in leaves if all((x[f] <= cut) == most for f, cut, most in path))


def margin(trees: list, x: tuple[int, ...]) -> float:
    return sum(tree_value(t, x) for t in trees)


def as_sql(trees: list, names: list[str]) -> str:
    """The margin as SQL over columns or fields ``names``."""
    cases = []
    for leaves in trees:
        whens = [f"WHEN {' AND '.join(f'{names[f]} {"<=" if most else ">"} {cut}' for f, cut, most in path)} THEN {v!r}D" for path, v in leaves]
        cases.append(f"(CASE {' '.join(whens)} END)")
    return " + ".join(cases) or "0D"


def threshold(trees: list, table: list, precision: float) -> float:
    """The least margin at and above which ``precision`` of the weight has label 1; infinite if there is none."""
    groups: dict[float, list[float]] = {}
    for x, one, zero in table:
        g = groups.setdefault(margin(trees, x), [0.0, 0.0])
        g[0] += one
        g[1] += zero
    one = zero = 0.0
    best = math.inf
    for m in sorted(groups, reverse=True):
        one, zero = one + groups[m][0], zero + groups[m][1]
        if one and one >= precision * (one + zero):
            best = max(m, 0.0)  # and rather likely than not
    return best
