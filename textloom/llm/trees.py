"""CART decision trees and random forests over small tables of numbers, on the driver, and their Spark expressions."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def grow_tree(rows: list[tuple[float, ...]], y: list[int], depth: int = 6, least: int = 2, some: int | None = None, rng: random.Random | None = None, soft: bool = False) -> dict | float:
    """By Gini impurity: {feature, at, low, high}, or a leaf's label (soft: share of ones). Ties go to the earlier feature.

    some: how many features, drawn by rng, each split looks at.
    """
    ones = sum(y)
    leaf = ones / len(y) if soft else int(2 * ones >= len(y))
    if not depth or ones in (0, len(y)) or len(y) < 2 * least:
        return leaf
    gini = lambda n, k: 2 * k * (n - k) / n if n else 0.0
    best = (gini(len(y), ones) - 1e-9, None, None)
    fs = range(len(rows[0])) if some is None else sorted(rng.sample(range(len(rows[0])), some))
    for f in fs:
        order = sorted(zip((float(r[f]) for r in rows), y, strict=True))
        k = 0
        for i in range(1, len(order)):
            k += order[i - 1][1]
            if order[i][0] > order[i - 1][0] and least <= i <= len(order) - least:
                cost = gini(i, k) + gini(len(y) - i, ones - k)
                if cost < best[0]:
                    best = (cost, f, (order[i][0] + order[i - 1][0]) / 2)
    if best[1] is None:
        return leaf
    sides = [[i for i, r in enumerate(rows) if (r[best[1]] >= best[2]) == side] for side in (False, True)]
    low, high = (grow_tree([rows[i] for i in at], [y[i] for i in at], depth - 1, least, some, rng, soft) for at in sides)
    return {"feature": best[1], "at": best[2], "low": low, "high": high}


def grow_forest(rows: list[tuple[float, ...]], y: list[int], trees: int = 15, depth: int = 6, seed: int = 1) -> list:
    """Trees on bootstrap samples, each split over a square root of the features. Deterministic in seed."""
    rng = random.Random(seed)
    some = max(1, round(len(rows[0]) ** 0.5))
    out = []
    for _ in range(trees):
        at = [rng.randrange(len(rows)) for _ in rows]
        out.append(grow_tree([rows[i] for i in at], [y[i] for i in at], depth, 2, some, rng, True))
    return out


def tree_value(tree: dict | float, row: tuple[float, ...]) -> float:
    while isinstance(tree, dict):
        tree = tree["high"] if row[tree["feature"]] >= tree["at"] else tree["low"]
    return tree


def tree_column(tree: dict | float, feature: Callable[[int], Column]) -> Column:
    """The tree as nested conditions over feature(i)."""
    if not isinstance(tree, dict):
        return F.lit(float(tree))
    return F.when(feature(tree["feature"]) >= F.lit(float(tree["at"])), tree_column(tree["high"], feature)).otherwise(tree_column(tree["low"], feature))


def forest_column(forest: list, feature: Callable[[int], Column]) -> Column:
    """The mean of the trees."""
    total = F.lit(0.0)
    for tree in forest:
        total = total + tree_column(tree, feature)
    return total / F.lit(float(len(forest)))
