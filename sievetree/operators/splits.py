"""Further ways to split rows, columns and queries. All search on a bounded sample in numpy; what they find (centres, cuts, groups) is then applied to all rows by plans.tree and dependence.centre_split."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

from . import dependence as dep

#: The radius and the least neighbours of density clusters, the share trimmed at both ends in the stability test.
RADIUS, NEIGHBOURS, TRIM = 2.0, 10, 0.1


def _standard(x: np.ndarray) -> np.ndarray:
    x = dep.impute(x)
    return (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)


def means(rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    full = dep.impute(rows)
    return np.array([full[label == k].mean(0) for k in np.unique(label[label >= 0])]).reshape(-1, rows.shape[1])


def gaussian_labels(rows: np.ndarray, parts: int = 2, rounds: int = 50) -> np.ndarray:
    """Hard labels of a mixture of Gaussians with independent columns, started from two-means."""
    x = _standard(rows)
    share = np.eye(parts)[dep.nearest(x, dep.two_means(x, parts))]
    for _ in range(rounds):
        n = share.sum(0) + 1e-9
        mean = share.T @ x / n[:, None]
        var = np.maximum(share.T @ (x * x) / n[:, None] - mean**2, 1e-3)
        log = np.log(n / n.sum()) - 0.5 * (((x[:, None] - mean) ** 2 / var) + np.log(var)).sum(2)
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - share).max() < 1e-4:
            break
        share = new
    return share.argmax(1)


def density_labels(rows: np.ndarray, radius: float = RADIUS, least: int = NEIGHBOURS, most: int = 3000) -> np.ndarray:
    """Density clusters of at most `most` rows, evenly taken; the other rows and those in no cluster get the nearest cluster's label."""
    x = dep.impute(rows)
    at = np.unique(np.linspace(0, len(x) - 1, min(len(x), most)).astype(int))
    some = x[at]
    square = (some**2).sum(1)
    near = square[:, None] + square - 2 * some @ some.T <= radius * radius + 1e-9
    core = near.sum(1) >= least
    label = np.full(len(some), -1)
    found = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        front = np.zeros(len(some), bool)
        front[i] = True
        while front.any():
            label[front] = found
            front = near[front & core].any(0) & (label < 0)
        found += 1
    if found == 0:
        return np.zeros(len(x), int)
    return dep.nearest(x, means(some, label))


def embedded_labels(rows: np.ndarray, parts: int = 2, most: int = 400, rounds: int = 250, perplexity: float = 30.0) -> np.ndarray:
    """Two-means in a three-dimensional stochastic neighbour embedding of at most `most` rows, evenly taken; other rows get the nearest label."""
    x = _standard(rows)
    at = np.unique(np.linspace(0, len(x) - 1, min(len(x), most)).astype(int))
    some = x[at]
    n = len(some)
    if n <= parts:
        return dep.nearest(x, dep.two_means(x, parts))
    square = (some**2).sum(1)
    far = np.maximum(square[:, None] + square - 2 * some @ some.T, 0)
    np.fill_diagonal(far, np.inf)
    low, high = np.full(n, 1e-12), np.full(n, 1e12)
    target = np.log(min(perplexity, (n - 1) / 3))
    for _ in range(60):
        beta = np.sqrt(low * high)
        p = np.exp(-(far - far.min(1, keepdims=True)) * beta[:, None])
        p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
        wide = -(p * np.log(np.maximum(p, 1e-300))).sum(1) > target
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(dep.SEED).normal(0, 1e-2, (n, 3))
    speed = np.zeros_like(y)
    for k in range(rounds):
        square = (y**2).sum(1)
        q = 1 / (1 + np.maximum(square[:, None] + square - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        pull = (p * (4 if k < 80 else 1) - q / q.sum()) * q
        speed = (0.5 if k < 80 else 0.8) * speed - 50 * 4 * (pull.sum(1)[:, None] * y - pull @ y)
        y += speed
        y -= y.mean(0)
    label = dep.nearest(y, dep.two_means(y, parts))
    return dep.nearest(x, means(some, label))


def rdc_labels(rows: np.ndarray, parts: int = 2) -> np.ndarray:
    """Two-means on the random features of the columns' ranks."""
    rng = np.random.default_rng(dep.SEED)
    x = np.column_stack([dep.features(rows[:, i], rng) for i in range(rows.shape[1])])
    return dep.nearest(x, dep.two_means(x, parts))


def two_means_labels(rows: np.ndarray, parts: int = 2) -> np.ndarray:
    return dep.nearest(dep.impute(rows), dep.two_means(rows, parts))


#: Row splits by name; each gives a label for every row of the sample.
ROWS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"kmeans": two_means_labels, "rdc": rdc_labels, "gmm": gaussian_labels, "dbscan": density_labels, "tsne": embedded_labels}


def row_centres(rows: np.ndarray, how: str = "kmeans") -> np.ndarray:
    """The centres that route all rows. With one cluster only there is one centre."""
    return dep.two_means(rows) if how == "kmeans" else means(rows, ROWS[how](rows))


def condition_strength(rows: np.ndarray, scope: Sequence[int], conditions: Sequence[int]) -> dict[int, float]:
    """For each condition column its largest dependence on a column of the scope."""
    matrix = dep.rdc(rows)
    return {c: max(matrix[c, s] for s in scope) for c in conditions}


def median_cut(rows: np.ndarray, scope: Sequence[int], conditions: Sequence[int]) -> tuple[int, float]:
    """(column, cut): the condition column that depends least on the scope, at its median."""
    strength = condition_strength(rows, scope, conditions)
    column = min(conditions, key=lambda c: (strength[c], c))
    return column, float(np.nanmedian(rows[:, column]))


def equal_mass_cuts(x: np.ndarray, parts: int) -> np.ndarray:
    x = np.sort(x[np.isfinite(x)])
    return np.unique(x[(np.arange(1, parts) * len(x)) // parts]) if len(x) else x


def best_cut(rows: np.ndarray, scope: Sequence[int], conditions: Sequence[int], parts: int = 15, least: int = 10) -> tuple[int, float] | None:
    """(column, cut) of the equal-mass cuts of the condition columns after which scope and column depend least on each other on both sides together; both sides keep `least` rows; None if no cut does."""
    found = []
    for c in conditions:
        for cut in equal_mass_cuts(rows[:, c], parts):
            sides = rows[rows[:, c] <= cut], rows[rows[:, c] > cut]
            if min(map(len, sides)) >= least:
                found.append((sum(max(dep.rdc(s[:, [c, k]])[0, 1] for k in scope) for s in sides), c, float(cut)))
    return min(found)[1:] if found else None


def condition_centres(rows: np.ndarray, conditions: Sequence[int], how: str = "kmeans") -> np.ndarray:
    """Centres in the condition columns alone."""
    return row_centres(rows[:, list(conditions)], how)


def distinct_or_median(x: np.ndarray, most: int = 2) -> list[float]:
    """Cuts of one column: between all its values if there are at most `most`, else its median, or the value below where the median is the largest value."""
    values = np.unique(x[np.isfinite(x)])
    if len(values) <= most:
        return [float((a + b) / 2) for a, b in zip(values[:-1], values[1:], strict=True)]
    middle = float(np.median(x[np.isfinite(x)]))
    return [middle if middle < values[-1] else float(values[-2])]


def likeliest_binary(rows: np.ndarray, columns: Sequence[int]) -> int | None:
    """The 0/1 column whose halves, with independent columns inside, give the rows the highest likelihood; None if none varies."""

    def fit(part: np.ndarray) -> float:
        p = np.clip(part.mean(0), 1e-9, 1 - 1e-9)
        return float((part * np.log(p) + (1 - part) * np.log(1 - p)).sum())

    tried = [(fit(rows[rows[:, c] == 0]) + fit(rows[rows[:, c] == 1]), -c) for c in columns if 0 < rows[:, c].sum() < len(rows)]
    return -max(tried)[1] if tried else None


def random_binary(rows: np.ndarray, columns: Sequence[int], seed: int = 17) -> int | None:
    """The first 0/1 column, in a random order, that varies; None if none does."""
    for c in np.random.default_rng(seed).permutation(np.array(columns, int)).tolist():
        if set(np.unique(rows[:, c]).tolist()) == {0.0, 1.0}:
            return c
    return None


@lru_cache(maxsize=4)
def _bridge(draws: int = 4000, steps: int = 400) -> np.ndarray:
    """Sorted suprema of squared Brownian bridges over t(1-t), t trimmed at both ends: the statistic's distribution where nothing changes."""
    rng = np.random.default_rng(dep.SEED)
    t = np.arange(1, steps + 1) / steps
    inside = (t >= TRIM) & (t <= 1 - TRIM)
    walk = rng.standard_normal((draws, steps)).cumsum(1) / np.sqrt(steps)
    bridge = walk - walk[:, -1:] * t
    return np.sort((bridge[:, inside] ** 2 / (t * (1 - t))[inside]).max(1))


def stability_p(y: np.ndarray, by: np.ndarray) -> float:
    """The p-value that the Poisson mean of y stays the same along the order of `by`. The process is looked at behind ties only."""
    known = np.isfinite(y) & np.isfinite(by)
    y, by = y[known], by[known]
    if len(y) < 20 or y.mean() <= 0:
        return 1.0
    order = np.argsort(by, kind="stable")
    score = (y[order] - y.mean()).cumsum() / np.sqrt(max(y.var(), 1e-12) * len(y))
    t = np.arange(1, len(y) + 1) / len(y)
    ends = np.r_[by[order][1:] != by[order][:-1], True] & (t >= TRIM) & (t <= 1 - TRIM)
    if not ends.any():
        return 1.0
    top = (score[ends] ** 2 / (t * (1 - t))[ends]).max()
    null = _bridge()
    return float((len(null) - np.searchsorted(null, top, "left") + 1) / (len(null) + 1))


def bonferroni(p: np.ndarray, tests: int, exact: bool = False) -> np.ndarray:
    return 1 - (1 - p) ** tests if exact else np.minimum(1.0, p * tests)


def poisson_groups(rows: np.ndarray, alpha: float = 0.05) -> list[list[int]]:
    """Columns linked where either's mean changes along the other, by corrected p-values."""
    d = rows.shape[1]
    p = np.ones((d, d))
    for i in range(d):
        for j in range(d):
            if i != j:
                p[i, j] = stability_p(rows[:, i], rows[:, j])
    p = bonferroni(p, max(d - 1, 1))
    return dep.components(d, lambda i, j: min(p[i, j], p[j, i]) <= alpha)


def split_queries_by_means(groups: list[tuple[int, int]], width: int, least: float = 0.2) -> tuple[list[list[int]], float]:
    """(masks of each part, silhouette): two-means over (mask, queries) pairs, each counting by its queries; one part if the silhouette is not over `least`. The input has one entry for each distinct mask."""
    masks, n = [m for m, _ in groups], np.array([k for _, k in groups], float)
    x = np.array([[m >> i & 1 for i in range(width)] for m in masks], float).reshape(-1, width)
    if len(masks) < 2:
        return [masks], 0.0
    centres = dep.two_means(x)
    for _ in range(20):
        label = dep.nearest(x, centres)
        centres = np.array([np.average(x[label == k], axis=0, weights=n[label == k]) if (label == k).any() else centres[k] for k in (0, 1)])
    label = dep.nearest(x, centres)
    if len(set(label.tolist())) < 2:
        return [masks], 0.0
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    inside = np.array([(far[i] * n)[label == label[i]].sum() / max(n[label == label[i]].sum() - 1, 1e-9) if n[label == label[i]].sum() > 1 else 0.0 for i in range(len(x))])
    outside = np.array([np.average(far[i][label != label[i]], weights=n[label != label[i]]) for i in range(len(x))])
    alone = np.array([n[label == label[i]].sum() <= 1 for i in range(len(x))])
    quality = float(np.average(np.where(alone, 0.0, (outside - inside) / np.maximum(np.maximum(outside, inside), 1e-12)), weights=n))
    if quality <= least:
        return [masks], quality
    return [[m for m, k in zip(masks, label.tolist(), strict=True) if k == side] for side in (0, 1)], quality
