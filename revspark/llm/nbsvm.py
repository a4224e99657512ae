"""Quality classifier: naive-Bayes support vectors.

n-gram indicators are scaled by the class log-count ratio of the n-gram and a linear hinge
loss is minimised over them by dual coordinate descent; a logistic curve through the
margins of rows that were held back from the fit turns margins into probabilities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import LinearModel, ShapeAndCharacterGrams, gather, one_label, platt, sampled_ids

#: Documented bound of the fit: labelled rows taken of each class.
ROWS_PER_CLASS = 4000


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(size, alpha), np.full(size, alpha)]
    for ids, label in zip(rows, y):
        counts[int(label)][ids] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the L1-loss linear SVM over unit vectors x_i = r[ids_i] / |r[ids_i]|.

    Solves min over alpha in [0, cost_i] one coordinate at a time, in a new random order each
    epoch; y is +1 or -1.
    """
    w = np.zeros(len(r))
    alpha = np.zeros(len(rows))
    xs = [r[ids] / max(np.linalg.norm(r[ids]), 1e-9) for ids in rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            if not len(rows[i]):
                continue
            g = y[i] * (w[rows[i]] @ xs[i]) - 1
            new = min(max(alpha[i] - g, 0.0), cost[i])
            if new != alpha[i]:
                worst = max(worst, abs(new - alpha[i]))
                w[rows[i]] += (new - alpha[i]) * y[i] * xs[i]
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def fit(docs: DataFrame, labelled: DataFrame, per_class: int = ROWS_PER_CLASS, cost: float = 1.0, beta: float = 0.25, extract: ShapeAndCharacterGrams | None = None) -> LinearModel:
    """Fits on at most `per_class` rows of each class of `labelled` (doc_id, label 0/1).

    The rows are those with the least hashed doc_id, so that the sample is the same on any
    cluster. Rows with a null in either column are ignored, and a doc_id with both labels teaches nothing. With one class or none the model
    scores every text alike, by the share of class 1.
    """
    extract = extract or ShapeAndCharacterGrams()
    labelled = one_label(labelled)
    totals = {r["tag"]: r["n"] for r in labelled.groupBy("tag").agg(F.count("*").alias("n")).collect()}  # two rows at most
    chosen = [sampled_ids(labelled.where(F.col("tag") == k), per_class, 7) for k in (0, 1)]
    tags, rows = gather(docs, chosen[0].unionByName(chosen[1]), extract)
    size = 1 << extract.bits
    if not (tags == 0).any() or not (tags == 1).any():
        p = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
        return LinearModel(extract, np.zeros(size, np.float32), None, 0.0, float(np.log(p / (1 - p))))
    held = np.arange(len(rows)) % 4 == 0
    if len({*tags[~held]}) < 2 or len({*tags[held]}) < 2:
        held[:] = False
    r = log_count_ratios([x for x, h in zip(rows, held) if not h], tags[~held], size)
    y = np.where(tags == 1, 1.0, -1.0)
    share = {k: max((tags[~held] == k).sum(), 1) / len(tags[~held]) for k in (0, 1)}
    costs = np.array([cost * 0.5 / share[int(k)] for k in tags])
    part = [i for i in range(len(rows)) if not held[i]]
    w = dual_coordinate_descent([rows[i] for i in part], y[part], r, costs[part])
    w = (1 - beta) * np.abs(w).mean() + beta * w
    model = LinearModel(extract, (w * r).astype(np.float32), r.astype(np.float32))
    if not held.any():
        held[:] = True
    sampled = {k: (tags == k).sum() for k in (0, 1)}
    weight = np.array([totals[int(k)] / sampled[int(k)] for k in tags[held]])
    model.slope, model.offset = platt(model.margins([x for x, h in zip(rows, held) if h]), tags[held], weight)
    return model
