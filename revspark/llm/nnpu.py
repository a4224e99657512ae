"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over word indicators is trained from confirmed toxic texts and
unlabelled texts. The risk pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) corrects the unlabelled texts,
all treated as negative, by the class prior pi; where the second term turns negative the
step goes up its gradient instead, which keeps the model from memorising the positives.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import LinearModel, WordGrams, gather, one_label, platt, sampled_ids

#: Documented bounds of the fit.
POSITIVE_ROWS, UNLABELLED_ROWS = 4000, 8000


class _Rows:
    """Sparse indicator rows, with sums by row and by feature."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.lens = np.array([len(r) for r in rows], np.int64)
        self.ids = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), self.lens)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.ids], minlength=self.n)

    def back(self, coef: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, weights=coef[self.row], minlength=size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, size: int, steps: int = 300, rate: float = 1.0, sigmas: float = 3.0, min_rows: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias minimising the non-negative risk under logistic loss, by proximal gradient steps.

    Each feature's L1 penalty is `sigmas` times the sampling error that its rate among
    the positives puts into its gradient, so that chance differences get no weight. Features seen
    in fewer than min_rows texts have none either.
    """
    seen = np.bincount(np.concatenate([*pos, *unl, np.zeros(0, np.int32)]), minlength=size)
    usable = np.flatnonzero(seen >= min_rows)
    at = np.full(size, -1, np.int64)  # steps run over usable features alone
    at[usable] = np.arange(len(usable))
    p, u = (_Rows([k[k >= 0] for k in (at[r] for r in rows)]) for rows in (pos, unl))
    whole, size, seen = np.zeros(size), len(usable), seen[usable]
    rate_seen = np.minimum((seen + 1) / (p.n + u.n + 2), 0.5)
    l1 = sigmas * prior * np.sqrt(rate_seen * (1 - rate_seen) * (1 / p.n + 1 / u.n))
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    velocity, vb = np.zeros(size), 0.0
    for _ in range(steps):
        zp, zu = p.times(w) + b, u.times(w) + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        plus = (prior / p.n) * (sp - 1)  # d/dz of prior * mean(log(1 + exp(-z)))
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        minus_u, minus_p = su / u.n, -(prior / p.n) * sp
        if risk < 0:
            cp, cu = -minus_p, -minus_u
        else:
            cp, cu = plus + minus_p, minus_u
        grad = p.back(cp, size) + u.back(cu, size)
        velocity = 0.9 * velocity + grad
        vb = 0.9 * vb + cp.sum() + cu.sum()
        w = w - rate * velocity
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b -= rate * 0.1 * vb
    whole[usable] = w
    return whole, b


def fit(docs: DataFrame, labelled: DataFrame, positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS, extract: WordGrams | None = None) -> LinearModel:
    """Fits on at most `positives` rows with label 1 of `labelled` (doc_id, label) and `unlabelled` rows of docs.

    The class prior is the share of label 1 over all of `labelled`; labels of the unlabelled
    sample aren't read. Sampled rows are those of least hashed doc_id. Margins are turned into
    probabilities on a quarter of the sampled positives and as many sampled labelled rows of class 0.
    A doc_id with both labels teaches nothing. Without any row of class 1 every text gets the same low score.
    """
    extract = extract or WordGrams()
    labelled = one_label(labelled)
    totals = {r["tag"]: r["n"] for r in labelled.groupBy("tag").agg(F.count("*").alias("n")).collect()}  # two rows at most
    size = 1 << extract.bits
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    ids = sampled_ids(labelled.where("tag = 1"), positives, 11).select("doc_id", F.lit(1).alias("tag"))
    ids = ids.unionByName(sampled_ids(docs.select("doc_id").where("doc_id is not null"), unlabelled, 13).select("doc_id", F.lit(2).alias("tag")))
    ids = ids.unionByName(sampled_ids(labelled.where("tag = 0"), positives, 17).select("doc_id", F.lit(0).alias("tag")))
    tags, rows = gather(docs, ids.distinct(), extract)
    held = np.zeros(len(rows), bool)
    for k in (0, 1):
        held[np.flatnonzero(tags == k)[::4]] = True
    pos = [rows[i] for i in np.flatnonzero((tags == 1) & ~held)]
    unl = [rows[i] for i in np.flatnonzero(tags == 2)]
    if not pos or not unl:
        return LinearModel(extract, np.zeros(size, np.float32), None, 0.0, float(np.log(prior / (1 - prior))))
    w, b = train(pos, unl, min(prior, 0.5), size)
    model = LinearModel(extract, w.astype(np.float32), None, 1.0, b)
    if (tags[held] == 0).any() and (tags[held] == 1).any():
        counts = {k: (tags[held] == k).sum() for k in (0, 1)}
        weight = np.array([totals[int(k)] / counts[int(k)] for k in tags[held]])
        model.slope, model.offset = platt(model.margins([rows[i] for i in np.flatnonzero(held)]), tags[held], weight)
    return model
