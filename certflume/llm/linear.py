"""What the trained operators share: bounded labelled samples and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .frames import crc_mod, quoted

#: Labelled rows that a classifier is fitted on, at most: those with the least hash of their id.
FIT_ROWS = 40_000


def labelled_sample(labels: DataFrame, label: str, doc_id: str = "doc_id", rows: int | None = FIT_ROWS, held: int = 5) -> DataFrame:
    """(id, y) of labelled rows that may be learned from, `rows` at most (None: all). Two labels of one id: the larger."""
    usable = labels.where(F.col(quoted(doc_id)).isNotNull() & F.col(quoted(label)).isin(0, 1) & (crc_mod(doc_id, held) != 0))
    one = usable.groupBy(F.col(quoted(doc_id)).cast("long").alias("__id")).agg(F.max(F.col(quoted(label)).cast("int")).alias("__y"))
    return one if rows is None else one.orderBy(F.xxhash64("__id"), "__id").limit(rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, free_bias: bool = True, steps: int = 30) -> np.ndarray:
    """Coefficients of ridge logistic regression on soft labels by Newton's method; the last is the bias (0 without one)."""
    if free_bias:
        x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    if free_bias:
        penalty[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, gradient)
        # A full step can overshoot where classes separate.
        w = w - move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-5:
            break
    return w if free_bias else np.append(w, 0.0)
