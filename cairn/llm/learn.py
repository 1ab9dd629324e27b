"""What the two classifiers share: a bounded sample of labelled rows and small numpy fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import crc_fold


def sample(
    docs: DataFrame, labels: DataFrame, label: str, each: int, most_chars: int, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """Up to `each` labelled rows of either class as (doc_id, text, label), and how many rows each class has.

    Only rows of folds other than 2 (crc32 of doc_id as text, modulo 4) are seen. The sample is the identifiers with the
    smallest hash; a doc_id with several labels has the greatest, and if several texts have it, the least one counts; texts of
    over most_chars characters and null labels are left out. Each distinct text comes once. The driver holds at most
    2 x each x most_chars characters.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter((crc_fold(F.col("doc_id")) != 2) & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id")
    chosen = order.filter("y = 0").limit(each).unionByName(order.filter("y = 1").limit(each)).select("doc_id", "y")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.filter(F.col("text").isNotNull() & (F.length("text") <= most_chars))
    # broadcast: at most 2 x each rows of two numbers
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.y)):
        first.setdefault(r.text, (r.doc_id, r.text, r.y))
    return sorted(first.values()), {int(y): n for y, n in counts.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


class Adam:
    def __init__(self, *params: np.ndarray, rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, *slopes: np.ndarray) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, slopes, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
