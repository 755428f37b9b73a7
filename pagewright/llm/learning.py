"""What the trained operators share: the bounded sample of labelled rows, and the optimiser."""

from __future__ import annotations

import ctypes

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each class that are learnt from, and the longest text among them in bytes. These bound what
#: the driver holds (2 * PER_CLASS * LONGEST bytes); whole texts are learnt from, and longer ones only scored.
PER_CLASS, LONGEST = 1500, 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, longest: int = LONGEST) -> list[tuple[str, int]]:
    """(text, label) of up to `per_class` training rows of each class, chosen by a hash of their ids.

    The ids come from the labels alone; only the texts of these ids are read and sent to the driver. A document with
    several labels counts with the largest; null ids, labels and texts aren't learnt from."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & common.training_row("doc_id")).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen: dict[int, int] = {}
    for y in (0, 1):
        chosen |= {r[0]: y for r in known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class).select("doc_id").collect()}
    if not chosen:
        return []
    ids = spark.createDataFrame(list(chosen.items()), "sample_id long, y int")
    fit = docs.select(F.col(key).cast("long").alias("sample_id"), F.col(text).alias("t")).filter(F.col("t").isNotNull() & (F.octet_length("t") <= longest))
    rows = fit.join(F.broadcast(ids), "sample_id").groupBy("sample_id", "y").agg(F.min("t").alias("t")).collect()
    return [(r["t"], r["y"]) for r in sorted(rows, key=lambda r: r["sample_id"])]


def give_back() -> None:
    """Have the C library return what was freed to the system, where it can: a driver works on long after it has learnt."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):
        pass


def summed(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in `at`, and for each the sum of its rows of values."""
    order = np.argsort(at, kind="stable")
    by = at[order]
    first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, np.int64)
    return by[first], np.add.reduceat(values[order], first, axis=0) if len(by) else values[:0]


class Adam:
    """Steps for a dictionary of arrays. A gradient of a few rows is given as (rows, values); the others rest."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        scale = (rate or self.rate) * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            m = self.m[k][at]
            m = m + 0.1 * (g - m)
            v = self.v[k][at]
            v = v + 0.001 * (g * g - v)
            self.m[k][at], self.v[k][at] = m, v
            self.params[k][at] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve over one number, by Newton's method with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        g = np.array([np.sum(weight * (p - y) * x) + 0.05 * (a - 1), np.sum(weight * (p - y)) + 0.05 * b])
        w = weight * p * (1 - p) + 1e-9
        h = np.array([[np.sum(w * x * x) + 0.05, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.05]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 0.0), float(b)
