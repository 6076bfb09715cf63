"""Bounded samples of labelled documents, and a small logistic calibration."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def fitted(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, fit: Callable[[list[str], np.ndarray], object]) -> object:
    """``fit`` of at most ``per_class`` labelled rows of each class where ``train`` holds, the same in every run.

    Whole texts of the chosen rows go to one task, which fits and returns the model: the
    driver holds the model only, and the task memory in proportion to ``per_class`` texts.
    """
    parts = []
    for value in (0, 1):
        rows = labels.where((F.col(label) == value) & F.col("doc_id").isNotNull() & train).select("doc_id").distinct()
        ids = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)  # at most per_class ids: safe to broadcast
        picked = docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(ids), "doc_id")
        parts.append(picked.select("text", F.lit(value).alias("label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(y, t) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist())})
        model = fit([t for _, t in rows], np.array([y for y, _ in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # Spark starts no task for no partition: without rows the model of no texts is made here
    found = parts[0].unionByName(parts[1]).coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else fit([], np.array([]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one constant, by Newton steps; classes count alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if len(set(y.tolist())) < 2:  # one class or none: the score is its share, undecided without rows
        w[-1] = 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)
        return w
    weight = np.where(y == 1, len(y) / 2 / max(1, (y == 1).sum()), len(y) / 2 / max(1, (y == 0).sum()))
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (p - y)) + keep * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ w, -30, 30)))
