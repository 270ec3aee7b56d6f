"""Fitting small linear models in numpy on the driver; the rows they are fitted on are a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minimise(f, x: np.ndarray, rounds: int = 200, memory: int = 8, tol: float = 1e-7) -> np.ndarray:
    """L-BFGS with backtracking; f gives value and gradient."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q = grad.copy()
        undo = []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            q -= a * y
            undo.append(a)
        if past:
            s, y, r = past[-1]
            q *= 1.0 / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(undo)):
            q += s * (a - r * (y @ q))
        slope = -(grad @ q)
        if slope >= 0:
            past, q, slope = [], grad, -(grad @ grad)
        step = 1.0 if past else min(1.0, 1.0 / (np.abs(grad).sum() + 1e-12))
        while True:
            new = x - step * q
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step *= 0.5
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            past = [*past, (s, y, 1.0 / (s @ y))][-memory:]
        done = abs(value - new_value) <= tol * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fold(doc_id: str, parts: int) -> Column:
    """The remainder of crc32 of the id as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def sample(labels: DataFrame, label: str, parts: int, held: int, limit: int) -> DataFrame:
    """At most `limit` labelled ids outside the held-out fold, chosen by a hash of the id: doc_id, label."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", parts) != held))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
