"""Metrics: names, Column expressions and numpy kernels. Smaller distances are nearer; sums run in double, left to right."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted names, without regard to case (fixed).
NAMES = {"l2": "l2", "euclidean": "l2", "ip": "ip", "inner_product": "ip", "dot": "ip", "cosine": "cosine", "angular": "cosine"}


def metric(name: str) -> str:
    try:
        return NAMES[name.lower()]
    except (KeyError, AttributeError):
        raise ValueError(f"unknown metric {name!r}") from None


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, no root."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Divided by its length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(_double(v), lambda x: F.when(norm > 0, x / norm).otherwise(x))


def distance(name: str, a: Column, b: Column) -> Column:
    kind = metric(name)
    if kind == "l2":
        return l2sq(a, b)
    return 1 - dot(normalize(a), normalize(b)) if kind == "cosine" else 1 - dot(a, b)


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.zeros(len(x))
    for d in range(x.shape[1]):
        norm += x[:, d] * x[:, d]
    norm = np.sqrt(norm)
    return np.where(norm[:, None] > 0, x / np.where(norm > 0, norm, 1)[:, None], x)


def distances(name: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All distances of rows of q to rows of x; the order of summation is that of the Column form."""
    kind = metric(name)
    if kind == "cosine":
        q, x = unit_rows(q), unit_rows(x)
    out = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        if kind == "l2":
            diff = q[:, d, None] - x[None, :, d]
            out += diff * diff
        else:
            out += q[:, d, None] * x[None, :, d]
    return out if kind == "l2" else 1 - out
