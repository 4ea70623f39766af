"""Deterministic graph levels of labels: a 64-bit mix of seed and label, through the logarithm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The published SplitMix64 finaliser (its three constants and shifts are fixed)."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def draw(labels: np.ndarray, seed: int = 42, m: int = 16, most: int = 32) -> np.ndarray:
    bits = splitmix64(np.uint64(seed) ^ splitmix64(labels.astype(np.int64).view(np.uint64)))
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return np.minimum((-np.log(u) / np.log(m)).astype(np.int64), most)


def level(label: Column, seed: int = 42, m: int = 16) -> Column:
    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(draw(np.asarray(column), seed, m))

    return run(label)
