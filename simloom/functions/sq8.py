"""8-bit scalar quantization: per-dimension ranges, codes 0 to 255, asymmetric distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import metric


def ranges(df: DataFrame, vec: str) -> DataFrame:
    """``pos, lo, hi, scale`` by dimension; a constant dimension has scale 1."""
    r = df.select(F.posexplode(F.col(vec).cast("array<double>"))).groupBy("pos").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    return r.select(F.col("pos").cast("long").alias("pos"), "lo", "hi", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 255).otherwise(1.0).alias("scale"))


def collected(r: DataFrame) -> DataFrame:
    """The ranges as one row of arrays ``mins`` and ``scales``, to join on."""
    a = r.agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "scale"))).alias("r"))
    return a.select(F.transform("r", lambda x: x["lo"]).alias("mins"), F.transform("r", lambda x: x["scale"]).alias("scales"))


def widen(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ranges that hold both; what a quantizer does while it is not frozen."""
    both = old.union(new).groupBy("pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return both.select("pos", "lo", "hi", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 255).otherwise(1.0).alias("scale"))


def encode(v: Column, mins: Column, scales: Column) -> Column:
    """Codes, rounded half to even and clamped."""
    t = F.zip_with(F.zip_with(v.cast("array<double>"), mins, lambda x, m: x - m), scales, lambda x, s: F.rint(x / s))
    return F.transform(t, lambda c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)).cast("int"))


def decode(codes: Column, mins: Column, scales: Column) -> Column:
    return F.zip_with(F.zip_with(codes, scales, lambda c, s: c * s), mins, lambda x, m: m + x)


def distance(name: str, q: Column, codes: Column, mins: Column, scales: Column) -> Column:
    """Distance of a full query to a code: by the decoded vector. Cosine takes unit vectors on both sides as given."""
    from .metrics import dot, l2sq

    x = decode(codes, mins, scales)
    return l2sq(q, x) if metric(name) == "l2" else 1 - dot(q, x)


def coded_rows(x: np.ndarray, mins: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """:func:`encode` of rows, as bytes."""
    return np.clip(np.rint((x - mins) / scales), 0, 255).astype(np.uint8)


def decoded_rows(codes: np.ndarray, mins: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """:func:`decode` of rows of bytes."""
    return mins + codes * scales
