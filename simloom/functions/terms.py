"""Terms of JSON metadata: one token for each top-level scalar and each scalar in a top-level array."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


def load(text: str | None) -> dict:
    """A metadata object; null or empty is ``{}``. ValueError for anything else than an object."""
    if not text:
        return {}
    found = json.loads(text, parse_constant=_constant)
    if not isinstance(found, dict):
        raise ValueError("metadata must be a JSON object")
    return found


def key(value) -> str:
    """Equal for equal scalars: an integral double below 9e15 is its integer; "3", 3 and true differ."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 9e15:
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def token(field: str, value) -> str:
    return json.dumps([field, key(value)], ensure_ascii=False)


def tokens(text: str | None) -> list[str]:
    out = {}
    for field, value in load(text).items():
        for v in value if isinstance(value, list) else [value]:
            if not isinstance(v, dict | list):
                out[token(field, v)] = None
    return list(out)


def terms(metadata: Column) -> Column:
    """array<string>, never null."""

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([tokens(x) for x in column.to_pylist()], pa.list_(pa.string()))

    return run(metadata)
