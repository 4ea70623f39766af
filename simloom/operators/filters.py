"""Metadata filters compiled to a two-valued Column over ``terms``. All of a filter is validated before any job runs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from simloom.functions.terms import _constant, token


def parse(where: str | dict | None) -> dict | None:
    """The filter as an object; None if there is none (null, empty text, ``{}``)."""
    if where is None or where == "":
        return None
    if isinstance(where, str):
        try:
            where = json.loads(where, parse_constant=_constant)
        except ValueError as e:
            raise ValueError(f"bad filter: {e}") from None
    if where is None:
        return None
    if not isinstance(where, dict):
        raise ValueError("a filter must be an object")
    return where or None


def _equals(terms: Column, field: str, value) -> Column:
    if isinstance(value, dict | list):
        raise ValueError(f"{field}: only scalars can be compared")
    return F.array_contains(terms, F.lit(token(field, value)))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def compiled(where: str | dict | None, terms: Column) -> Column:
    """Rows that pass. ``$ne`` and ``$nin`` also pass rows that lack the field; an array field matches by any element."""
    where = parse(where)
    return F.lit(True) if where is None else _object(where, terms)


def _object(where: dict, terms: Column) -> Column:
    parts = []
    for field, want in where.items():
        if field in ("$and", "$or"):
            if not isinstance(want, list) or not want:
                raise ValueError(f"{field} takes a non-empty array")
            if not all(isinstance(w, dict) for w in want):
                raise ValueError(f"{field} takes objects")
            parts.append((_all if field == "$and" else _any)([_object(w, terms) for w in want]))
        elif field.startswith("$"):
            raise ValueError(f"unknown operator {field}")
        elif isinstance(want, dict):
            parts += [_operator(field, op, arg, terms) for op, arg in want.items()]
        else:
            parts.append(_equals(terms, field, want))
    return _all(parts)


def _operator(field: str, op: str, arg, terms: Column) -> Column:
    if op in ("$eq", "$ne"):
        same = _equals(terms, field, arg)
        return same if op == "$eq" else ~same
    if op in ("$in", "$nin"):
        if not isinstance(arg, list):
            raise ValueError(f"{op} takes an array")
        among = _any([_equals(terms, field, v) for v in arg])
        return among if op == "$in" else ~among
    raise ValueError(f"unknown operator {op}")
