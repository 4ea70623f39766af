"""Operators of a training-data pipeline, each with its query in :mod:`simloom.llm.queries`.

Nothing else in the library imports this subpackage.
"""
