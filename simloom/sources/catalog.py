"""A registry of collections under one folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import Collection
from .files import Files

_NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")


class Catalog:
    def __init__(self, spark: SparkSession, root: str, fsync: bool = True):
        self.spark, self.files, self.open_ = spark, Files(spark, root, fsync), {}
        self.files.mkdirs()

    def _checked(self, name: str) -> str:
        if not _NAME.fullmatch(name):
            raise ValueError(f"bad name {name!r}")
        return name

    def create(self, name: str, dim: int, **options) -> Collection:
        if self.files.exists(f"{self._checked(name)}/config.json"):
            raise FileExistsError(name)
        self.open_[name] = Collection.create(self.spark, self.files.at(name), dim, name=name, **options)
        self.open_[name].files.fsync = self.files.fsync
        return self.open_[name]

    def get(self, name: str) -> Collection:
        if name not in self.open_:
            if not self.files.exists(f"{self._checked(name)}/config.json"):
                raise KeyError(name)
            self.open_[name] = Collection.open(self.spark, self.files.at(name))
            self.open_[name].files.fsync = self.files.fsync
        return self.open_[name]

    def names(self) -> list[str]:
        return [n for n in self.files.names() if self.files.exists(f"{n}/config.json")]

    def drop(self, name: str) -> None:
        self.get(name)
        del self.open_[name]
        self.files.delete(name)


def envelope(hits: DataFrame, include_metadata: bool = True) -> DataFrame:
    """``query_id, json``: the hits of a query as a JSON array, nearest first."""
    fields = ["rank", "id", "distance", *(["metadata"] if include_metadata and "metadata" in hits.columns else [])]
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("h"))
    return rows.select("query_id", F.to_json(F.transform("h", lambda x: F.struct(*(x[f].alias(f) for f in fields[1:])))).alias("json"))
