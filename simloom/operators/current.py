"""Current rows of an operation log: the latest operation of each id wins, deletes remove."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, columns: list[str]) -> DataFrame:
    """``id, seq, pos`` and ``columns`` of ids whose last operation by (seq, pos) is an upsert. Aggregated before the shuffle."""
    last = F.max_by(F.struct("op", "seq", "pos", *columns), F.struct("seq", "pos")).alias("last")
    return log.groupBy("id").agg(last).where(F.col("last.op") == "upsert").select("id", "last.seq", "last.pos", *(F.col(f"last.{c}").alias(c) for c in columns))


def existing(rows: DataFrame, ids: DataFrame) -> int:
    """How many of ``ids`` exist; an id given twice counts twice."""
    return ids.join(rows.select("id"), "id", "left_semi").count()
