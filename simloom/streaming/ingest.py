"""Streams of rows into a collection, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from simloom.sources.collection import Collection


def upserts(stream: DataFrame, into: Collection, checkpoint: str, **trigger) -> StreamingQuery:
    """Upserts every micro-batch of ``id, vector`` (``metadata``, ``pos``); batch b is committed as one seq.

    The batch's number is committed with its rows, so one that was committed before a restart is recognised and skipped.
    """
    return stream.writeStream.foreachBatch(lambda rows, number: into.upsert(rows, stream=number) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
