"""A training-data pipeline: each stage is one operator and works on what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simloom.llm import bpe, langid, mixing, ngram_join, toxicity
from simloom.llm.common import forget, kept, small, small_batches, table, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null text, no letter) and those whose main language has under half of the words.

    Null ids and languages are no reason to go; repeated rows are judged alike. An empty table gives none, and one without
    any language to learn from keeps nothing.
    """
    small_batches(spark)
    got = langid.identify(docs)
    return got.where((F.col("_lid.lang") != "und") & (F.col("_lid.score") >= 0.5)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more.

    Null and blank texts have the score of a text without words; labels of ids that no document has teach nothing; without
    labels of both classes every score is 0 and all stay. Repeated rows are judged alike; an empty table gives none.
    """
    small_batches(spark)
    return toxicity.detect(docs, table(spark, sf_dir, "labels")).where("_toxic < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of the smallest id (then text hash) stays; of rows that repeat id and text, one.

    Rows are told apart by id and text: an id that comes with unrelated texts keeps each. Rows of null id are no one's
    duplicates and stay.
    """
    small_batches(spark)
    groups = kept(ngram_join.component_rows(docs.select("doc_id", "text")), "groups")
    th, n = unused(docs.columns, "_th", "_n")
    named, both = docs.withColumn(th, F.xxhash64("text")), ["doc_id", th]
    row = [F.col("doc_id"), F.col("th").alias(th)]
    gone = groups.where("component_id <> doc_id or (component_id = doc_id and component_th <> th)").select(*row).distinct()
    rest = named.join(small(gone, 1_000_000), both, "left_anti")
    twice = groups.groupBy("doc_id", "th").count().where("count > 1 and doc_id is not null").select(*row)
    if not twice.limit(1).count():
        return rest.select(*docs.columns)
    few = small(twice, 1_000_000)
    order = W.partitionBy(*both).orderBy(F.xxhash64(*docs.columns))
    one = rest.join(few, both, "left_semi").withColumn(n, F.row_number().over(order)).where(F.col(n) == 1)
    return rest.join(few, both, "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; the last taken of a source may be cut.

    Blank and null texts are taken no words of and go; a null source is one of its own, the last. Repeated rows share.
    """
    return mixing.mixed_documents(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, copies too; a null or empty text has no ids."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("source mix", source_mix), ("BPE", bpe_round_trip)]

#: Trained models and unions of components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of ``documents``: each stage's result is written, read by the next, and then deleted."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = kept(docs, f"stage{i}")
            forget(before)
    return docs
