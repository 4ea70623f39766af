"""Token ids in range-coded block files, written in ascending document order and read back.

Documents are sorted by id across partitions; each partition encodes its texts and writes blocks of whole documents (see
:mod:`simloom.llm.range_coder`) as rows of a Parquet file in a folder that all machines share: the folder is the file set,
``part`` and ``block`` give the order. A block is decoded and checked by itself.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import CHUNK, buffers, chunks, model, only, shared_dir
from .range_coder import pack, unpack
from .words import Splitter, Table

BLOCK = 1 << 20
FILES = "part int, block int, docs long, ids long, payload binary"


class Tokenizer:
    """The ids that the tokenizers library gives for a file's JSON text.

    Of plain byte-level BPE files the library encodes each distinct word once (see :mod:`simloom.llm.words`), of others whole
    texts.
    """

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.library = tokenizers.Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(text)
        self.size = largest_id(spec) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.split = Splitter([t["content"] for t in spec["added_tokens"]]) if words_stand_alone(spec) else None
        self.table = Table(self._encoded, self.dtype)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int32, len(found))
        return counts, np.fromiter(chain.from_iterable(found), self.dtype, int(counts.sum()))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts ``data[offsets[i]:offsets[i+1]]`` in a row, and n + 1 offsets of texts into them."""
        if self.split is None:
            counts, ids = self._encoded([data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return ids, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        starts, ends, first = self.split(data, offsets)
        ids, upto = self.table.ids(data, starts, ends)
        return ids, upto[first]


def words_stand_alone(spec: dict) -> bool:
    """Whether a tokenizer file is a plain byte-level BPE whose words are those of :data:`simloom.llm.words.PATTERN`."""
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
    return bool(plain and not spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model["type"] == "BPE" and not model.get("dropout"))


def largest_id(spec: dict) -> int:
    vocab = spec["model"]["vocab"]
    return max([*(vocab.values() if isinstance(vocab, dict) else range(len(vocab))), *(t["id"] for t in spec["added_tokens"])])


def _tokenizer(text: str) -> Tokenizer:
    return model(("tokens", hash(text)), lambda: Tokenizer(text))


def write(docs: DataFrame, tokenizer: str, out: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = 0, partitions: int | None = None, block: int = BLOCK) -> None:
    """Writes the ids of every text, ``end`` after each document, to the folder ``out``.

    A null text has the end id only. Null ids come first; equal ids are ordered by their texts' hashes, so reruns agree.
    """
    spark = docs.sparkSession
    shared = bpe.read(spark, tokenizer)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        t = _tokenizer(shared.value)
        part, number, keys, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        last = np.array([] if end is None else [end], t.dtype)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([size], pa.int64()), pa.array([pack(keys, ids, t.size)], pa.binary())], ["part", "block", "docs", "ids", "payload"])

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets, 4 * CHUNK):
                found, first = t.ids(data, offsets[i : j + 1])
                for key, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    x = np.concatenate([found[a:b], last])
                    keys.append(key)
                    ids.append(x)
                    size += len(x)
                    if size >= block:
                        yield flush()
                        number, keys, ids, size = number + 1, [], [], 0
        if keys:
            yield flush()

    rows.mapInArrow(run, FILES).write.option("compression", "uncompressed").parquet(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


def documents(files: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids`` of every document in the files. A damaged block raises."""
    spec = _size(tokenizer)

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                keys, ids = unpack(raw.as_py(), spec)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return files.select("payload").mapInArrow(run, "doc_id long, ids array<int>")


def _size(tokenizer: str) -> int:
    with open(tokenizer, encoding="utf-8") as f:
        return largest_id(json.load(f)) + 1


def digests(files: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; start counts the ids of all documents before it.

    Block sizes are summed by part, then within a part: no task sees more than a part's blocks or all parts' sums.
    """
    size = _size(tokenizer)
    sums = files.groupBy("part").agg(F.sum("ids").alias("n"))
    before = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = files.select("part", "block", F.coalesce(F.sum("ids").over(W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("inner"))
    base = inner.join(before, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("block").alias("b"), (F.col("base") + F.col("inner")).alias("base"))

    def run(batches):
        only()
        for batch in batches:
            for part, number, raw in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                keys, ids = unpack(raw.as_py(), size)
                n = np.array([len(x) for x in ids], np.int64)
                k = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * k, pa.int32()), pa.array([number.as_py()] * k, pa.int32()), pa.array(keys, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                    ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "block", "payload").mapInArrow(run, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """:func:`digests` of what :func:`write` put into a new shared folder."""
    out = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, tokenizer, out, **options)
    return digests(read(docs.sparkSession, out), tokenizer)
