"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join of what may have hit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, small, unused

#: A-Z and a-z, to lower-case these letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_WORDS = 8  # 64-bit words of a block; each key sets one bit in each
_SALTS = np.random.default_rng(77).integers(0, 2**63, _WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _bits(keys: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.fromiter((xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys), np.uint64, len(keys))
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return block.astype(np.int64), np.uint64(1) << ((h[:, None] * _SALTS) >> np.uint64(58))


def bloom(listed: DataFrame, column: str, bits_per_key: int = 16, most_bytes: int = 1 << 26) -> np.ndarray:
    """The blocks of the filter of the keys in ``column``: at most ``most_bytes``, built on the executors and or-ed by block.

    Past that size the rate of false positives grows; the exact join removes them all the same.
    """
    blocks = int(min(max(1, -(-listed.count() * bits_per_key // (64 * _WORDS))), most_bytes // (8 * _WORDS)))

    def run(batches):
        for batch in batches:
            keys = [k for k in batch.column(0).to_pylist() if k is not None]
            at, bits = _bits(keys, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(bits[:, i].view(np.int64)) for i in range(_WORDS))], ["block", *(f"w{i}" for i in range(_WORDS))])

    rows = listed.select(column).mapInArrow(run, "block long, " + ", ".join(f"w{i} long" for i in range(_WORDS)))
    found = rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS))).toPandas()
    out = np.zeros((blocks, _WORDS), np.uint64)
    if len(found):
        out[found["block"].to_numpy(np.int64)] = found[[f"w{i}" for i in range(_WORDS)]].to_numpy(np.int64).view(np.uint64)
    return out


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", most_rules: int = 100_000) -> DataFrame:
    """``pages`` with ``_host``, ``_path``, ``_rule``, ``_verdict``.

    ``rules`` has ``host, path, action``; each is a canonical URL that lists its host, all subdomains, and every path that
    starts with its own. The longest listed URL decides, of equally long ones that with the longer host; ``default`` where
    none fits. A null URL, or one without ``://``, has an empty host and path and fits no rule. Repeated rules: block wins.
    Rows are never merged or lost, an empty table gives none. Columns of ``pages`` with the four names are replaced.

    For every suffix of the host by labels and every length that a listed path has, the key is tested in the filter;
    only possible hits reach the join. Suffixes longer than the longest listed host cannot hit and are not made.
    """
    spark = pages.sparkSession
    keyed = rules.select(F.concat("host", "path").alias("_key"), F.length("host").alias("_h"), F.length("path").alias("_p"), "action").where("_key is not null")
    lengths = sorted(r[0] for r in keyed.select("_p").distinct().collect())  # at most as many as a path has characters
    keyed = keyed.groupBy("_key").agg(F.max("action").alias("action"), F.max("_h").alias("_h"))
    longest = keyed.agg(F.max("_h")).first()[0] or 0
    shared = spark.sparkContext.broadcast(bloom(keyed, "_key"))

    @F.arrow_udf("array<string>")
    def hits(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        blocks = shared.value
        keys, owner = [], []
        for i, (h, p) in enumerate(zip(hosts.to_pylist(), paths.to_pylist(), strict=True)):
            tail = h[-longest:] if longest else ""
            at = [0] if len(h) <= longest else []
            at += [k + 1 for k, c in enumerate(tail) if c == "."] if len(h) <= longest else [k + 1 for k, c in enumerate(tail) if c == "."]
            if len(h) > longest and longest and h[-longest - 1] == ".":
                at.append(0)
            for k in at:
                for n in lengths:
                    if n <= len(p) and tail[k:]:
                        keys.append(tail[k:] + p[:n])
                        owner.append(i)
        out: list[list[str]] = [[] for _ in range(len(hosts))]
        if keys:
            block, bits = _bits(keys, len(blocks))
            for k in np.flatnonzero(((blocks[block] & bits) == bits).all(1)):
                out[owner[k]].append(keys[k])
        return pa.array(out, pa.list_(pa.string()))

    # the result's own columns replace those of the same name; all others of the caller stay
    own = ["_host", "_path", "_rule", "_verdict"]
    rest = [c for c in pages.columns if c not in own]
    hit_col, row_col, key_col, best_col = unused(pages.columns, "_hits", "_row", "_found", "_best")
    base = pages.withColumns({"_host": host(F.col(url_col)), "_path": path(F.col(url_col))})
    base = base.withColumn(hit_col, hits("_host", "_path")).select(*rest, "_host", "_path", hit_col, F.monotonically_increasing_id().alias(row_col))
    base = kept(base, "pages")
    keys = small(keyed.select(F.col("_key").alias(key_col), F.col("_h").alias("_host_length"), "action"), most_rules)
    met = base.where(F.size(hit_col) > 0).select(row_col, F.explode(hit_col).alias(key_col)).join(keys, key_col)
    best = met.groupBy(row_col).agg(F.max_by(F.struct(key_col, "action"), F.struct(F.length(key_col), "_host_length")).alias(best_col))
    out = base.join(best, row_col, "left")
    return out.select(*rest, "_host", "_path", F.col(best_col)[key_col].alias("_rule"), F.coalesce(F.col(best_col)["action"], F.lit(default)).alias("_verdict"))
