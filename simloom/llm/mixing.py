"""Mixing sources to target weights by a low-discrepancy schedule.

The points ``n G mod 2^31`` (``G / 2^31`` near the golden ratio's inverse) go through the cumulative target weights: each
slot falls to a source. Slots are ranked per source, and rank r takes block ``r mod blocks`` of that source's shuffled
documents, cut into blocks of equal tokens. A block is a small part of its source's target at every size of the corpus, and
a source weighs in the schedule by the number of its slots; what the points leave short of that number comes last. All steps are DataFrame operations. Prefix sums have two levels (bucket sums,
then within a bucket), so no source has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, kept, unused

_GOLDEN, _SPAN = 1327217885, 1 << 31
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """``doc_id, source, size, th, h``: words, a hash of the text, and the place in the shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("th"))
    return rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "th"))


def targets(rows: DataFrame, weights: list[float], total: float, cap: float) -> DataFrame:
    """``source, source_size, target``: weights go round the sources by code point, null last; ``total`` times all sizes is shared.

    A target stops at ``cap`` times its source's size and what it leaves is reshared by weight: sources in ascending order
    of cap by weight are capped while their cap is below the level of the rest. Only the table of sources is sorted here.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    every = W.partitionBy()
    s = s.withColumns({"top": F.lit(float(cap)) * F.col("source_size"), "all": F.lit(float(total)) * F.sum("source_size").over(every), "ws": F.sum("w").over(every)})
    up = W.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("top").over(up), F.lit(0.0))) / (F.col("ws") - F.coalesce(F.sum("w").over(up), F.lit(0.0))))
    s = s.withColumn("full", F.col("top") <= F.col("level") * F.col("w"))
    s = s.withColumn("open", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("top")).otherwise(F.col("open") * F.col("w")).alias("target"))


def placed(rows: DataFrame, buckets: int = 4096) -> DataFrame:
    """``rows`` with ``start``: words of the source's shuffled documents before the row."""
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bs"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("bs").over(before), F.lit(0)).alias("base"))
    inner = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "th", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return rows.join(base, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).select(*[c for c in rows.columns if c not in ("bucket", "inside")], (F.col("base") + F.col("inside")).alias("start"))


def schedule(goals: DataFrame, block: int | str, slots: int, cells: int = 1024, chunk: int = 8192) -> DataFrame:
    """``slot, source, rank, block, pass``: the mix's order. No block comes up more than its source's cap of two passes.

    ``block`` is the length of all blocks or the column of ``goals`` that has each source's. A source has as many slots as
    its target has blocks; those that the points leave out follow after slot ``slots``.
    """
    size = F.col(block) if isinstance(block, str) else F.lit(block)
    g = goals.where("target > 0").withColumns({"turns": F.col("target") / size, "blocks": F.ceil(F.col("source_size") / size)})
    g = g.withColumn("quota", F.least(F.round("turns").cast("long"), 2 * F.col("blocks")))
    total = F.sum("turns").over(W.partitionBy())
    upto = F.sum("turns").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    g = g.withColumn("hi", F.when(upto >= total * (1 - 1e-12), F.lit(float(_SPAN))).otherwise(upto / total * _SPAN))
    g = g.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy(F.col("source").asc_nulls_last())), F.lit(0.0)))
    ends = g.select("source", "lo", "hi", "blocks", "quota")
    cell = _SPAN // cells
    g = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.least(F.floor(F.col("hi") / cell), F.lit(cells - 1).cast("long")))))
    s = goals.sparkSession.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / chunk).alias("chunk"), F.expr(f"(id % {_SPAN}L) * {_GOLDEN}L % {_SPAN}L").alias("u"))
    s = s.withColumn("cell", F.floor(F.col("u") / cell)).join(g, "cell").where("u >= lo and u < hi")
    counts = s.groupBy("source", "chunk").agg(F.count("*").alias("c"))
    base = counts.select(F.col("source").alias("s2"), F.col("chunk").alias("c2"), F.coalesce(F.sum("c").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    s = s.withColumn("inside", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1)
    s = s.join(base, F.col("source").eqNullSafe(F.col("s2")) & (F.col("chunk") == F.col("c2"))).withColumn("rank", F.col("base") + F.col("inside"))
    s = s.where("rank < quota").select("slot", "source", "rank", "blocks")
    had = counts.groupBy("source").agg(F.sum("c").alias("had")).withColumnRenamed("source", "s2")
    short = ends.join(had, F.col("source").eqNullSafe(F.col("s2")), "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < quota")
    late = short.select("source", F.explode(F.sequence(F.col("had"), F.col("quota") - 1)).alias("rank"), "blocks")
    late = late.withColumn("slot", slots + F.row_number().over(W.orderBy("rank", F.col("source").asc_nulls_last())).cast("long") - 1)
    s = s.union(late.select("slot", "source", "rank", "blocks"))
    return s.select("slot", "source", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("pass"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[float] = (3, 1, 2), total: float = 1.5, cap: float = 2.0, pieces: int = 65536, most: int = 4096) -> DataFrame:
    """``doc_id, size, source_size, target, taken, th``, a row for each row of ``docs``: the words that the mix takes of it.

    A block has ``words / pieces`` words, at least 16 and at most ``most``, but no more than a 1,024th of its source's size and
    target (one word at least): so every source comes near its target; a source's last block may be shorter. With over 4,096
    sources that part is larger, a 64th at most. A null text has size 0 and gives nothing; a null source is a source of its
    own, the last. Equal ids and repeated rows keep apart.
    """
    rows = kept(sized(docs, id_col, text_col, source_col), "sized")
    goals = targets(rows, list(weights), total, cap)
    words, sources = rows.agg(F.sum("size")).first()[0] or 0, rows.select("source").distinct().count()
    block, parts = int(max(16, min(most, words // pieces))), max(64, min(1024, (1 << 22) // max(sources, 1)))
    own = F.floor(F.least(F.col("target"), F.col("source_size")) / parts)
    lengths = goals = kept(goals.withColumn("length", F.greatest(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), own))), "targets")
    turns = goals.agg(F.sum(F.col("target") / F.col("length"))).first()[0] or 0.0
    times = schedule(goals, "length", round(turns)).groupBy("source").agg(F.count("*").alias("times"))
    at = kept(placed(rows), "placed")
    forget(rows)
    # ranks go round the blocks: every block comes up ``times div blocks`` times, the first ``times mod blocks`` once more
    times = times.withColumnRenamed("source", "s3")
    goals = goals.join(times, F.col("source").eqNullSafe(F.col("s3")), "left").withColumn("times", F.coalesce("times", F.lit(0)))
    goals = goals.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("length"))))
    goals = goals.select("source", "source_size", "target", F.floor(F.col("times") / F.col("blocks")).alias("passes"), ((F.col("times") % F.col("blocks")) * F.col("length")).alias("upto"))
    goals = kept(goals, "turns")
    forget(lengths)
    goals = goals.withColumnRenamed("source", "s2")
    out = at.join(F.broadcast(goals) if goals.limit(100_001).count() <= 100_000 else goals, F.col("source").eqNullSafe(F.col("s2")))
    taken = F.col("passes") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("upto") - F.col("start")))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "th")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them: whole copies, then one cut after the words left over. Columns as in ``docs``.

    Null and blank texts are not taken. Rows that repeat id and text share what the mix takes of them, to the word. A null
    source is a source of its own; an empty table gives none.
    """
    h, id_, th, t, s, c, n, k = unused(docs.columns, "_h", "_id", "_th", "_t", "_s", "_c", "_n", "_k")
    taken = mix(docs, **options).groupBy("doc_id", "th").agg(F.sum("taken").alias(t), F.max("size").alias(s), F.count("*").alias(c))
    taken = taken.where(F.col(t) > 0).select(F.col("doc_id").alias(id_), F.col("th").alias(th), t, s, c)
    text = F.coalesce("text", F.lit(""))
    few = F.broadcast(taken) if taken.limit(500_001).count() <= 500_000 else taken
    rows = docs.withColumn(h, F.xxhash64(text)).join(few, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(th)))
    if taken.where(F.col(c) > 1).limit(1).count():  # the first of equal rows take a word more
        place = F.row_number().over(W.partitionBy(id_, th).orderBy(F.xxhash64(*docs.columns)))
        several = rows.where(F.col(c) > 1).withColumn(k, place)
        each = F.floor(F.col(t) / F.col(c)) + (F.col(k) <= F.col(t) % F.col(c)).cast("long")
        rows = rows.where(F.col(c) == 1).unionByName(several.withColumn(t, each).drop(k).where(F.col(t) > 0))
    left = F.expr(f"`{t}` % `{s}`")
    sizes = F.concat(F.array_repeat(F.col(s), F.expr(f"cast(`{t}` div `{s}` as int)")), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn(n, F.explode(sizes))
    cut = F.when(F.col(n) < F.col(s), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col(n).cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", cut)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
