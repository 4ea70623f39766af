"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, hot_join, kept


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Each larger neighbour of a node joins the smallest node around that node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    met = hot_join(both.where("v > u"), least.select("u", F.least("u", "m").alias("m")), least, "u", "v", 2 * n)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Each smaller neighbour of a node, and the node, join the smallest of them."""
    down = edges.where("u > v").select("u", "v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
    met = hot_join(down, least.select("u", "m"), least, "u", "v", n).where("v > m")
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that has an edge; root is the smallest node of its component.

    Loops and repeated edges are harmless, null ends are dropped. Nothing but two numbers a round reaches the driver;
    each round ends in a table in the shared folder. A hub's rows are aggregated before they meet, and its join is dealt over tasks.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u > v").distinct()
    now = kept(now, "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        last, now = now, kept(_small(_large(now, state[0]), state[0]).where("u > v").distinct(), "edges")
        forget(last)
        state, old = _state(now), state
        if state == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
