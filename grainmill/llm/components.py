"""Connected components of a link table by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _signature(links: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: two LONG columns a, b. Returns (node, root), one row for each node that has a link to another node;
    root is the smallest node of its component. Each round links every node to the smallest neighbour it knows, so
    paths halve and the number of rounds grows with the logarithm of the longest path. Rows with nulls and self
    links count as no link. Work in a round is joins on the node; a node with very many links is split by Spark's
    skewed-join handling, and nothing is gathered in one task or the driver."""
    e = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for _ in range(rounds):
        # every node's larger neighbours go to the smallest of the node and its neighbours
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every node and its smaller neighbours go to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        e = cut(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a > b").distinct())
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
