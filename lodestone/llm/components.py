"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a > b). Each node links its larger (large) or smaller neighbours to the
    least of its neighbourhood. The least is aggregated before the shuffle; the join against it
    has one row a node on one side, so a hub's edges can be split among tasks."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, component``: every node of an edge with the smallest node it reaches.

    Nodes are longs or strings. Null ends, loops and repeated edges change nothing; an empty
    table gives no rows. Each round is written to the shared folder."""
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where((F.col(a).isNotNull()) & F.col(b).isNotNull())
    nodes = cut(e.distinct(), "cc")
    now, sign = nodes.where("a > b"), None
    for _ in range(max_rounds):
        now = cut(_star(_star(now, True), False), "cc")
        r = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("s")).first()
        if sign == (r["n"], r["s"]):
            break
        sign = (r["n"], r["s"])
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    alone = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti")
    return roots.union(alone.select("node", F.col("node").alias("component")))
