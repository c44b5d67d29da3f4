"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot_keys import join_split
from .scratch import stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).first()
    return row["n"], row["h"] or 0


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v), where component is the smallest node reachable.

    Alternating star contraction: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows, until only stars are left. The number of rounds grows with the logarithm of the
    longest path. Each round joins a table of one row per node, and a hub's links are split over tasks.
    Self links and repeated links are allowed; no links give no rows.
    """
    edges = stored(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = _mark(edges)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n")).select("u", F.least("u", "v").alias("m"), "n"), "least")
        large = join_split(both.where(F.col("v") > F.col("u")), least.select("u", "m"), "u", least.select("u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "large-star")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        pulled = join_split(large, low.select("u", "m"), "u", low.select("u", "n"))
        small = pulled.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "small-star")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
