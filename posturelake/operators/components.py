"""Connected components of a graph that is given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns ``src``, ``dst``); component is its least node.

    Alternates two star operations until nothing changes: first each node hands its larger neighbours to
    the least node around it, then its smaller ones. Every step is a partial-aggregated minimum and a join, no
    neighbourhood is gathered into one task, and the number of rounds grows with the logarithm of the
    size. Rows with a null end are left out; loops keep their node. Raises if ``max_rounds`` don't suffice.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    links = cut(edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct())
    nodes = links.select(F.col("hi").alias("node")).union(links.select(F.col("lo").alias("node"))).distinct()
    links = links.where("hi <> lo")
    seen = _mark(links)
    for _ in range(max_rounds):
        both = links.select(F.col("hi").alias("at"), F.col("lo").alias("to")).union(links.select(F.col("lo").alias("at"), F.col("hi").alias("to")))
        least = both.groupBy("at").agg(F.min("to").alias("m")).select("at", F.least("at", "m").alias("m"))
        wide = both.where("to > at").join(least, "at").select(F.col("to").alias("hi"), F.col("m").alias("lo")).distinct()
        low = wide.groupBy("hi").agg(F.min("lo").alias("m"))
        narrow = wide.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = cut(narrow.union(low.select("hi", F.col("m").alias("lo"))).distinct())
        now = _mark(links)
        if now == seen:
            return nodes.join(links.select(F.col("hi").alias("node"), F.col("lo").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _mark(links: DataFrame) -> tuple:
    """Count and order-free digest of an edge table."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
