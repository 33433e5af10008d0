"""Connected components by alternating large-star and small-star steps, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import settle


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _counted(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges, settled, with their number and sum of hashes, which are observed while they are written and take no job of their own."""
    seen = Observation()
    measures = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")
    return settle(edges.observe(seen, *measures), "cc"), seen.get


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); a component is named by its least node.

    Self-links are left out, repeated links count once; no edges give no rows. Each round halves path lengths at least, so
    the number of rounds grows with the logarithm of the longest chain.
    """
    now, state = _counted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while state != before and state["n"]:
        before = state
        both = _both_ways(now)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now, state = _counted(small.where("a <> b").distinct())
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after joining the components that ``links`` (a, b: nodes) connect; without links, they are the given ones."""
    if links.isEmpty():
        return labels
    by = labels.select(F.col("node"), F.col("component"))
    at = links.join(by.withColumnsRenamed({"node": "a", "component": "ca"}), "a").join(by.withColumnsRenamed({"node": "b", "component": "cb"}), "b")
    found = settle(connected_components(at.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "merged")  # as a table of its own, so that the join can split a large component
    moved = labels.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return settle(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")
