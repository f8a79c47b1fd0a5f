"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("parent").alias("node"), F.col("node").alias("parent")))
    smallest = both.groupBy("node").agg(F.least(F.min("parent"), F.col("node")).alias("smallest"))
    joined = both.join(smallest, "node").where("parent > node")
    return joined.select(F.col("parent").alias("node"), F.col("smallest").alias("parent")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and the nodes it is linked to below are linked to the smallest of these."""
    smallest = edges.groupBy("node").agg(F.min("parent").alias("smallest"))
    others = edges.join(smallest, "node").where("parent <> smallest")
    moved = others.select(F.col("parent").alias("node"), F.col("smallest").alias("parent"))
    return moved.union(smallest.select("node", F.col("smallest").alias("parent"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """The component of each linked node: node, component (the smallest node that it reaches).

    ``links`` has two long columns ``a`` and ``b``, in any direction, repeated or not. A link to
    itself or to null links nothing; a node with only such links has no row. Each round is written to the
    shared folder; a path of n links takes about log n rounds. Nothing is collected but a checksum.
    """
    start = links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent"))
    edges, before = stored(start.distinct(), "edges"), None
    while True:
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "parent")), F.sum(F.col("node") % 65_521)).first()
        if tuple(row) == before or not row[0]:
            roots = edges.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
            return edges.select("node", F.col("parent").alias("component")).unionByName(roots)
        before = tuple(row)
        edges = stored(_small_star(_large_star(edges)), "edges")
