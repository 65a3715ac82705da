"""Connected components of a link table by contraction; every step is a grouped or joined table, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage


def _flat(parent: DataFrame) -> DataFrame:
    """Follows parents until every node points to a root; the longest path halves each time."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("top"))
        parent = cut_lineage(parent.join(up, "parent").select("node", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).alias("moved")))
        if not parent.where("moved").limit(1).count():
            return parent.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); root is the smallest node of its component.

    Each round points every node to its smallest neighbour, flattens the resulting forest and contracts the links to
    its roots. A component of one centre and many links takes one round; a chain needs a logarithm of its length.
    """
    edges = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    found = None
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        parent = _flat(cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("parent"))))
        if found is None:
            found = parent.select("node", F.col("parent").alias("root"))
        else:
            up = parent.select(F.col("node").alias("root"), F.col("parent").alias("top"))
            found = cut_lineage(found.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        ends = [parent.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root")) for c in ("a", "b")]
        edges = cut_lineage(edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
