"""Connected components of a graph given as pairs of long node ids, by hooking and pointer jumping on contracted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _follow(df: DataFrame, col: str, pointers: DataFrame) -> DataFrame:
    """Replace a node column by what the pointers (node, root) say, if anything."""
    p = pointers.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return df.join(p, F.col(col) == F.col("_n"), "left").withColumn(col, F.coalesce("_r", col)).drop("_n", "_r")


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) for every node whose component has a smaller node: root is the smallest. None without edges.

    ``edges`` has the long columns a and b. Every round points each root at its smallest
    neighbour, flattens the pointers and contracts the edges to roots; each table is stored, so
    nothing is recomputed and nothing but counts reaches the driver.
    """
    rounds: list[DataFrame] = []
    left = save(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while not left.isEmpty():
        pointers = save(left.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node"), "hooks")
        while True:
            shorter = save(_follow(pointers.withColumn("old", F.col("root")), "root", pointers), "hooks")
            pointers = shorter.select("node", "root")
            if shorter.where("old <> root").isEmpty():
                break
        rounds.append(pointers)
        ends = _follow(_follow(left, "hi", pointers), "lo", pointers).where("hi <> lo")
        left = save(ends.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
    if not rounds:
        return None
    labels = rounds[0]
    for later in rounds[1:]:
        # Roots of earlier rounds point on; nodes that first move later are their own roots before.
        labels = _follow(labels, "root", later).unionByName(later)
    return save(labels, "components")
