"""Connected components of a graph given as edges, by contraction.

Each round every vertex points to its smallest neighbour (or itself), pointers are
followed to their ends, and the edges are rewritten between those ends; edges inside one end
vanish.  The number of edges left at least halves in the usual case, and every table is
written to the shared folder, so a lost executor costs no more than a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def follow(parents: DataFrame) -> DataFrame:
    """(v, root) from (v, parent), where parents are smaller or equal and roots point to themselves."""
    now = materialize(parents.withColumnRenamed("parent", "root"), "cc-parents")
    while True:
        up = now.toDF("root", "next")
        new = materialize(now.join(up, "root").select("v", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")),
                          "cc-jump")
        now = new.select("v", "root")
        if not new.filter("moved").head(1):
            return now


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reachable from each vertex of the edges (a, b)."""
    left = materialize(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    found = None
    while left.head(1):
        both = left.union(left.select("b", "a")).toDF("v", "u")
        roots = follow(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("parent")))
        if found is None:
            found = roots.withColumnRenamed("root", "component")
        else:
            step = roots.withColumnsRenamed({"v": "component", "root": "next"})
            found = materialize(found.join(step, "component", "left").select(
                "v", F.coalesce("next", "component").alias("component")), "cc-found")
        ends = roots.withColumnRenamed("root", "r")
        left = materialize(left.join(ends.withColumnsRenamed({"v": "a", "r": "ra"}), "a").join(
            ends.withColumnsRenamed({"v": "b", "r": "rb"}), "b").filter("ra != rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
    if found is None:
        return edges.select(F.col("a").alias("v"), F.col("a").alias("component")).limit(0)
    return found
