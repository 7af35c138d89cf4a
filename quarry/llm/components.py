"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set, equal for equal sets."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (the greater ones, or the lesser ones) to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.filter(F.col("v") > F.col("u")) if large else both
    out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root for every node with an edge, from columns u and v of one ordered type.

    root is the least node that can be reached. Each step is linear in the edges:
    minima are summed map-side and joined back, so a hub of any degree is one row
    of the small side of a join. The edges end as stars; the number of rounds is
    logarithmic in the longest chain. Every round is written to the shared folder,
    so lost executors cost one round. Null nodes have no edge. An empty edge set
    gives an empty result.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") > F.col("v")).distinct()
    edges = written(edges, "edges")
    before = _mark(edges)
    for _ in range(rounds):
        edges = written(_star(_star(edges, True), False), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
