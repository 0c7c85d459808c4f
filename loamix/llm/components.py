"""Connected components of an edge table by alternating star contractions.

Each round rewrites the edges twice (Kiveris et al., "Connected Components in MapReduce and Beyond"): the
large-star step hangs a node's larger neighbours on its smallest neighbour, the small-star step hangs a
node and its smaller neighbours on the smallest of them. Every rewrite is one aggregation, combined before the shuffle, and one
equi-join, so that a hub with a third of all edges is split by adaptive execution instead of gathered. The rounds end
when the edges are stars. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.plans.shared import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _not_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return bool(seen.where("out > 1 or (out > 0 and into > 0)").limit(1).count())


def components(edges: DataFrame, work: Workspace, label: str = "cc") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` has columns u and v of one orderable type; repeated edges and loops are allowed, nulls are
    not. No edges give no rows.
    """
    kind = edges.schema["u"].dataType
    now = work.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{label}-0")
    step = 0
    while _not_stars(now):
        step += 1
        half = work.save(_large_star(now), f"{label}-{step}a")
        now = work.save(_small_star(half), f"{label}-{step}")
        work.drop(f"{label}-{step}a")
        work.drop(f"{label}-{step - 1}")
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionAll(roots).select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("root"))
