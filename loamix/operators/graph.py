"""Link graphs. Iterations are join and aggregate steps; lineage is cut by tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.functions import text as X
from loamix.plans.shared import Workspace, broadcast_if_small


def page_links(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(src, dst) of the pages' links, made absolute; with ``known`` (url) only links to those."""
    origin = F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0)
    links = pages.select(F.col("page_id").alias("src"), F.explode(X.hrefs(F.col("html"))).alias("href"), origin.alias("origin"))
    links = links.select("src", X.absolute(F.col("href"), F.col("origin")).alias("dst")).where("dst is not null")
    return links if known is None else links.join(broadcast_if_small(known.select(F.col("url").alias("dst")).distinct(), 256), "dst", "left_semi").select("src", "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    """(page, rank, links): sources with their targets, comma-joined in order, and the start rank 1/N."""
    nodes = edges.select(F.col("src").alias("x")).unionAll(edges.select("dst")).agg(F.countDistinct("x").alias("n"))
    lists = edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("links"))
    return lists.crossJoin(F.broadcast(nodes)).select(F.col("src").alias("page"), (1 / F.col("n")).alias("rank"), "links")


def pagerank(edges: DataFrame, work: Workspace, steps: int, damping: float = 0.85, dangling: bool = False) -> DataFrame:
    """(id, rank). Repeated edges count. Without ``dangling`` the rank of pages without links is lost, else it is spread."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("leaves")).unionAll(edges.select("dst", F.lit(0)))
    # A node's degree tells whether its rank is lost.
    nodes = work.save(ends.groupBy("id").agg(F.sum("leaves").alias("degree")), "nodes")
    n = nodes.count()
    degrees = nodes.where("degree > 0").select(F.col("id").alias("src"), "degree")
    links = work.save(edges.groupBy("src", "dst").agg(F.count("*").alias("times")).join(degrees, "src").select("src", "dst", (F.col("times") / F.col("degree")).alias("share")), "links")
    ranks = nodes.withColumn("rank", F.lit(1.0) / n)
    base = (1 - damping) / n
    for step in range(steps):
        flow = links.join(ranks, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = 0.0
        if dangling:
            lost = ranks.where("degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = F.coalesce("got", F.lit(0.0)) + lost / n
        new = nodes.join(flow, F.col("id") == F.col("to"), "left").select("id", "degree", (F.lit(damping) * got + base).alias("rank"))
        ranks = work.save(new, f"ranks-{step}")
        if step:
            work.drop(f"ranks-{step - 1}")
    return ranks.select("id", "rank")


def hits(edges: DataFrame, work: Workspace, steps: int) -> DataFrame:
    """(id, hub, authority), both sides from the previous step, without normalisation; nodes without links on a side get 0."""
    nodes = work.save(edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct(), "nodes")
    now = nodes.select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority"))
    for step in range(steps):
        hub = edges.join(now, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("a")).agg(F.sum("authority").alias("h"))
        authority = edges.join(now, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("b")).agg(F.sum("hub").alias("x"))
        new = nodes.join(hub, F.col("id") == F.col("a"), "left").join(authority, F.col("id") == F.col("b"), "left")
        now = work.save(new.select("id", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("x", F.lit(0.0)).alias("authority")), f"hits-{step}")
        if step:
            work.drop(f"hits-{step - 1}")
    return now
