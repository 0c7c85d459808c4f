"""Click logs, sessions and rating histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamix.functions import text as X
from loamix.operators.ordering import numbered
from loamix.plans.shared import Workspace, broadcast_if_small


def top_query_per_host(clicks: DataFrame, least: int = 1, strict: bool = False) -> DataFrame:
    """(host, query, n): the most frequent query of each host, the smallest of equally frequent ones.

    ``strict`` leaves the lexicographically last query of a host out of the comparison; a host with one query then reports it once.
    """
    counts = clicks.select(X.host(F.col("url")).alias("host"), "query").where("host is not null").groupBy("host", "query").agg(F.count("*").alias("n"))
    by_host = Window.partitionBy("host")
    if strict:
        counts = counts.withColumn("last", F.max("query").over(by_host)).withColumn("first", F.min("query").over(by_host))
        real = counts.where("query <> last and n > 1").select("host", "query", "n")
        counts = real.unionByName(counts.select("host", F.col("first").alias("query"), F.lit(1).cast("long").alias("n")).distinct())
    best = counts.withColumn("place", F.row_number().over(by_host.orderBy(F.desc("n"), "query"))).where("place = 1").drop("place")
    return best.where(F.col("n") >= least)


def bad_urls(clicks: DataFrame) -> DataFrame:
    return clicks.agg(F.count_if(X.host(F.col("url")).isNull()).alias("bad"), F.count("*").alias("total"))


def click_blocks(sessions: DataFrame, order: list[str], size: int, work: Workspace, by: list[str] | None = None) -> DataFrame:
    """Per block of ``size`` consecutive sessions: share with a click, with a click at first place, mean clicks; incomplete blocks are dropped.

    ``sessions`` has clicks array<int>. Blocks are numbered inside ``by``, else over all rows.
    """
    by = by or []
    rows = numbered(sessions, order, work, by).withColumn("block", F.floor(F.col("place") / size).cast("long"))
    clicked = F.exists("clicks", lambda c: c > 0)
    total = F.aggregate("clicks", F.lit(0), lambda a, c: a + c)
    first = F.get("clicks", F.lit(0)) > 0
    means = {"ctr": clicked, "first_rate": first, "mean_clicks": total}
    return rows.groupBy(*by, "block").agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(n) for n, c in means.items()]).where(F.col("n") == size)


def with_known_click(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions (session, clicked, ..) that have a click on one of ``known`` (clicked), with only those clicks."""
    return sessions.join(broadcast_if_small(known.select("clicked").distinct(), 64), "clicked", "left_semi")


def collapse_sessions(rows: DataFrame, key: str, order: list[str], same: str, items: dict[str, Column]) -> DataFrame:
    """Merge consecutive rows of a key with an equal ``same``; ``items`` are gathered as sorted sets."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_new", (~F.col(same).eqNullSafe(F.lag(same).over(w))).cast("int"))
    marked = marked.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("_new")))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session", same).agg(F.count("*").alias("n"), *[F.array_sort(F.collect_set(c)).alias(name) for name, c in items.items()])


def history_features(ratings: DataFrame, epoch: str = "1999-11-10") -> DataFrame:
    """Of (uid, mid, rate, date): day offset, the user's previous item and the share 1 / number of the user's items."""
    user = Window.partitionBy("uid")
    out = ratings.withColumn("day", F.datediff("date", F.lit(epoch).cast("date")))
    return out.withColumn("prev", F.lag("mid").over(user.orderBy("day", "mid"))).withColumn("share", F.lit(1.0) / F.count("*").over(user))
