"""Row numbers and running sums over one order of many rows, without gathering them in one task.

Rows are range-partitioned by the order and written once, so that their partitions stay as they are. Each partition is counted or summed;
the totals of earlier partitions, one row for each partition and group, are added to what is counted inside a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamix.plans.shared import Workspace, broadcast_if_small, partitions


def numbered(rows: DataFrame, order: list, work: Workspace, by: list[str] | None = None, name: str = "place", label: str = "numbered") -> DataFrame:
    """``rows`` with their 0-based ``name`` in the order inside each group of ``by``, or over all rows.

    Rows that the order does not tell apart are numbered in any order, but each number comes once.
    """
    by, keep = by or [], rows.columns
    keys = [*by, *order]
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    # The identifier counts the rows of a partition in its lower 33 bits.
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id())
    saved = work.save(ordered.select(*keep, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_at")), label)
    counts = saved.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    starts = work.save(counts.select(*by, "_part", "_from", earlier.alias("_before")), f"{label}-starts")
    starts = starts.select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), "_from", "_before")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    found = saved.join(broadcast_if_small(starts, 64), same)
    return found.select(*keep, (F.col("_at") - F.col("_from") + F.col("_before")).alias(name))


def running(values: DataFrame, by: list[str], order: str, sums: list[str], work: Workspace, label: str = "running") -> DataFrame:
    """(by, order, next, <c>l ..., <c>t ...): the following value of ``order`` in the group, sums up to a row and of the whole group.

    ``order`` differs from row to row of a group; neither it nor the columns of ``by`` are null.
    """
    ordered = values.repartitionByRange(partitions(values.sparkSession), *by, order).withColumn("_part", F.spark_partition_id())
    saved = work.save(ordered, label)
    totals = saved.groupBy(*by, "_part").agg(F.min(order).alias("_first"), *[F.sum(c).alias(f"_{c}") for c in sums])
    group = Window.partitionBy(*by)
    parts = group.orderBy("_part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.lead("_first").over(parts).alias("_next")]
    columns += [F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}b") for c in sums] + [F.sum(f"_{c}").over(group).alias(f"{c}t") for c in sums]
    offsets = broadcast_if_small(work.save(totals.select(*by, "_part", *columns), f"{label}-parts"), 64 + 16 * len(sums))
    inside = Window.partitionBy(*by, "_part").orderBy(order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = saved.select(*by, "_part", order, F.lead(order).over(inside).alias("next"), *[F.sum(c).over(up_to).alias(f"{c}l") for c in sums])
    found = own.join(offsets, [*by, "_part"])
    return found.select(*by, order, F.coalesce("next", "_next").alias("next"), *[(F.col(f"{c}l") + F.col(f"_{c}b")).alias(f"{c}l") for c in sums], *[f"{c}t" for c in sums])
