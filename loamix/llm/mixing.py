"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words. Sources get targets by weight, capped at a multiple of their
size. A source's target is met by whole passes over it and, for the rest, by a subset of its documents:
the documents are counted by exact size; each size gives its even share of the budget rounded down; what is
left is fitted by a bounded-knapsack dynamic programme over the sizes and remaining counts; of each size the
documents with the smallest seeded hashes are taken. If that misses the budget, shares are given back, in the end all of
them, so that the sum is the largest there is.

Only counts of sizes meet in one task, one group of rows for each source: no more rows than there are different
sizes. The documents themselves are chosen by comparing hashes: n documents of one size are counted in about sqrt(n) ranges
of the hash, ranges below the cut are taken whole, and only the range with the cut is ranked, so
that a hot source or size is not gathered.

Defined results: a null text has size 0, as an empty one; a document of size 0 takes 0 words. A null
source is a source of its own, ordered last. Repeated rows are documents of their own; of equal ones some are taken, no matter which. A source of size 0
has target 0. An empty table gives no rows. Columns other than id, text and source are not read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamix.plans.shared import Workspace, broadcast_if_small

#: Weights of the sources in order, and how often a document may be taken.
WEIGHTS, REPEATS = (1, 2, 3), 3
#: Words that the largest sizes leave to the first try of the dynamic programme; a try that misses the budget is made again over all of it.
FIRST_TRY = 1 << 16


def sized(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, hash): ``hash`` in 0 .. 2^32 - 1 is of the id and the text."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(text), F.lit(seed)), F.lit(1 << 32))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), drawn.alias("hash"))


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[Fraction]:
    """Exact targets of sources in order: shares of the total by weight, none above ``repeats`` times its size."""
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [Fraction(0)] * len(sizes)
    left, sum_of = sum(sizes), sum(weigh)
    # Sources reach their limit in the order of limit by weight; what remains is shared by those that do not.
    order = sorted(range(len(sizes)), key=lambda i: Fraction(repeats * sizes[i], weigh[i]))
    for k, i in enumerate(order):
        if left * weigh[i] <= repeats * sizes[i] * sum_of:
            for j in order[k:]:
                out[j] = Fraction(left * weigh[j], sum_of)
            break
        out[i] = Fraction(repeats * sizes[i])
        left -= repeats * sizes[i]
        sum_of -= weigh[i]
    return out


def _knapsack(sizes: np.ndarray, room: np.ndarray, left: int) -> np.ndarray:
    """How many of each size, at most ``room``, to take for the largest sum that is not above ``left``."""
    take = np.zeros(len(sizes), np.int64)
    unit = int(np.gcd.reduce(sizes))
    sizes, left = sizes // unit, left // unit
    # For each sum the step that first made it; counts go in as powers of two, each a step.
    first = np.full(left + 1, -1, np.int32)
    first[0] = 0
    steps: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n, part = min(int(room[i]), left // int(sizes[i])), 1
        while n > 0 and first[left] < 0:
            part = min(part, n)
            jump = part * int(sizes[i])
            new = np.flatnonzero((first[jump:] < 0) & (first[: left + 1 - jump] >= 0))
            steps.append((i, part))
            first[new + jump] = len(steps)
            n -= part
            part *= 2
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        i, part = steps[first[at] - 1]
        take[i] += part
        at -= part * int(sizes[i])
    return take


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that the sum of sizes is the largest that is not above ``budget``."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    share = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    # First the largest sizes until little is left: a sum that meets the budget cannot be bettered.
    base, left = share.copy(), budget - int((sizes * share).sum())
    for i in np.argsort(-sizes, kind="stable").tolist():
        more = min(int(counts[i] - base[i]), max(0, left - FIRST_TRY) // int(sizes[i]))
        base[i] += more
        left -= more * int(sizes[i])
    back = 0
    while True:
        take = base + _knapsack(sizes, counts - base, budget - int((sizes * base).sum()))
        if int((sizes * take).sum()) == budget or not base.any():
            return take
        base = np.maximum(share - back, 0)
        back = max(1, 2 * back)


def plan_table(spark: SparkSession, plan: list[tuple]) -> DataFrame:
    """One row for each source. It is made from an Arrow table: one made from Python rows starts workers of another kind in every executor, which stay."""
    kinds = {"source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "passes": pa.int32(), "rest": pa.int64()}
    columns = list(zip(*plan, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(x, k) for x, k in zip(columns, kinds.values(), strict=True)], names=list(kinds)))


def mix(docs: DataFrame, work: Workspace, seed: int = 11, **columns: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``."""
    spark = docs.sparkSession
    own = work.save(sized(docs, seed, **columns), "sizes")
    # One row for each source.
    totals = {r.source: r.total for r in own.groupBy("source").agg(F.sum("size").alias("total")).collect()}
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    plan = []
    for source, target in zip(order, targets([totals[s] for s in order]), strict=True):
        passes = int(target // totals[source]) if totals[source] else 0
        plan.append((source, totals[source], float(target), passes, int(target - passes * totals[source] + Fraction(1, 2))))
    plan = broadcast_if_small(plan_table(spark, plan), 256)
    counts = own.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    counts = counts.join(plan, counts["source"].eqNullSafe(plan["source"])).select(counts["source"], "size", "n", "rest")

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        return pdf.assign(take=fit_counts(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["rest"].iloc[0])))[["source", "size", "n", "take"]]

    takes = work.save(counts.groupBy("source").applyInPandas(chosen, "source string, size long, n long, take long"), "takes")
    key = ["s", "no_source", "size"]
    source_key = [F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_source")]
    # Of each size: nothing, all, or up to a cut among the ranges of the hash.
    sizes = broadcast_if_small(takes.select(*source_key, "size", "n", "take"), 48)
    place = F.floor(F.col("hash") * F.ceil(F.sqrt("n")) / F.lit(float(1 << 32))).cast("long")
    named = own.select("*", *source_key).join(sizes, key, "left").withColumn("range", F.when(F.col("take").between(1, F.col("n") - 1), place))
    named = work.save(named, "named")
    ranges = named.where("range is not null").groupBy(*key, "range", "take").agg(F.count("*").alias("in_range"))
    below = F.sum("in_range").over(Window.partitionBy(*key).orderBy("range")) - F.col("in_range")
    # Room of the range with the cut; ranges before it are taken whole, those after it not at all.
    ranges = ranges.withColumn("room", F.greatest(F.col("take") - below, F.lit(0)))
    ranges = ranges.select(*key, "range", "room", F.when(F.col("room") >= F.col("in_range"), "all").when(F.col("room") > 0, "some").otherwise("none").alias("kind"))
    rows = work.save(named.join(broadcast_if_small(work.save(ranges, "ranges"), 64), [*key, "range"], "left"), "rows")
    rank = F.row_number().over(Window.partitionBy(*key, "range").orderBy("hash", "doc_id"))
    ranked = rows.where("kind = 'some'").withColumn("chosen", rank <= F.col("room"))
    whole = F.coalesce(F.col("kind") == "all", F.col("take") >= F.col("n"), F.lit(False))
    plainly = rows.where("kind is null or kind <> 'some'").withColumn("chosen", whole)
    both = ranked.unionByName(plainly)
    both = both.join(plan.withColumnRenamed("source", "of"), both["source"].eqNullSafe(F.col("of")))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("chosen").cast("int")).otherwise(F.lit(0))
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "op6")).select("doc_id", "size", "source_size", "target", "taken", "source")
