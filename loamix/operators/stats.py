"""Tests and error measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, counts: dict[str, Column], action: Callable[[DataFrame], object]) -> dict[str, int]:
    """Runs ``action`` on ``df`` and returns aggregates of the rows that passed through it."""
    seen = Observation()
    action(df.observe(seen, *[c.alias(n) for n, c in counts.items()]))
    return seen.get


def t_test(a: DataFrame, b: DataFrame, welch: bool = True) -> DataFrame:
    """(t, rejected) of the columns x. Welch: sample variances, two-sided; else population variances, one-sided. Limit 1.96."""
    var = F.var_samp if welch else F.var_pop
    part = lambda rows, s: rows.agg(F.avg("x").alias(f"m{s}"), var("x").alias(f"v{s}"), F.count("x").alias(f"n{s}"))
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb")))
    t = F.abs(t) if welch else t
    return part(a, "a").crossJoin(part(b, "b")).select(t.alias("t")).withColumn("rejected", (F.col("t") > 1.96).cast("int"))


def bootstrap(arms: DataFrame, resamples: int, size: int, welch: bool = True) -> DataFrame:
    """(b, t): t of each resample with replacement, as ``t_test``. ``arms`` has arm (0 or 1), i (0-based, dense) and x.

    Draw j of resample b takes the index of a linear congruential step of b, j and the arm, so a run can be repeated.
    """
    counts = F.broadcast(arms.groupBy("arm").agg(F.count("*").alias("n")))  # two rows
    draws = arms.sparkSession.range(resamples).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("j"))
    draws = draws.crossJoin(counts).select("b", "arm", (((F.col("b") * 7919 + F.col("j") * 104729 + F.col("arm") * 1299709) * 1103515245 + 12345) % 2147483648 % F.col("n")).alias("i"))
    drawn = draws.join(arms, ["arm", "i"]).groupBy("b", "arm").agg(F.avg("x").alias("m"), (F.var_samp if welch else F.var_pop)("x").alias("v"))
    both = drawn.groupBy("b").agg(*[F.max(F.when(F.col("arm") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in "mv"])
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt((F.col("v0") + F.col("v1")) / size))
    return both.select("b", (F.abs(t) if welch else t).alias("t"))


def rejected_share(resamples: DataFrame, limit: float = 1.96) -> DataFrame:
    """(share, n): the share of resamples (b, t) whose t is above the limit; a t that is null, without any spread, is not."""
    return resamples.agg(F.avg(F.coalesce((F.col("t") > limit).cast("double"), F.lit(0.0))).alias("share"), F.count("*").alias("n"))


def class_report(rows: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) of columns label and pred, with the mean and the weighted mean."""
    each = rows.select(F.explode(F.array_distinct(F.array("label", "pred"))).alias("class"), "label", "pred")
    hit, said, real = (F.col("label") == F.col("class")) & (F.col("pred") == F.col("class")), F.col("pred") == F.col("class"), F.col("label") == F.col("class")
    c = each.groupBy("class").agg(F.count_if(hit).alias("tp"), F.count_if(said).alias("said"), F.count_if(real).alias("support"))
    c = c.select(F.col("class").cast("string").alias("class"), F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"), "support")
    c = c.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    names = ("precision", "recall", "f1")
    macro = c.agg(F.lit("macro").alias("class"), *[F.avg(x).alias(x) for x in names], F.sum("support").alias("support"))
    weighted = c.agg(F.lit("weighted").alias("class"), *[F.try_divide(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(x) for x in names], F.sum("support").alias("support"))
    return c.select("class", *names, "support").unionByName(macro).unionByName(weighted)


def error_norms(rows: DataFrame) -> DataFrame:
    d = F.col("y") - F.col("pred")
    return rows.agg(F.sum(F.abs(d)).alias("l1"), F.sqrt(F.sum(d * d)).alias("l2"))
