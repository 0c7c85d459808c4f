"""Exact split search and boosted regression trees, level by level: all nodes of a level are split in one pass.

Rows are (row_id, features array<double>, y). Equal feature values are summed before the running sums.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamix.operators.ordering import running
from loamix.plans.shared import Workspace


@dataclass
class Tree:
    """Nodes in heap order: ``splits`` node -> (feature, threshold), ``leaves`` node -> value."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def node(self, node: int = 0):
        """Leaf of a row, as a column of its ``features``."""
        if node not in self.splits:
            return F.lit(node)
        feature, threshold = self.splits[node]
        return F.when(F.col("features")[feature] <= threshold, self.node(2 * node + 1)).otherwise(self.node(2 * node + 2))

    def predict(self, node: int = 0):
        if node not in self.splits:
            return F.lit(float(self.leaves[node]))
        feature, threshold = self.splits[node]
        return F.when(F.col("features")[feature] <= threshold, self.predict(2 * node + 1)).otherwise(self.predict(2 * node + 2))


def best_splits(rows: DataFrame, work: Workspace, penalty: float | None = None, gamma: float = 0.0) -> DataFrame:
    """(node, feature, threshold, error, total) of the best split of each node.

    Without ``penalty`` the error is the squared error of both sides; with it the error is minus the second-order gain
    of gradients y with unit curvature. Running sums are cut into ranges of values, so a continuous feature of many rows is not one task.
    """
    values = rows.select("node", "y", F.posexplode("features").alias("feature", "x")).where("x is not null").groupBy("node", "feature", "x")
    values = values.agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    w = running(values, ["node", "feature"], "x", ["n", "s", "q"], work, "values").where("next is not null")
    nl, sl, ql, nt, st, qt = (F.col(c) for c in ("nl", "sl", "ql", "nt", "st", "qt"))
    if penalty is None:
        error = ql - sl * sl / nl + (qt - ql) - (st - sl) * (st - sl) / (nt - nl)
    else:
        error = -(sl * sl / (nl + penalty) + (st - sl) * (st - sl) / (nt - nl + penalty) - st * st / (nt + penalty) - gamma)
    ranked = w.select("node", "feature", ((F.col("x") + F.col("next")) / 2).alias("threshold"), error.alias("error"), (qt - st * st / nt).alias("total"))
    best = ranked.groupBy("node").agg(F.min(F.struct(F.round("error", 9).alias("error"), "feature", "threshold", "total")).alias("b"))
    return best.select("node", "b.feature", "b.threshold", "b.error", "b.total")


def grow(rows: DataFrame, work: Workspace, max_depth: int, penalty: float | None = None, gamma: float = 0.0, min_samples: int = 1, leaf=None) -> Tree:
    """A tree of at most 2^max_depth leaves; only the nodes' splits and values reach the driver.

    Without ``penalty`` a node is split if that lowers its squared error. With it every best split is made, and afterwards, from the bottom up,
    those of two leaves whose gain is negative are taken back: a weak split stays if a strong one is below it.
    """
    tree, gains = Tree(), {}
    for _ in range(max_depth):
        open_ = rows.withColumn("node", tree.node())
        sizes = open_.groupBy("node").agg(F.count("*").alias("n"))
        found = best_splits(open_, work, penalty, gamma).join(sizes, "node").where(F.col("n") > min_samples).collect()
        new = {r.node: (r.feature, r.threshold) for r in found if penalty is not None or r.error < r.total - 1e-12}
        gains |= {r.node: -r.error for r in found}
        if not new.keys() - tree.splits.keys():
            break
        tree.splits |= new
    if penalty is not None:
        for node in sorted(tree.splits, reverse=True):
            if gains[node] < 0 and not tree.splits.keys() & {2 * node + 1, 2 * node + 2}:
                del tree.splits[node]
    value = leaf if leaf is not None else F.avg("y") if penalty is None else -F.sum("y") / (F.count("*") + penalty)
    tree.leaves = {r.node: r.value for r in rows.withColumn("node", tree.node()).groupBy("node").agg(value.alias("value")).collect()}
    return tree


@dataclass
class Ensemble:
    """A start value and trees that are added with one rate."""

    start: float = 0.0
    rate: float = 1.0
    trees: list[Tree] = field(default_factory=list)

    def predict(self, limit: int | None = None):
        """Score of a row, as a column of its ``features``, by the first ``limit`` trees."""
        out = F.lit(float(self.start))
        for tree in self.trees[:limit]:
            out = out + F.lit(float(self.rate)) * tree.predict()
        return out

    def staged(self, rows: DataFrame) -> DataFrame:
        """Each row once for each number of trees, with that number as ``stage`` and the ``score`` so far."""
        parts = [F.lit(float(self.start)), *[F.lit(float(self.rate)) * t.predict() for t in self.trees]]
        sums = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.aggregate(F.slice("_parts", F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
        return rows.withColumn("_parts", F.array(*parts)).select(*rows.columns, F.posexplode(sums).alias("stage", "score"))

    def save(self, spark: SparkSession, path: str) -> None:
        """As one JSON file; an earlier one is replaced only after the new one is whole."""
        text = json.dumps({"start": self.start, "rate": self.rate, "trees": [{"splits": list(t.splits.items()), "leaves": list(t.leaves.items())} for t in self.trees]})
        spark.createDataFrame([(len(self.trees), text)], "trees int, model string").coalesce(1).write.mode("append").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        """The last state saved under ``path``."""
        own = json.loads(spark.read.schema("trees int, model string").json(path).orderBy(F.desc("trees")).first().model)
        trees = [Tree({n: tuple(s) for n, s in t["splits"]}, dict(map(tuple, t["leaves"]))) for t in own["trees"]]
        return cls(own["start"], own["rate"], trees)


def _boost(rows: DataFrame, work: Workspace, rounds: int, depth: int, rate: float, start, gradient, leaf, penalty, gamma) -> tuple[Ensemble, DataFrame]:
    model = Ensemble(float(rows.agg(start).first()[0]), rate)
    now = work.save(rows.withColumn("score", F.lit(model.start)), "score-0")
    for step in range(rounds):
        target = now.withColumn("label", F.col("y")).withColumn("y", gradient)
        tree = grow(target, work, depth, penalty, gamma, leaf=leaf)
        model.trees.append(tree)
        now = work.save(now.withColumn("score", F.col("score") + rate * tree.predict()), f"score-{step + 1}")
        work.drop(f"score-{step}")
    return model, now


def boost_lad(rows: DataFrame, work: Workspace, rounds: int = 10, depth: int = 3, rate: float = 0.1) -> tuple[Ensemble, DataFrame]:
    """Absolute loss: trees on the sign of residuals with median leaves. Returns the model and the scored rows."""
    residual = F.col("y") - F.col("score")
    return _boost(rows, work, rounds, depth, rate, F.median("y"), F.signum(residual), F.median(F.col("label") - F.col("score")), None, 0.0)


def boost_second_order(rows: DataFrame, work: Workspace, rounds: int = 10, depth: int = 5, rate: float = 0.1, penalty: float = 0.1, gamma: float = 0.1) -> tuple[Ensemble, DataFrame]:
    """Squared loss with second-order gains and leaves -G/(H + penalty). Returns the model and the scored rows."""
    return _boost(rows, work, rounds, depth, rate, F.avg("y"), F.col("score") - F.col("y"), None, penalty, gamma)
