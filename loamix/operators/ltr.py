"""Learning to rank over (qid, idx, y, s): metrics, pairwise gradients, boosted trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamix.functions.text import sigmoid
from loamix.operators.trees import Ensemble, grow
from loamix.plans.shared import Workspace

#: What divides the gain at a 0-based position.
DISCOUNTS = {
    "standard": lambda pos: F.log2(pos + 2),
    "shifted": lambda pos: F.log2(pos + 2) + 1,
    "inverted": lambda pos: F.log2(pos + 1) + 1,
}


def _gain(y: str = "y") -> Column:
    return F.pow(F.lit(2.0), F.col(y)) - 1


def prepare(rows: DataFrame) -> DataFrame:
    """Drop queries with one label only, relabel densely from 1, larger labels first."""
    query = Window.partitionBy("qid")
    kept = rows.withColumn("a", F.min("y").over(query)).withColumn("b", F.max("y").over(query)).where("a <> b").drop("a", "b")
    return kept.withColumn("y", F.dense_rank().over(query.orderBy("y")))


def ranked(rows: DataFrame, by: str = "s") -> DataFrame:
    """0-based positions by descending score; of equal scores the larger idx is first."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(by), F.desc("idx"))) - 1)


def dcg(rows: DataFrame, k: int | None = None, by: str = "s", name: str = "dcg", discount: str = "standard") -> DataFrame:
    at = ranked(rows, by)
    at = at if k is None else at.where(F.col("pos") < k)
    return at.groupBy("qid").agg(F.sum(_gain() / DISCOUNTS[discount](F.col("pos"))).alias(name))


def ndcg(rows: DataFrame, k: int | None = None, discount: str = "standard") -> DataFrame:
    """(qid, dcg, idcg, ndcg); ndcg is null where no ideal gain is."""
    found = dcg(rows, k, discount=discount).join(dcg(rows, k, "y", "idcg", discount), "qid")
    return found.select("qid", "dcg", "idcg", F.try_divide("dcg", "idcg").alias("ndcg"))


def ndcg_loss(rows: DataFrame) -> DataFrame:
    """(loss): mean over all queries of their NDCG with inverted-rank discounts; queries without an ideal gain add nothing."""
    return ndcg(rows, discount="inverted").agg(F.avg(F.coalesce("ndcg", F.lit(0.0))).alias("loss"))


def pairs(rows: DataFrame, discount: str = "standard") -> DataFrame:
    """Pairs of a query with y_i > y_j: each has delta, the change of NDCG by swapping them, and rho, the clamped sigmoid of s_j - s_i."""
    at = ranked(rows).join(dcg(rows, None, "y", "idcg", discount), "qid").where("idcg > 0")
    at = at.withColumn("gain", F.pow(F.lit(2.0), "y")).withColumn("discount", 1 / DISCOUNTS[discount](F.col("pos")))
    names = ("idx", "y", "s", "gain", "discount")
    i = at.select("qid", "idcg", *[F.col(c).alias(f"{c}_i") for c in names])
    j = at.select("qid", *[F.col(c).alias(f"{c}_j") for c in names])
    both = i.join(j, (i["qid"] == j["qid"]) & (F.col("y_i") > F.col("y_j"))).drop(j["qid"])
    delta = F.abs((F.col("gain_i") - F.col("gain_j")) * (F.col("discount_i") - F.col("discount_j"))) / F.col("idcg")
    return both.withColumn("delta", delta).withColumn("rho", sigmoid(F.col("s_j") - F.col("s_i")))


def lambdas(rows: DataFrame, discount: str = "standard") -> DataFrame:
    """(qid, idx, lam, w) for rows that are in a pair."""
    p = pairs(rows, discount)
    force, weight = F.col("delta") * F.col("rho"), F.col("delta") * F.col("rho") * (1 - F.col("rho"))
    sides = [F.struct(F.col(f"idx_{x}").alias("idx"), f.alias("l"), weight.alias("w")) for x, f in (("i", force), ("j", -force))]
    each = p.select("qid", F.explode(F.array(*sides)).alias("p"))
    return each.groupBy("qid", "p.idx").agg(F.sum("p.l").alias("lam"), F.sum("p.w").alias("w"))


def gradients(rows: DataFrame) -> DataFrame:
    """(qid, idx, gradient, hessian) of the pair loss with inverted-rank discounts."""
    return lambdas(rows, "inverted").select("qid", "idx", (-F.col("lam")).alias("gradient"), F.col("w").alias("hessian"))


def pair_loss(rows: DataFrame, discount: str = "standard") -> DataFrame:
    """(qid, loss): logistic loss of pairs weighted by delta, linear beyond 20."""
    d = F.col("s_i") - F.col("s_j")
    loss = F.when(d < -20, -d).when(d > 20, 0.0).otherwise(F.log(1 + F.exp(-d)))
    return pairs(rows, discount).groupBy("qid").agg(F.sum(F.col("delta") * loss).alias("loss"))


def lambdamart(rows: DataFrame, work: Workspace, rounds: int, depth: int = 3, rate: float = 1.0, share: float = 1.0, model: Ensemble | None = None, keep: str | None = None, every: int = 10, seed: int = 42) -> tuple[Ensemble, DataFrame]:
    """Boosted trees on lambda gradients with Newton leaves: the model and ``rows`` (qid, idx, y, features) with score s.

    ``share`` of the rows, drawn for each tree by a hash, teach it. ``model`` is gone on with. With ``keep`` the model is saved in that folder
    after every ``every`` trees and at the end; ``Ensemble.load`` reads the last state.
    """
    model = model or Ensemble(0.0, rate)
    now = work.save(rows.withColumn("s", model.predict()), "ltr-0")
    for step in range(rounds):
        part = now
        if share < 1:
            drawn = F.pmod(F.xxhash64("qid", "idx", F.lit(seed + len(model.trees))), F.lit(1 << 20)) < int(share * (1 << 20))
            part = now.where(drawn)
        zero = F.lit(0.0)
        grads = part.join(lambdas(now), ["qid", "idx"], "left").select("qid", "idx", "features", F.coalesce("lam", zero).alias("y"), F.coalesce("w", zero).alias("w"))
        grads = work.save(grads, "gradients")
        tree = grow(grads, work, depth, leaf=F.coalesce(F.try_divide(F.sum("y"), F.sum("w")), zero))
        model.trees.append(tree)
        now = work.save(now.withColumn("s", F.col("s") + F.lit(model.rate) * tree.predict()), f"ltr-{step + 1}")
        work.drop(f"ltr-{step}")
        if keep and (len(model.trees) % every == 0 or step == rounds - 1):
            model.save(rows.sparkSession, keep)
    return model, now
