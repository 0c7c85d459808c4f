"""Operators on Spark's model library: classifier comparison, PCA, word vectors, feature dictionaries, active learning."""

from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamix.operators.ordering import numbered
from loamix.plans.shared import Workspace


def vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(rows)


def in_test(key: Column, percent: int, seed: int) -> Column:
    """Whether a row of that key is in the test part, by a hash of key and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(seed))), 1, 8), 16, 10).cast("long") % 100 < percent


def one_hot(rows: DataFrame, work: Workspace) -> DataFrame:
    """(row_id, col, value) of rows (row_id, words map<string,string>, numbers map<string,double>).

    A text is a column ``name=text`` with 1, a number the column ``name``; columns are numbered by name. Nulls have no entry.
    """
    words = rows.select("row_id", F.explode("words").alias("k", "v")).where("v is not null").select("row_id", F.concat_ws("=", "k", "v").alias("name"), F.lit(1.0).alias("value"))
    numbers = rows.select("row_id", F.explode("numbers").alias("name", "value")).where("value is not null")
    entries = words.unionByName(numbers)
    names = numbered(entries.select("name").distinct(), ["name"], work, name="col", label="names")
    return entries.join(names, "name").select("row_id", "col", "value")


def adaboost(train: DataFrame, test: DataFrame, rounds: int = 5, depth: int = 1) -> DataFrame:
    """(label, pred) of ``test`` by shallow trees, each fitted on weights that the errors of those before it raised."""
    weighted, total = train.select("features", "label", F.lit(1.0).alias("weight")), F.lit(0.0)
    scored = test.select("features", "label")
    for k in range(rounds):
        model = DecisionTreeClassifier(maxDepth=depth, weightCol="weight", predictionCol=f"_p{k}", rawPredictionCol="_r", probabilityCol="_q").fit(weighted)
        found = model.transform(weighted).drop("_r", "_q")
        wrong = F.col(f"_p{k}") != F.col("label")
        error = found.agg(F.sum(F.when(wrong, F.col("weight")).otherwise(0.0)) / F.sum("weight")).first()[0] or 0.0
        if error >= 0.5 and k:
            break
        vote = math.log((1 - error + 1e-9) / (error + 1e-9))
        scored = model.transform(scored).drop("_r", "_q")
        total = total + F.when(F.col(f"_p{k}") > 0.5, F.lit(vote)).otherwise(F.lit(-vote))
        if not 0 < error < 0.5:
            break
        weighted = found.select("features", "label", (F.col("weight") * F.when(wrong, F.lit(math.exp(vote))).otherwise(1.0)).alias("weight"))
    return scored.select("label", (total > 0).cast("double").alias("pred"))


def without_summary(model, work: Workspace, name: str):
    """A fitted model, written and read back.

    Some models keep a training summary that holds the session, and travel whole in the functions that predict. A session
    in which a query has observed metrics cannot be serialized.
    """
    model.write().overwrite().save(work.at(name))
    return type(model).load(work.at(name))


def compare_classifiers(train: DataFrame, test: DataFrame, work: Workspace, trees: int = 5, seed: int = 42) -> DataFrame:
    """(model, label, pred) of features and label (0 or 1) by four models."""
    models = {"forest": RandomForestClassifier(numTrees=trees, seed=seed), "boosting": GBTClassifier(maxIter=trees, seed=seed), "svm": LinearSVC(maxIter=50)}
    out = adaboost(train, test, trees).select(F.lit("adaboost").alias("model"), "label", "pred")
    for name, model in models.items():
        out = out.unionByName(without_summary(model.fit(train), work, name).transform(test).select(F.lit(name).alias("model"), "label", F.col("prediction").alias("pred")))
    return out


def pca(rows: DataFrame, k: int = 2) -> DataFrame:
    return PCA(k=k, inputCol="features", outputCol="_pca").fit(rows).transform(rows).withColumn("pca", vector_to_array("_pca")).drop("_pca")


def document_vectors(docs: DataFrame, size: int = 32, seed: int = 42) -> DataFrame:
    """``docs`` (doc_id, words) with the mean of its words' vectors."""
    return Word2Vec(vectorSize=size, minCount=2, seed=seed, inputCol="words", outputCol="_v", maxIter=1).fit(docs).transform(docs).withColumn("vector", vector_to_array("_v")).drop("_v")


def query_uncertain(known: DataFrame, pool: DataFrame, top: int = 100, take: int = 5, extra: int = 1, trees: int = 10, seed: int = 42) -> DataFrame:
    """One active-learning round: (id, guess, doubt) of ``take`` of the ``top`` most doubtful pool rows and ``extra`` of the others, drawn by a seeded hash.

    A boosted model learns ln(max(y, 1)); a forest learns its absolute errors, which rank the pool.
    """
    known = known.withColumn("label", F.log(F.greatest("y", F.lit(1.0))))
    model = GBTRegressor(maxIter=trees, maxDepth=6, seed=seed).fit(known)
    errors = model.transform(known).select("features", F.abs(F.col("label") - F.col("prediction")).alias("label"))
    doubt = RandomForestRegressor(numTrees=trees, seed=seed).fit(errors)
    scored = doubt.transform(model.transform(pool).withColumnRenamed("prediction", "guess")).select("id", F.exp("guess").alias("guess"), F.col("prediction").alias("doubt"))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), "id"))
    most = scored.orderBy(F.desc("doubt"), "id").limit(top)
    asked = most.orderBy(drawn, "id").limit(take)
    others = scored.join(F.broadcast(most.select("id")), "id", "left_anti").orderBy(drawn, "id").limit(extra)  # at most ``top`` rows
    return asked.unionByName(others)


def active_epochs(known: DataFrame, pool: DataFrame, epochs: int, work: Workspace, **options) -> DataFrame:
    """(epoch, id, y) of the rows that each epoch asks for; they are known to the next, and leave the pool."""
    found = None
    for epoch in range(epochs):
        asked = work.save(query_uncertain(known, pool, seed=42 + epoch, **options).select("id"), f"asked-{epoch}")
        few = F.broadcast(asked)  # a handful of rows by its limits
        new = work.save(pool.join(few, "id"), f"new-{epoch}")
        known, pool = known.unionByName(new.select(*known.columns)), pool.join(few, "id", "left_anti")
        rows = new.select(F.lit(epoch).alias("epoch"), "id", "y")
        found = rows if found is None else found.unionByName(rows)
    return found
