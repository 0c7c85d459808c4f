"""Ranked retrieval over term indexes. Scores are long tables (qid, doc_id, score); ties go to the smaller doc_id.

An index is written once (``terms.TermIndex``). The query terms, with their weights, are few and are broadcast after they are counted, so that the
term table is read once and only the matching entries are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamix.operators.terms import FieldIndex, TermIndex
from loamix.plans.shared import Workspace, broadcast_if_small, partitions

#: Bytes of a row of query terms, and of document lengths, as counted for a broadcast.
TERM_BYTES, LENGTH_BYTES = 64, 24


def top_k(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _hits(tf: DataFrame, terms: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Entries of the term table for query terms (qid, term, ..)."""
    found = tf.join(broadcast_if_small(terms, TERM_BYTES), "term")
    return found if candidates is None else found.join(broadcast_if_small(candidates, LENGTH_BYTES), ["qid", "doc_id"], "left_semi")


def raw_idf(n: float) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def bm25(index: TermIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75, floor: str | float = "mean", candidates: DataFrame | None = None) -> DataFrame:
    """Okapi BM25 over distinct query terms; ``floor``: a quarter of the mean idf, or a number, in place of negative idf."""
    return bm25_many(index, queries, {"score": (k1, b, floor)}, candidates)


def bm25_many(index: TermIndex, queries: DataFrame, variants: dict[str, tuple[float, float, str | float]], candidates: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, <name> ..): several BM25 scores (k1, b, floor) from one pass over the hits."""
    wanted = queries.select("qid", "term").distinct()
    mean = 0.0
    if any(floor == "mean" for _, _, floor in variants.values()):
        mean = 0.25 * (index.df.agg(F.avg(raw_idf(index.n))).first()[0] or 0.0)
    raw = wanted.join(index.df.select("term", raw_idf(index.n).alias("raw")), "term")
    hits = _hits(index.tf, raw, candidates).join(broadcast_if_small(index.lengths, LENGTH_BYTES), "doc_id")
    scores = []
    for name, (k1, b, floor) in variants.items():
        idf = F.when(F.col("raw") < 0, F.lit(mean if floor == "mean" else float(floor))).otherwise(F.col("raw"))
        norm = F.col("f") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl))
        scores.append(F.sum(idf * F.col("f") * (k1 + 1) / norm).alias(name))
    return hits.groupBy("qid", "doc_id").agg(*scores)


def bm25_feedback(index: TermIndex, queries: DataFrame, k1: float = 1.2, k2: float = 100.0, b: float = 0.75, relevant: float = 0.0, matched: DataFrame | None = None) -> DataFrame:
    """BM25 with the relevance weight of Robertson and Sparck Jones and query term frequency.

    ``relevant`` counts the documents known to be relevant; ``matched`` (term, r) tells how many of these have a term.
    """
    terms = queries.groupBy("qid", "term").agg(F.count("*").alias("qf")).join(index.df, "term")
    terms = terms.withColumn("r", F.lit(0.0)) if matched is None else terms.join(matched, "term", "left").withColumn("r", F.coalesce(F.col("r").cast("double"), F.lit(0.0)))
    hits = _hits(index.tf, terms).join(broadcast_if_small(index.lengths, LENGTH_BYTES), "doc_id")
    df_, f, qf, r = F.col("df"), F.col("f"), F.col("qf"), F.col("r")
    weight = F.log(((r + 0.5) / (relevant - r + 0.5)) / ((df_ - r + 0.5) / (index.n - df_ - relevant + r + 0.5)))
    length = k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl))
    return hits.groupBy("qid", "doc_id").agg(F.sum(weight * (k1 + 1) * f / (length + f) * (k2 + 1) * qf / (k2 + qf)).alias("score"))


def multifield(index: FieldIndex, weights: dict[str, float], queries: DataFrame, how: str = "bm25", k1: float = 1.2, b: float = 0.75, candidates: DataFrame | None = None) -> DataFrame:
    """Fields with weights that share the document frequency of their union; terms in over half of the documents are left out."""
    idf = index.df.where(F.col("df") <= index.n / 2).select("term", raw_idf(index.n).alias("idf"))
    hits = _hits(index.tf, queries.select("qid", "term").distinct().join(idf, "term"), candidates)
    hits = hits.join(broadcast_if_small(index.lengths, 16 + 8 * len(index.names)), "doc_id")
    total = F.lit(0.0)
    for name, weight in weights.items():
        f, dl = F.col(f"f_{name}"), F.col(f"dl_{name}")
        part = f * (k1 + 1) / (f + k1 * (1 - b + b * dl / F.lit(index.avgdl[name]))) if how == "bm25" else f / dl
        total = total + F.when(f > 0, F.col("idf") * weight * part).otherwise(0.0)
    return hits.groupBy("qid", "doc_id").agg(F.sum(total).alias("score"))


def term_weight(index: TermIndex, weight: str) -> Column:
    """Of df and cf: log2(N/df), smooth ln((1+N)/(1+df))+1, rare ln(1+N/cf), or inverted ln(1+df/N)."""
    n = F.lit(index.n)
    return {
        "log2": F.log2(n / F.col("df")),
        "smooth": F.log((1 + n) / (1 + F.col("df"))) + 1,
        "rare": F.log(1 + n / F.col("cf")),
        "inverted": F.log(1 + F.col("df") / n),
    }[weight]


def tfidf(index: TermIndex, queries: DataFrame, local: str = "raw", weight: str = "log2", normalise: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """Sum of document term weights, of documents of length one if ``normalise``; ``weight`` as in ``term_weight``."""
    own = F.col("f") if local == "raw" else 1 + F.log("f")
    idf = index.df.select("term", term_weight(index, weight).alias("idf"))
    scores = _hits(index.tf, queries.select("qid", "term").distinct().join(idf, "term"), candidates)
    scores = scores.groupBy("qid", "doc_id").agg(F.sum(own * F.col("idf")).alias("score"))
    if not normalise:
        return scores
    w = own * F.col("idf")
    norms = index.tf.join(idf, "term").groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    return scores.join(norms, "doc_id").select("qid", "doc_id", F.try_divide("score", "norm").alias("score"))


def tfidf_candidates(docs: DataFrame, weights: dict[str, float], queries: DataFrame, candidates: DataFrame, work: Workspace, boosts: DataFrame | None = None) -> DataFrame:
    """TF-IDF of several fields in which each query's candidates are a corpus of their own.

    ``docs`` (doc_id, term, f_<name> ..), ``candidates`` (qid, doc_id). Of each field, document vectors f * log2(N/df) have length one, N and df counted
    over the query's candidates with the field; a document's score is the weighted sum over the query's terms. ``boosts`` (qid, doc_id, boost) are added.
    """
    own = work.save(docs.join(candidates, "doc_id"), "candidate_terms")
    wanted = broadcast_if_small(queries.select("qid", "term").distinct().withColumn("wanted", F.lit(True)), TERM_BYTES)
    out = None
    for name, weight in weights.items():
        field = own.where(F.col(f"f_{name}") > 0).select("qid", "doc_id", "term", F.col(f"f_{name}").alias("f"))
        n = field.groupBy("qid").agg(F.countDistinct("doc_id").alias("n"))
        df = field.groupBy("qid", "term").agg(F.count("*").alias("df"))
        w = field.join(df, ["qid", "term"]).join(n, "qid").withColumn("w", F.col("f") * F.log2(F.col("n") / F.col("df")))
        w = w.join(wanted, ["qid", "term"], "left").groupBy("qid", "doc_id")
        part = w.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.when(F.col("wanted"), F.col("w"))).alias("s")).where("s is not null")
        part = part.select("qid", "doc_id", (weight * F.coalesce(F.try_divide("s", "norm"), F.lit(0.0))).alias("part"))
        out = part if out is None else out.unionByName(part)
    if boosts is not None:
        out = out.unionByName(boosts.select("qid", "doc_id", F.col("boost").alias("part")))
    return out.groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))


def cosine_bags(index: TermIndex, query_tf: DataFrame) -> DataFrame:
    """Cosine of raw term counts."""
    norm = lambda x, key, name: x.groupBy(key).agg(F.sqrt(F.sum(F.col("f") * F.col("f"))).alias(name))
    dots = _hits(index.tf, query_tf.withColumnRenamed("f", "qf")).groupBy("qid", "doc_id").agg(F.sum(F.col("f") * F.col("qf")).alias("dot"))
    dots = dots.join(norm(index.tf, "doc_id", "dn"), "doc_id").join(broadcast_if_small(norm(query_tf, "qid", "qn"), LENGTH_BYTES), "qid")
    return dots.select("qid", "doc_id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score"))


def tfidf_cosine(index: TermIndex, query_tf: DataFrame, weight: str = "log2") -> DataFrame:
    """Cosine of queries and documents, both weighted by the documents' idf; query terms that no document has do not count."""
    idf = index.df.select("term", term_weight(index, weight).alias("idf"))
    terms = query_tf.join(idf, "term").select("qid", "term", (F.col("f") * F.col("idf")).alias("qw"), "idf")
    dots = _hits(index.tf, terms).groupBy("qid", "doc_id").agg(F.sum(F.col("f") * F.col("idf") * F.col("qw")).alias("dot"))
    w = F.col("f") * F.col("idf")
    doc_norms = index.tf.join(idf, "term").groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("dn"))
    query_norms = terms.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    both = dots.join(doc_norms, "doc_id").join(broadcast_if_small(query_norms, LENGTH_BYTES), "qid")
    return both.select("qid", "doc_id", F.try_divide(F.col("dot"), F.col("dn") * F.col("qn")).alias("score"))


def ensemble(scores: list[tuple[DataFrame, float]], normalise: bool = True) -> DataFrame:
    """Weighted sum of scores, each divided by its largest if ``normalise``."""
    out = None
    for part, weight in scores:
        part = part.select("qid", "doc_id", "score")
        if normalise:
            part = part.crossJoin(F.broadcast(part.agg(F.max("score").alias("most"))))  # one row
            part = part.withColumn("score", F.col("score") / F.col("most"))
        part = part.select("qid", "doc_id", (F.col("score") * weight).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))


def top_up(ranked: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Fill each query up to k documents with candidates that are not ranked, in the order of a hash."""
    more = candidates.join(ranked, ["qid", "doc_id"], "left_anti").withColumn("h", F.md5(F.concat_ws(":", "qid", "doc_id")))
    both = ranked.select("qid", "doc_id", F.lit(0).alias("late"), F.lpad(F.col("rank").cast("string"), 10, "0").alias("h")).unionByName(more.select("qid", "doc_id", F.lit(1).alias("late"), "h"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("late", "h", "doc_id"))).where(F.col("rank") <= k).select("qid", "doc_id", "rank")


def last_query(pairs: DataFrame) -> DataFrame:
    """(doc_id, qid) of (doc_id, qid, place): of several queries of a document the last holds."""
    return pairs.groupBy("doc_id").agg(F.max_by("qid", F.struct("place", "qid")).alias("qid"))


#: Vectors and queries that one task compares.
KNN_BLOCK = 4096


def knn(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """The k nearest vectors (vec_id, ``vector``) of each query (qid, q) by cosine, itself excepted.

    Vectors and queries are cut into blocks and every two blocks meet in a task, which keeps k of a query's rows; neither side is broadcast.
    Vectors that are null, zero or of another length than the query's are near to nothing.
    """
    spark = vectors.sparkSession
    rows = vectors.where(f"{vector} is not null").select(F.col("vec_id").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where("q is not null").select(F.col("qid").alias("id"), F.col("q").cast("array<double>").alias("v"))
    blocks = [max(1, -(-x.count() // KNN_BLOCK)) for x in (rows, asked)]
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = rows.select("id", "v", own(blocks[0]).alias("a"), every(blocks[1]).alias("b"), F.lit(False).alias("asks"))
    both = both.unionByName(asked.select("id", "v", every(blocks[0]).alias("a"), own(blocks[1]).alias("b"), F.lit(True).alias("asks")))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        pdf = pdf.assign(dim=[len(x) for x in pdf["v"]])
        for _, part in pdf.groupby("dim"):
            parts.append(_nearest_of(part[part["asks"]], part[~part["asks"]], k))
        return pd.concat(parts) if parts else pd.DataFrame({"qid": [], "doc_id": [], "score": []})

    kind = f"qid {asked.schema['id'].dataType.simpleString()}, doc_id {rows.schema['id'].dataType.simpleString()}, score double"
    found = both.repartition(partitions(spark), "a", "b").groupBy("a", "b").applyInPandas(nearest, kind)
    return top_k(found, k)


def _nearest_of(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out = {"qid": [], "doc_id": [], "score": []}
    if not len(queries) or not len(rows):
        return pd.DataFrame(out)
    with np.errstate(all="ignore"):
        q, x = (np.stack(p["v"].to_numpy()) for p in (queries, rows))
        q, x = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, x))
    ids = rows["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    for i, own in enumerate(queries["id"]):
        score = np.round(x @ q[i], 6)
        good = np.isfinite(score) & (ids != own)
        # Stable on ascending ids: of equal scores the smaller id is first.
        best = order[np.argsort(-np.where(good, score, -np.inf)[order], kind="stable")][:k]
        best = best[good[best]]
        out["qid"] += [own] * len(best)
        out["doc_id"] += ids[best].tolist()
        out["score"] += score[best].tolist()
    return pd.DataFrame(out)

