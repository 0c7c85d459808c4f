"""Toxic passages by maximum-scoring segments of token log-odds.

Training: words and their prefixes are counted by class, once for each different pair of preceding words, so that
copies of a document count once. A unit's share of toxic contexts has a Dirichlet prior around that of the
next shorter prefix, and the shortest around the share of all contexts; rare words so lean on their stem. A word's
log-odds less a constant, which makes clean text drift down, is its score. The calibration sees each training document
with its own contribution taken out. Scoring: one linear scan (Ruzzo and Tompa's algorithm) finds all maximal-scoring
segments of a text. For clean text the best of n tokens follows an extreme-value law
(Karlin and Altschul): lambda solves E[exp(lambda s)] = 1, K is fitted by maximum likelihood. A segment is
significant if its expectation K n exp(-lambda s) is small; the calibrated segment statistics of a document enter a logistic
curve fitted on the training rows.

The model is fitted on at most ``max_rows`` labelled rows (least hash of the id first), which bounds its words; a word or prefix with fewer than
``min_contexts`` contexts says nothing beyond its prefix. Everything is scored, whole texts included.

Defined results: null and empty texts have no words and get the curve's value for no segment. Repeated
rows each get a row. Rows with a null id or label teach nothing; of several labels of an id the greatest holds. If no rows or only one class
can be learned from, all scores are that class's smoothed frequency. Columns other than the id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamix.llm.memory import enter
from loamix.plans.shared import Workspace

PYTHON_WORD = re.compile(r"[^\W_]+")
#: Taken off every token's score, and the expectation below which a segment is significant.
DRIFT, SIGNIFICANT = 0.05, 0.05


@dataclass
class Model:
    """counts: contexts of each unit (clean, toxic); share: of toxic contexts among all; rate, size: of the extreme-value law; odds: scores of units."""

    counts: dict[str, tuple[float, float]] = field(default_factory=dict)
    share: float = 0.5
    prior: float = 10.0
    rate: float = 1.0
    size: float = 1.0
    weights: np.ndarray | None = None
    base: float = 0.5
    odds: dict[str, float] | None = None

    def word(self, word: str, without: int | None = None) -> float:
        """Score of a word; ``without``: the class of which one context is left out."""
        p = self.share
        for unit in units(word):
            if unit in self.counts:
                clean, toxic = self.counts[unit]
                clean, toxic = clean - (without == 0), toxic - (without == 1)
                p = (max(toxic, 0) + self.prior * p) / (max(clean, 0) + max(toxic, 0) + self.prior)
        return math.log(p / (1 - p)) - math.log(self.share / (1 - self.share)) - DRIFT

    def compact(self) -> Model:
        """The same scores from one number for each unit, without the counts."""
        odds = {u: self.word(u) if not u.endswith("*") else self.word(u[:-1] + "**") for u in self.counts}
        return replace(self, counts={}, odds=odds)

    def scores(self, text: str | None, without: int | None = None) -> np.ndarray:
        words = PYTHON_WORD.findall((text or "").lower())
        if self.odds is None:
            known = {w: self.word(w, without) for w in set(words)}
            return np.fromiter(map(known.__getitem__, words), float, len(words))
        odds = self.odds
        # The word itself, else its longest known prefix.
        return np.fromiter([x if (x := odds.get(w)) is not None else self._prefix(w) for w in words], float, len(words))

    def _prefix(self, word: str) -> float:
        for k in range(min(7, len(word) - 1), 4, -1):
            if (x := self.odds.get(word[:k] + "*")) is not None:
                return x
        return -DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score) in one pass."""
    positive = np.nonzero(scores > 0)[0]
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # Neighbouring positive tokens start as one candidate: joining them always raises the score.
    breaks = np.nonzero(np.diff(positive) > 1)[0]
    starts, ends = positive[np.concatenate([[0], breaks + 1])], positive[np.concatenate([breaks, [len(positive) - 1]])] + 1
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, left sum, right sum, index of the last candidate with a smaller left sum
    for first, end in zip(starts.tolist(), ends.tolist(), strict=True):
        left, right = total[first], total[end]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((first, end, left, right, j))
                break
            first, left = kept[j][0], kept[j][2]
            below = kept[j][4]
            del kept[j:]
            j = below
    return [(a, b, float(r - s)) for a, b, s, r, _ in kept]


def _statistics(found: list[float], n: int, model: Model) -> tuple[float, float, float]:
    """Best calibrated score of the segments, sum over the significant ones, and their number's logarithm."""
    offset = math.log(model.size * max(1, n))
    bits = [model.rate * s - offset for s in found]
    significant = [b for b in bits if b > -math.log(SIGNIFICANT)]
    return min(max(bits, default=-offset), 40.0), min(sum(significant), 120.0), math.log1p(len(significant))


def features(scores: np.ndarray, model: Model) -> tuple[float, float, float]:
    return _statistics([s for _, _, s in segments(scores)], len(scores), model)


def passages(text: str | None, model: Model) -> list[tuple[int, int, float]]:
    """Significant passages as (first character, end, expectation), left to right."""
    spans = [m.span() for m in PYTHON_WORD.finditer((text or "").lower())]
    scores = model.scores(text)
    offset = math.log(model.size * max(1, len(scores)))
    return [(spans[a][0], spans[b - 1][1], math.exp(offset - model.rate * s)) for a, b, s in segments(scores) if offset - model.rate * s < math.log(SIGNIFICANT)]


def _karlin(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of E[exp(rate s)] = 1."""
    weight = weight / weight.sum()
    if (scores <= 0).all():
        return 1.0
    low, high = 1e-6, 1e-6
    value = lambda x: float((weight * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while value(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 8_000, min_contexts: int = 3, prior: float = 10.0) -> Model:
    """Fit on the rows of ``labels``; the caller leaves out those to be held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    train = work.save(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").select("text", "label"), "train")
    n, toxic = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    model = Model(base=(toxic + 1) / (n + 2))
    if not 0 < toxic < n:
        return model
    counts = _units(train).groupBy("unit", "context").agg(F.min("label").alias("least"), F.max("label").alias("most")).groupBy("unit").agg(F.sum(1 - F.col("least")).alias("clean"), F.sum("most").alias("toxic"))
    counts = work.save(counts, "counts")
    clean, bad = (float(x or 0) for x in counts.where("not endswith(unit, '*')").agg(F.sum("clean"), F.sum("toxic")).first())
    top = counts.where(F.col("clean") + F.col("toxic") >= min_contexts).toPandas()
    model.share = (bad + 1) / (clean + bad + 2)
    model.counts = dict(zip(top["unit"], zip(top["clean"].tolist(), top["toxic"].tolist(), strict=True), strict=True))
    model.prior = prior
    found = _measured(train, model).toPandas()
    # Token scores of clean documents give the rate, their best segments the size.
    drawn = np.concatenate([np.asarray(x, float) for x in found.loc[found["label"] == 0, "sample"]] or [np.zeros(0)])
    if len(drawn):
        model.rate = _karlin(drawn, np.ones(len(drawn)))
    calm = found[(found["label"] == 0) & (found["n"] > 0)]
    if len(calm):
        model.size = float(1 / np.clip((calm["n"] * np.exp(-model.rate * calm["top"])).mean(), 1e-6, 1e6))
    x = np.array([_statistics(list(row.found), row.n, model) for row in found.itertuples()])
    model.weights = _logistic(x, found["label"].to_numpy(float))
    return model


def units(word: str) -> list[str]:
    """Prefixes, shortest first, and then the word."""
    return [word[:k] + "*" for k in range(5, min(8, len(word)))] + [word]


def _units(train: DataFrame) -> DataFrame:
    """(label, unit, context) for the first occurrence of each unit in each document."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("toxicity")
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                out = set()
                for text, label in zip(pdf["text"].iloc[start : start + 64], pdf["label"].iloc[start : start + 64], strict=True):
                    words = ["", "", *PYTHON_WORD.findall((text or "").lower())]
                    first: dict[str, int] = {}
                    for i in range(2, len(words)):
                        for unit in units(words[i]):
                            first.setdefault(unit, i)
                    out.update((label, unit, zlib.crc32(f"{words[i - 2]} {words[i - 1]}".encode())) for unit, i in first.items())
                yield pd.DataFrame(sorted(out), columns=["label", "unit", "context"])

    return train.mapInPandas(listed, "label int, unit string, context long")


def _measured(train: DataFrame, model: Model) -> DataFrame:
    """(label, n, top, found, sample): the segments' scores of each training document, without what itself adds to the counts."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            out = []
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                scores = model.scores(text, int(label))
                found = [s for _, _, s in segments(scores)]
                out.append((label, len(scores), max(found, default=0.0), found, scores[:: max(1, len(scores) // 50)].tolist()))
            yield pd.DataFrame(out, columns=["label", "n", "top", "found", "sample"])

    return train.mapInPandas(measured, "label int, n long, top double, found array<double>, sample array<double>")


def probability(text: str | None, model: Model) -> float:
    if model.weights is None:
        return model.base
    z = model.weights[0] + float(np.dot(model.weights[1:], features(model.scores(text), model)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``."""
    source = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model.compact())

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("toxicity")
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "score": [probability(x, shared.value) for x in pdf["text"]]})

    return source.mapInPandas(scored, T.StructType([source.schema[id_col], T.StructField("score", T.DoubleType())]))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``limit``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model.compact()), docs.columns.index(text_col)

    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch in batches:
            found = batch.filter(pa.array([probability(x.as_py(), shared.value) < limit for x in batch.column(at)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, names=names)

    # Plain names on the way in: columns are looked up by name, which may hold dots.
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(kept, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows of the fourth of the ids that teaches nothing; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return fit(docs, labels, work)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fitted(spark, docs, sf_dir, Workspace(spark, "op5")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
