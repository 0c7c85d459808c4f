"""Quality selection by importance resampling with hashed n-gram models (DSIR).

Words and pairs of words are hashed into buckets. Two bags of buckets are counted: the target text (documents
labelled good, a bounded sample) and all raw text. A document's log-importance is the sum over its
n-grams of log p(target) - log p(raw); adding Gumbel noise and keeping the k largest draws k documents without
replacement in proportion to their importance. k is the share of good rows among all labels times the number of documents.

The raw counts are summed inside each task and then over all tasks: one row for each bucket and task leaves a task.
The k-th largest value is found by narrowing histograms, so no task sorts all documents, not even those of one value.

Defined results: null and empty texts have no n-grams and log-importance 0. Repeated rows each get a row, with the same noise;
of equal keys at the limit as many are kept as there is room for, no matter which. Labels with a null id or value are left out. Without
good labels the target model equals the raw one. Columns other than the id and text are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamix.plans.shared import Workspace

TOKEN = re.compile(r"\w+|[^\w\s]+")


def buckets(text: str | None, size: int) -> np.ndarray:
    """Bucket of every word and every pair of neighbouring words, repeats included."""
    words = TOKEN.findall((text or "").lower())
    one = np.fromiter([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
    return np.concatenate([one, two]) % np.uint64(size)


def bucket_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of all buckets over ``docs`` (one text column)."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for pdf in batches:
            for text in pdf.iloc[:, 0]:
                np.add.at(total, buckets(text, size).astype(np.int64), 1)
        seen = np.nonzero(total)[0]
        yield pd.DataFrame({"bucket": seen, "n": total[seen]})

    rows = docs.mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[rows["bucket"]] = rows["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", size: int = 10_000, max_rows: int = 20_000) -> tuple[np.ndarray, float]:
    """Log-ratio of every bucket, and the share of good labels."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(max_rows).select("id")
    target = bucket_counts(text.join(F.broadcast(chosen), "id", "left_semi").select("text"), size)
    raw = bucket_counts(text.select("text"), size)
    share = good / n if n else 1.0
    if not target.sum():
        return np.zeros(size), share
    # Both models are smoothed by the pooled frequencies.
    pooled = (raw + 1) / (raw.sum() + size) * 1_000.0
    return np.log((target + pooled) / (target.sum() + pooled.sum())) - np.log((raw + pooled) / (raw.sum() + pooled.sum())), share


def log_weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    source = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [float(shared.value[buckets(x, len(shared.value)).astype(np.int64)].sum()) for x in pdf["text"]]
            yield pd.DataFrame({id_col: pdf[id_col], "log_weight": values})

    return source.mapInPandas(weighed, T.StructType([source.schema[id_col], T.StructField("log_weight", T.DoubleType())]))


#: Rows of the last bin that one task ranks.
FEW = 10_000


def threshold(rows: DataFrame, value: str, k: int, bins: int = 4096, rounds: int = 8) -> tuple[float, float, int]:
    """(low, high, taken): values >= high number ``taken`` <= k; the k-th largest value is in [low, high).

    Each round counts the values of one bin of the round before, until it has FEW rows or its values cannot be told apart.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    high = float(np.nextafter(high, np.inf))
    taken = 0
    for _ in range(rounds):
        width = (high - low) / bins
        if not width > 0 or low + width == low:
            break
        edges = [low + i * width for i in range(bins)] + [high]
        place = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).alias("bin")
        counts = {r.bin: r["count"] for r in rows.where((F.col(value) >= low) & (F.col(value) < high)).groupBy(place).count().collect()}
        at = bins - 1
        while at > 0 and taken + counts.get(at, 0) < k:
            taken += counts.get(at, 0)
            at -= 1
        # Rounding may put a value just beside its bin's edge, so the edges move out a little.
        low, high = edges[at] - width / 1000, edges[at + 1] + width / 1000
        taken = rows.where(F.col(value) >= high).count()
        if counts.get(at, 0) <= FEW:
            break
    return low, high, taken


def _largest(rows: DataFrame, value: str, k: int, tie: str | None) -> DataFrame:
    """``rows`` with ``kept``: true for the k rows with the largest ``value``; equal values by ``tie``, which differs from row to row."""
    n = rows.count()
    if k >= n or k <= 0:
        return rows.withColumn("kept", F.lit(k >= n))
    low, high, taken = threshold(rows, value, k)
    marked = lambda condition, kept: rows.where(condition).withColumn("kept", F.lit(kept))
    edge = rows.where((F.col(value) >= low) & (F.col(value) < high))
    if edge.count() <= FEW or tie is None:
        place = F.row_number().over(Window.orderBy(F.desc(value), *([tie] if tie else [])))
        inside = edge.withColumn("kept", place <= k - taken)
        return marked(F.col(value) >= high, True).unionByName(inside).unionByName(marked(F.col(value) < low, False))
    # The bin is as narrow as can be, so it has few different values: whole values, then one value's rows by ``tie``.
    for row in edge.groupBy(value).count().orderBy(F.desc(value)).toLocalIterator():
        if taken + row["count"] >= k:
            break
        taken += row["count"]
    equal = _largest(rows.where(F.col(value) == row[value]), tie, k - taken, None)
    return marked(F.col(value) > row[value], True).unionByName(equal).unionByName(marked(F.col(value) < row[value], False))


def resample(scored: DataFrame, k: int, work: Workspace, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """``scored`` with the Gumbel ``key`` and ``kept``: true for k rows, drawn by Gumbel top-k."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))).withColumn("_tie", F.monotonically_increasing_id().cast("double"))
    return _largest(work.save(keyed, "keyed"), "key", k, "_tie").drop("_tie")


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, log_weight, key, kept) for every document."""
    work = Workspace(spark, "op3")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ratio, share = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), work)
    scored = log_weights(docs, ratio)
    return resample(scored, round(share * docs.count()), work)
