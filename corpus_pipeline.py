"""Corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the
shared folder and reads it again as the next stage's documents. All stages but the last return the columns of
their input. Documents are told apart by id and text, so nulls and repeated rows are handled by each stage:
repeated rows are scored alike, are one group for the near-duplicate stage, are judged alike for contamination, and are documents of their own for
mixing and writing.

Defined results: all columns of the input come back unchanged, whatever their names; a row travels as one struct beside the stage's
own columns. A null text counts as an empty one and stays null. An empty table gives an empty table from every stage. Very long texts are
handled whole.

Stages share executors, so each leaves little behind. While one runs, Spark drops the shuffle files of each of its jobs as the job ends; its tables go when
its result no longer needs them. The session's limit on the bytes of an Arrow batch is set to BATCH if it has none, and stays, as results are computed later.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamix.llm import decontaminate, mixing, simhash, token_output, toxicity
from loamix.plans.shared import Workspace, broadcast_if_small

#: Documents with this toxicity score or more are rejected.
TOXIC = 0.3
#: Bytes of the texts that are sent to a worker, or come back, together; a longer row goes alone.
BATCH = "2m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _sparing(stage: Stage) -> Stage:
    """``stage`` with the settings that the module's text names."""
    clean, limit = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"

    @wraps(stage)
    def spared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if limit not in spark.conf.getAll:
            spark.conf.set(limit, BATCH)
        before = spark.conf.get(clean)
        spark.conf.set(clean, "true")
        try:
            return stage(spark, docs, sf_dir)
        finally:
            spark.conf.set(clean, before)

    return spared


def _key() -> Column:
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"))


def _named(docs: DataFrame) -> DataFrame:
    """(key, row): each row of ``docs`` as one struct."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(_key().alias("key"), F.struct(*columns).alias("row"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.copy") == F.col(f"{b}.copy"))


def _once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(row, ...): one row of ``docs`` for each of ``keys`` (wanted, rows, ...); ``rows`` tells how many rows of ``docs`` have the key."""
    found = _named(docs).join(broadcast_if_small(keys, 64), _same("key", "wanted"))
    again = found.where("rows > 1").dropDuplicates(["key"])
    return found.where("rows = 1").unionByName(again)


@_sparing
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score is below TOXIC."""
    work = Workspace(spark, "toxicity")
    model = toxicity.fitted(spark, docs, sf_dir, work)
    work.remove()
    return toxicity.keep_clean(docs, model, TOXIC)


@_sparing
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id, and of one id the one with the smallest hash of its text, of each group."""
    work = Workspace(spark, "near-duplicates")
    groups = simhash.similar_documents(docs, work)
    kept = groups.where(F.col("id") == F.col("component_id")).groupBy(F.col("id").alias("wanted")).agg(F.count("*").alias("rows"))
    kept = work.save(kept, "kept")
    work.only("kept")
    return _once(docs, kept).select("row.*")


@_sparing
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no window of a benchmark item occurs."""
    work = Workspace(spark, "decontamination")
    hits = decontaminate.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), work)
    work.only("found")
    hit = hits.select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("copy")).alias("hit"))
    return _named(docs).join(broadcast_if_small(hit, 32), _same("key", "hit"), "left_anti").select("row.*")


@_sparing
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    work = Workspace(spark, "mixing")
    taken = mixing.mix(docs.select(_key().alias("doc_id"), "text", "source"), work)
    keys = taken.groupBy(F.col("doc_id").alias("wanted")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    keys = work.save(keys, "keys")
    work.only("keys")
    once = _once(docs, keys)
    return once.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


@_sparing
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents as token files; (doc_id, start, n_tokens, ids_crc32) of each from what is read back."""
    return token_output.token_files(docs, Workspace(spark, "tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_output", write_tokens),
]
#: No SQL: the first stage trains a model, the last uses a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
