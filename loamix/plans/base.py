"""Registry of queries and their DuckDB SQL, and what several catalogs share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamix.functions import text as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query_terms(spark: SparkSession, d: str, tokenizer=X.letters) -> DataFrame:
    """(qid, term): the benchmark items are the queries."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(tokenizer(F.col("text"))).alias("term"))


# ---- SQL of term tables ----------------------------------------------------------------------------------------

TOK = r"regexp_extract_all(lower({0}), '\p{{L}}+')"
TF = f"""
    t AS (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS f FROM t GROUP BY doc_id, term)"""
STATS = """
    dl AS (SELECT doc_id, sum(f)::DOUBLE AS dl FROM tf GROUP BY doc_id),
    st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
    df AS (SELECT term, count(*) AS df, sum(f)::DOUBLE AS cf FROM tf GROUP BY term)"""
Q = f"""
    qt AS (SELECT item_id AS qid, unnest({TOK.format('text')}) AS term FROM benchmark),
    q AS (SELECT DISTINCT qid, term FROM qt),
    qf AS (SELECT qid, term, count(*) AS qf FROM qt GROUP BY ALL)"""
FIELDS = """
    fl AS (
        SELECT doc_id, split_part(text, chr(10), 1) AS title,
            CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END AS body
        FROM documents
    )"""
FIELD_TF = f"""
    tt AS (SELECT doc_id, unnest({TOK.format('title')}) AS term FROM fl),
    tft AS (SELECT doc_id, term, count(*) AS f FROM tt GROUP BY ALL),
    tb AS (SELECT doc_id, unnest({TOK.format('body')}) AS term FROM fl),
    tfb AS (SELECT doc_id, term, count(*) AS f FROM tb GROUP BY ALL)"""


def top_sql(scores: str, k: int) -> str:
    """The k best of each query, as ``ranking.top_k``."""
    return f"""
    SELECT qid, doc_id, score, rank::INTEGER AS rank
    FROM (
        SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank
        FROM ({scores})
    )
    WHERE rank <= {k}"""
