"""Readers of text formats; all keep columns as declared and turn what does not parse into nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tsv(spark: SparkSession, path, schema: str) -> DataFrame:
    """Positional tab-separated lines without quotes; missing trailing fields are null. Codecs go by the file's ending."""
    return spark.read.csv(path, sep="\t", schema=schema, quote="", mode="PERMISSIVE")


def clicks(spark: SparkSession, path) -> DataFrame:
    return tsv(spark, path, "query string, url string")


def edges(spark: SparkSession, path) -> DataFrame:
    """Whitespace-separated pairs of numbers; lines that start with # are comments."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return lines.select(F.get(parts, F.lit(0)).try_cast("long").alias("src"), F.get(parts, F.lit(1)).try_cast("long").alias("dst")).where("src is not null and dst is not null")


def documents(spark: SparkSession, paths) -> DataFrame:
    """doc_id, title, body; missing fields are empty."""
    parts = F.split("value", "\t")
    return spark.read.text(paths).select(F.get(parts, F.lit(0)).try_cast("long").alias("doc_id"), *[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in ((1, "title"), (2, "body"))])


def page_files(spark: SparkSession, path) -> DataFrame:
    """One page for each file below ``path``: the first line is the URL, the rest the page."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return text.select(F.substring_index("value", "\n", 1).alias("url"), F.regexp_replace("value", r"^[^\n]*\n?", "").alias("html"))


def encoded_pages(spark: SparkSession, path) -> DataFrame:
    """id and html of lines with id and base64 of compressed pages."""
    from loamix.functions.text import inflate

    return tsv(spark, path, "id long, payload string").select("id", inflate(F.try_to_binary("payload", F.lit("base64"))).alias("html"))


def search_log(spark: SparkSession, path) -> DataFrame:
    """query (before @), shown and clicked lists."""
    raw = tsv(spark, path, "query string, showed string, clicked string")
    return raw.select(F.substring_index("query", "@", 1).alias("query"), F.split("showed", ",").alias("showed"), F.split("clicked", ",").alias("clicked"))


def click_sessions(spark: SparkSession, path) -> DataFrame:
    """clicks array of each line of 0 and 1."""
    return spark.read.text(path).select(F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("int")).alias("clicks"))


def matrix(spark: SparkSession, path, names: list[str]) -> DataFrame:
    """Whitespace-separated numbers; rows that lack one are dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(*[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)]).dropna()


def labelled_matrix(spark: SparkSession, paths: list, names: list[str]) -> DataFrame:
    """label (first column) and features of several matrix files, such as training and test rows, in one table."""
    out = None
    for path in paths:
        part = matrix(spark, path, ["label", *names])
        out = part if out is None else out.unionByName(part)
    return out


def prefixed(df: DataFrame, prefix: str, *others: str) -> DataFrame:
    """``others`` and the columns whose names start with ``prefix``."""
    return df.select(*others, *[c for c in df.columns if c.startswith(prefix)])


def table(spark: SparkSession, path, schema: str, columns: list[str] | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    df = spark.read.csv(path, schema=schema, sep=sep, header=header)
    return df.select(*columns) if columns else df


def libsvm(spark: SparkSession, path, features: int) -> DataFrame:
    return spark.read.format("libsvm").option("numFeatures", features).load(path)
