"""Term statistics in long tables: tf(doc_id, term, f), df(term, df), lengths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamix.functions import text as X
from loamix.plans.shared import Workspace


def term_freq(docs: DataFrame, tokenizer: Callable[[Column], Column] = X.letters, text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(F.col(key).alias(key), F.explode(tokenizer(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("f"))


def field_freq(docs: DataFrame, names: list[str], tokenizer: Callable[[Column], Column] = X.letters, key: str = "doc_id") -> DataFrame:
    """(key, term, f_<name> ..): counts in several text columns, in one pass."""
    parts = [F.struct(F.lit(n).alias("field"), tokenizer(F.col(n)).alias("words")) for n in names]
    each = docs.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.field", F.explode("x.words").alias("term"))
    return each.groupBy(key, "term").agg(*[F.count_if(F.col("field") == n).alias(f"f_{n}") for n in names])


@dataclass(frozen=True)
class TermIndex:
    """A term table written once, with what rankings need of all of it.

    tf (doc_id, term, f), lengths (doc_id, dl), df (term, df, cf), n documents that have a term, their mean length.
    """

    tf: DataFrame
    lengths: DataFrame
    df: DataFrame
    n: float
    avgdl: float

    @classmethod
    def build(cls, tf: DataFrame, work: Workspace, name: str = "") -> TermIndex:
        tf = work.save(tf, f"{name}tf")
        lengths = work.save(tf.groupBy("doc_id").agg(F.sum("f").alias("dl")), f"{name}lengths")
        df = work.save(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("f").alias("cf")), f"{name}df")
        n, avgdl = lengths.agg(F.count("*").cast("double"), F.avg("dl")).first()
        return cls(tf, lengths, df, n, avgdl or 0.0)


@dataclass(frozen=True)
class FieldIndex:
    """As TermIndex, for several fields in one table: columns f_<name>, dl_<name>, df_<name>, and df of their union."""

    names: tuple[str, ...]
    tf: DataFrame
    lengths: DataFrame
    df: DataFrame
    n: float
    avgdl: dict[str, float]
    count: dict[str, float]

    @classmethod
    def build(cls, docs: DataFrame, names: list[str], work: Workspace, tokenizer: Callable[[Column], Column] = X.letters, label: str = "") -> FieldIndex:
        tf = work.save(field_freq(docs, names, tokenizer), f"{label}tf")
        lengths = work.save(tf.groupBy("doc_id").agg(*[F.sum(f"f_{n}").alias(f"dl_{n}") for n in names]), f"{label}lengths")
        own = [F.count_if(F.col(f"f_{n}") > 0).alias(f"df_{n}") for n in names]
        df = work.save(tf.groupBy("term").agg(F.count("*").alias("df"), *own, *[F.sum(f"f_{n}").alias(f"cf_{n}") for n in names]), f"{label}df")
        means = [F.avg(F.when(F.col(f"dl_{n}") > 0, F.col(f"dl_{n}"))).alias(f"a_{n}") for n in names]
        counts = [F.count_if(F.col(f"dl_{n}") > 0).cast("double").alias(f"c_{n}") for n in names]
        row = lengths.agg(F.count("*").cast("double").alias("n"), *means, *counts).first()
        return cls(tuple(names), tf, lengths, df, row.n, {n: row[f"a_{n}"] or 0.0 for n in names}, {n: row[f"c_{n}"] for n in names})

    def field(self, name: str) -> TermIndex:
        """One field as an index of its own."""
        return TermIndex(
            self.tf.where(F.col(f"f_{name}") > 0).select("doc_id", "term", F.col(f"f_{name}").alias("f")),
            self.lengths.where(F.col(f"dl_{name}") > 0).select("doc_id", F.col(f"dl_{name}").alias("dl")),
            self.df.where(F.col(f"df_{name}") > 0).select("term", F.col(f"df_{name}").alias("df"), F.col(f"cf_{name}").alias("cf")),
            self.count[name],
            self.avgdl[name],
        )


def doc_freq(docs: DataFrame, tokenizer: Callable[[Column], Column] = X.letters, text: str = "text") -> DataFrame:
    """Distinct terms inside each row, then one combined count; documents are never shuffled."""
    return docs.select(F.explode(F.array_distinct(tokenizer(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def doc_lengths(tf: DataFrame, key: str = "doc_id") -> DataFrame:
    return tf.groupBy(key).agg(F.sum("f").alias("dl"))


def fields(docs: DataFrame) -> DataFrame:
    """First line as title, the rest as body."""
    body = F.when(F.col("text").contains("\n"), F.expr("substr(text, locate('\n', text) + 1)")).otherwise("")
    return docs.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), body.alias("body"))


def vocabulary(tf: DataFrame, queries: DataFrame) -> DataFrame:
    """Only terms that queries have too."""
    return tf.join(queries.select("term").distinct(), "term", "left_semi")


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("term", F.col("f").alias("fa")), b.select("term", F.col("f").alias("fb"))
    return left.join(right, "term", "full").select("term", (F.coalesce("fa", F.lit(0)) - F.coalesce("fb", F.lit(0))).alias("f"))
