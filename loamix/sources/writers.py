"""Rows of export formats as text columns, and writers."""

from __future__ import annotations

import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamix.functions.text import clean_value
from loamix.operators.ordering import numbered
from loamix.plans.shared import Workspace


def key_value(df: DataFrame, path: str, codec: str = "none") -> None:
    """Tab-separated fields without quotes; fields must not hold tabs or line breaks."""
    df.write.mode("overwrite").csv(path, sep="\t", quote="", compression=codec)


def page_files(pages: DataFrame, path: str) -> None:
    """One file below ``path`` for each row (page_id, url, html): the address on the first line, then the page. ``path`` is a URI."""

    def write(rows) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for row in rows:
            if row.url is not None and row.html is not None:
                with fs.open_output_stream(f"{root}/{row.page_id}.page") as file:
                    file.write(f"{row.url}\n{row.html}".encode("utf-8", "surrogatepass"))

    pages.foreachPartition(write)


def submission(df: DataFrame, order: list, columns: dict[str, Column], work: Workspace, index: str = "Id") -> DataFrame:
    """Numbered from 1 in the given order."""
    found = numbered(df, order, work, label="submission")
    return found.select((F.col("place") + 1).cast("int").alias(index), *[c.alias(n) for n, c in columns.items()])


def text_lines(lines: DataFrame, path: str) -> None:
    """One text column, one line for each row."""
    lines.write.mode("overwrite").text(path)


def per_query(df: DataFrame, path: str, key: str = "qid") -> None:
    df.write.mode("overwrite").partitionBy(key).csv(path, header=True)


def category_dictionary(rows: DataFrame, groups: dict[str, Column], work: Workspace, start: int = 15) -> DataFrame:
    """(group, value, idx): contiguous numbers from ``start`` of the distinct values of multi-valued columns, by group and value."""
    each = None
    for name, values in groups.items():
        part = rows.select(F.lit(name).alias("group"), F.explode(values).alias("value")).where("value <> ''").distinct()
        each = part if each is None else each.unionByName(part)
    found = numbered(each, ["group", "value"], work, label="dictionary")
    return found.select("group", "value", (F.col("place") + start).cast("int").alias("idx"))


def libsvm_rows(rows: DataFrame, key: str, label: Column, numeric: list[Column], groups: dict[str, Column], work: Workspace, start: int = 15) -> DataFrame:
    """(key, line): label, numbers by position from 1, then categories as idx:1 in ascending order."""
    numbers = [F.when(c.isNotNull(), F.concat(F.lit(f"{i + 1}:"), c.cast("string"))) for i, c in enumerate(numeric)]
    own = rows.select(F.col(key).alias("_key"), label.cast("string").alias("_label"), F.concat_ws(" ", *numbers).alias("_head"), *[v.alias(f"_g_{n}") for n, v in groups.items()])
    names = category_dictionary(own, {n: F.col(f"_g_{n}") for n in groups}, work, start)
    each = None
    for n in groups:
        part = own.select("_key", F.lit(n).alias("group"), F.explode(F.array_distinct(f"_g_{n}")).alias("value"))
        each = part if each is None else each.unionByName(part)
    ids = each.join(names, ["group", "value"]).groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("idx")), lambda i: F.concat(i.cast("string"), F.lit(":1"))), " ").alias("_tail"))
    return own.join(ids, "_key", "left").select(F.col("_key").alias(key), F.concat_ws(" ", "_label", F.nullif("_head", F.lit("")), "_tail").alias("line"))


def sparse_line(label: Column, groups: dict[str, Column]) -> Column:
    """label and group_value:1 of each value that is not empty."""
    named = lambda n: lambda x: F.concat(F.lit(f"{n}_"), x, F.lit(":1"))
    parts = [F.array_join(F.transform(F.filter(v, lambda x: x.isNotNull() & (x != "")), named(n)), " ") for n, v in groups.items()]
    return F.concat_ws(" ", label.cast("string"), *[F.nullif(p, F.lit("")) for p in parts])


def vw_line(fields: list[Column], label: int = 0, ignore: tuple[int, ...] = (), convert_zeros: bool = False, categorical: bool = False) -> Column:
    """A Vowpal Wabbit row of string fields. ``label`` -1 is the constant 1; ignored positions count the fields left after the label.

    Non-zero numbers become i:value, zeros and empty fields go, other values c<i>_<value without spaces, pipes and colons>.
    """
    target = F.lit("1") if label < 0 else F.trim(fields[label])
    if convert_zeros:
        target = F.when(target.try_cast("double") == 0, F.lit("-1")).otherwise(target)
    out, others = [], [f for i, f in enumerate(fields) if i != label]
    for i, value in enumerate(others, 1):
        if i - 1 in ignore:
            continue
        text = F.concat(F.lit(f"c{i}_"), clean_value(value))
        number = F.lit(None).cast("double") if categorical else value.try_cast("double")
        out.append(F.when(value.isNull() | (F.trim(value) == ""), None).when(number == 0, None).when(number.isNotNull(), F.concat(F.lit(f"{i}:"), F.trim(value))).otherwise(text))
    return F.concat_ws(" ", target, F.lit("|n"), *out)
