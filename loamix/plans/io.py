"""Queries that write the supplied tables in each text format and read them back."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loamix.functions import text as X
from loamix.plans.base import query, table
from loamix.plans.shared import Workspace
from loamix.sources import collection, readers, writers


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def tsv_rows(spark, d):
    work = Workspace(spark, "tsv")
    writers.key_value(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), work.at("rows"))
    return readers.tsv(spark, work.at("rows"), "key long, name string, region long")


@query("SELECT p_partkey AS key, p_name AS name, codec FROM part, (SELECT 'gzip' AS codec UNION ALL SELECT 'bzip2')")
def compressed_tsv_rows(spark, d):
    work, out = Workspace(spark, "packed"), None
    for codec in ("gzip", "bzip2"):
        writers.key_value(table(spark, d, "part").select("p_partkey", "p_name"), work.at(codec), codec)
        part = readers.tsv(spark, work.at(codec), "key long, name string").withColumn("codec", F.lit(codec))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT ps AS src, nk AS dst FROM (SELECT n_nationkey AS nk, n_regionkey AS ps FROM nation)")
def commented_edges(spark, d):
    """Edge lines among comments and a line that is not a pair of numbers."""
    work = Workspace(spark, "edges")
    lines = table(spark, d, "nation").select(F.explode(F.array(F.concat_ws("\t", "n_regionkey", "n_nationkey"), F.concat(F.lit("# "), "n_name"), F.lit("x y"))).alias("line"))
    writers.text_lines(lines, work.at("lines"))
    return readers.edges(spark, work.at("lines"))


@query("SELECT url, html FROM pages WHERE url IS NOT NULL AND html IS NOT NULL")
def page_files(spark, d):
    work = Workspace(spark, "page-files")
    writers.page_files(table(spark, d, "pages").select("page_id", "url", "html"), work.make("files"))
    return readers.page_files(spark, work.at("files"))


@query("SELECT doc_id, replace(coalesce(source, ''), chr(9), ' ') AS title, replace(replace(coalesce(text, ''), chr(10), ' '), chr(9), ' ') AS body FROM documents")
def split_corpus(spark, d):
    """Numbered files of one corpus, read together; the last field may be missing."""
    work = Workspace(spark, "split")
    one_line = lambda c: F.translate(F.coalesce(c, F.lit("")), "\n\t", "  ")
    rows = table(spark, d, "documents").select(F.concat_ws("\t", "doc_id", one_line("source"), F.nullif(one_line("text"), F.lit(""))).alias("line"))
    for k in range(3):
        writers.text_lines(rows.where(F.pmod(F.xxhash64("line"), F.lit(3)) == k), work.at(f"xa{'abc'[k]}"))
    return readers.documents(spark, [work.at(f"xa{x}") for x in "abc"])


@query("SELECT p_partkey AS id, p_type AS kind FROM part")
def csv_columns(spark, d):
    """Two of three columns of a file with header and semicolons."""
    work = Workspace(spark, "csv")
    table(spark, d, "part").select("p_partkey", "p_name", "p_type").write.csv(work.at("rows"), sep=";", header=True)
    return readers.table(spark, work.at("rows"), "id long, name string, kind string", ["id", "kind"], ";")


@query("SELECT (p_partkey % 2)::DOUBLE AS label, p_size::DOUBLE AS size, p_partkey::DOUBLE AS key FROM part")
def libsvm_read(spark, d):
    work = Workspace(spark, "libsvm")
    lines = table(spark, d, "part").select(F.concat_ws(" ", F.col("p_partkey") % 2, F.concat(F.lit("1:"), "p_size"), F.concat(F.lit("2:"), "p_partkey")).alias("line"))
    writers.text_lines(lines, work.at("lines"))
    found = readers.libsvm(spark, work.at("lines"), 2).withColumn("f", vector_to_array("features"))
    return found.select("label", F.col("f")[0].alias("size"), F.col("f")[1].alias("key"))


@query("SELECT (p_size % 3)::DOUBLE AS label, p_size::DOUBLE AS a, p_partkey::DOUBLE AS b FROM part WHERE p_partkey % 5 <> 1")
def matrix_rows(spark, d):
    """Training and test files of a matrix without header, whose first column is the label; a row that lacks a number is left out."""
    work = Workspace(spark, "matrix")
    number = F.when(F.col("p_partkey") % 5 != 1, F.col("p_partkey").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.col("p_size") % 3, "p_size", number).alias("line"))
    for k, name in enumerate(("train", "test")):
        writers.text_lines(rows.where(F.col("p_partkey") % 2 == k).select("line"), work.at(name))
    return readers.labelled_matrix(spark, [work.at("train"), work.at("test")], ["a", "b"])


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def zlib_documents(spark, d):
    work = Workspace(spark, "zlib")
    docs = table(spark, d, "documents").where("text is not null").select(F.concat_ws("\t", "doc_id", "text").alias("text"))
    collection.write_collection(docs, work.make("docs"))
    spark.dataSource.register(collection.ZlibCollection)
    found = spark.read.format("zlib_collection").option("bytes_per_map", str(1 << 20)).load(work.at("docs"))
    return found.select(F.substring_index("text", "\t", 1).cast("long").alias("doc_id"), F.regexp_replace("text", r"^[^\t]*\t", "").alias("text"))


@query("SELECT page_id, html FROM pages WHERE html IS NOT NULL")
def encoded_pages(spark, d):
    """Pages as base64 of compressed bytes in tab-separated lines."""
    work = Workspace(spark, "encoded")
    writers.key_value(table(spark, d, "pages").where("html is not null").select("page_id", F.translate(F.base64(X.deflate(F.col("html"))), "\r\n", "").alias("payload")), work.at("lines"))
    return readers.encoded_pages(spark, work.at("lines")).withColumnRenamed("id", "page_id")


@query("SELECT n_regionkey AS qid, n_nationkey AS doc_id, n_name AS name FROM nation")
def files_by_query(spark, d):
    work = Workspace(spark, "by-query")
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("qid"), F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("name"))
    writers.per_query(rows, work.at("rows"))
    return spark.read.csv(work.at("rows"), header=True, schema="doc_id long, name string, qid long").select("qid", "doc_id", "name")


_LOG = "lg AS (SELECT o_orderkey AS q, o_custkey AS a, o_custkey % 7 AS b FROM orders WHERE o_orderkey % 10 = 0)"


@query(f"WITH {_LOG}, c AS (SELECT DISTINCT 'q' || q AS query, unnest(['u' || a, 'u' || b]) AS clicked FROM lg) SELECT query, clicked FROM c WHERE substr(clicked, 2)::BIGINT % 2 = 0")
def known_clicks(spark, d):
    """Log lines with lists of shown and clicked addresses; only clicks on known ones are kept, and sessions that have one."""
    from loamix.operators import sessions

    work = Workspace(spark, "log")
    rows = table(spark, d, "orders").where("o_orderkey % 10 = 0")
    urls = F.concat(F.lit("u"), "o_custkey"), F.concat(F.lit("u"), F.col("o_custkey") % 7)
    writers.key_value(rows.select(F.concat(F.lit("q"), "o_orderkey", F.lit("@1")).alias("q"), F.concat_ws(",", *urls).alias("shown"), F.concat_ws(",", *urls).alias("clicked")), work.at("log"))
    log = readers.search_log(spark, work.at("log")).select("query", F.explode("clicked").alias("clicked"))
    known = log.where(F.substr("clicked", F.lit(2)).cast("long") % 2 == 0).select("clicked")
    return sessions.with_known_click(log, known).select("query", "clicked").distinct()
