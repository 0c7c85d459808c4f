"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``window`` words (the whole item if it is shorter). A window occurs in a document only if
all its shingles do, so one necessary shingle per window suffices as the join's prefix, and the rarest in the documents is taken. Rarity is
counted over all documents for the shingles that windows have. A document's shingles meet the prefixes in an equi-join;
the shingle's place in the window gives where the window would start, which the document's length must allow; then the document's
words at that place, as a 256-bit digest, are compared with the window's.

Documents never meet each other, only windows, so copies of a document cost no more than other documents. The
windows' shingles are broadcast if their counted number is small. Else a bitmap of at most 2^20 words of 64 bits is broadcast, which
drops almost all shingles of documents that no window has, and the rest are joined by a shuffle.

Defined results: null texts and texts without words have none, and are not contaminated. Items without
words have no windows. Repeated rows each get a row. Rows are told apart by id and text, so rows of one id with other texts are judged
on their own. Null ids are kept. Columns other than the ids and texts are not read. Empty tables give no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamix.plans import shared
from loamix.plans.shared import Workspace, broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Bytes of a row of shingles and of prefixes, as counted for a broadcast.
SHINGLE_BYTES, PREFIX_BYTES = 16, 160
#: Words of 64 bits in the bitmap of shingles at most; 16 MB.
BITMAP = 1 << 20


def words(text: str) -> str:
    """SQL for the words of a text expression."""
    return f"filter(split(translate({text}, '{UPPER}', '{LOWER}'), '{BETWEEN.replace(chr(92), chr(92) * 2)}'), x -> x <> '')"


def _bound(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``; a plain alias would be written out at each use."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _shingle(of: str, at: str, width: int) -> str:
    return "xxhash64(" + ", ".join(f"get({of}, {at} + {i})" for i in range(width)) + ")"


def _shingles(of: str, width: int) -> str:
    return f"if(size({of}) >= {width}, transform(sequence(0, greatest(size({of}) - {width}, 0)), i -> {_shingle(of, 'i', width)}), array())"


def windows_of(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(window, item): the distinct windows as arrays of words, with the items that have them."""
    cut = f"if(size(w) = 0, array(), transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window})))"
    own = items.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.select("item", F.explode(F.expr(_bound(words("text"), "w", cut))).alias("window")).distinct()


NO_STARTS, NO_ITEMS = "cast(array() as array<struct<start:int,length:int>>)", "cast(array() as array<string>)"


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def find(docs: DataFrame, items: DataFrame, work: Workspace, window: int = 10, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, starts, items) for every row of ``docs``; see ``hits``."""
    base = _own(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), F.expr(f"size({words('text')})").cast("long").alias("n_words"))
    found = hits(docs, items, work, window, id_col, text_col, **columns)
    return base.join(found, _same(base, found), "left").select(base["doc_id"], base["text_hash"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("starts", F.expr(NO_STARTS)).alias("starts"), F.coalesce("items", F.expr(NO_ITEMS)).alias("items"))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _having(shingled: DataFrame, wanted: DataFrame, row_bytes: int) -> DataFrame:
    """The rows of ``shingled`` joined with ``wanted`` on the shingle."""
    small = max(1, shared.BROADCAST_BYTES // row_bytes)
    if wanted.limit(small + 1).count() <= small:
        return shingled.join(F.broadcast(wanted), "shingle")
    word, bit = F.col("shingle").bitwiseAND(64 * BITMAP - 64), F.expr("shiftleft(1L, cast(shingle & 63 as int))")
    bits = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    likely = shingled.withColumn("word", word).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return likely.drop("word", "bits").join(wanted, "shingle")


def hits(docs: DataFrame, items: DataFrame, work: Workspace, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_hit, starts, items) for each different contaminated document.

    ``starts`` lists (start, length) of the occurrences in words, ``items`` the ids of the items as sorted strings.
    """
    own = _own(docs, id_col, text_col)
    owned = work.save(windows_of(items, window, item_id, item_text).withColumn("window_id", F.sha2(F.array_join("window", " "), 256)), "windows")
    windows = work.save(owned.select("window_id", "window").distinct(), "distinct_windows")
    widths = [r.width for r in windows.select(F.least(F.size("window"), F.lit(SHINGLE)).alias("width")).distinct().orderBy("width").collect()]  # 1 .. SHINGLE
    if not widths:
        kind = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text_hash long, n_hit long, starts array<struct<start:int,length:int>>, items array<string>"
        return docs.sparkSession.createDataFrame([], kind)
    width = F.explode(F.array(*[F.lit(s) for s in widths])) if len(widths) > 1 else F.lit(widths[0])
    cut = lambda of: "case " + " ".join(f"when width = {s} then {_shingles(of, s)}" for s in widths) + " end"
    shingled = own.select("doc_id", F.xxhash64("text").alias("text_hash"), width.alias("width"), "text")
    shingled = shingled.select("doc_id", "text_hash", F.posexplode(F.expr(_bound(words("text"), "w", cut("w")))).alias("at", "shingle"))
    # Rarity: occurrences in all documents of the shingles that windows have.
    placed = windows.select("window_id", F.size("window").alias("length"), F.least(F.size("window"), F.lit(SHINGLE)).alias("width"), "window")
    placed = placed.select("window_id", "length", F.posexplode(F.expr(cut("window"))).alias("offset", "shingle"))
    wanted = work.save(placed.select("shingle").distinct(), "wanted")
    rarity = work.save(_having(shingled, wanted, SHINGLE_BYTES).groupBy("shingle").agg(F.count("*").alias("n")), "rarity")
    # The prefix of each window: its rarest shingle, the first of equally rare ones.
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("first")
    ranked = placed.join(broadcast_if_small(rarity, 32), "shingle", "left").groupBy("window_id", "length").agg(rare)
    # A window with a shingle that no document has occurs nowhere.
    prefixes = work.save(ranked.where("first.n > 0").select("window_id", "length", "first.shingle", "first.offset"), "prefixes")
    met = _having(shingled, prefixes, PREFIX_BYTES)
    met = met.select("doc_id", "text_hash", (F.col("at") - F.col("offset")).alias("start"), "length", "window_id").where("start >= 0")
    # All candidates of a document: no more than it has words times the windows that share a shingle.
    candidates = work.save(met.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length", "window_id")).alias("found")), "candidates")
    some = broadcast_if_small(candidates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")), 32)
    texts = own.withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi")
    cand = candidates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "found")
    paired = texts.join(cand, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    # Words hold no spaces, so the digest of the joined words is one of the words.
    exact = "filter(found, c -> c.start + c.length <= size(w) and sha2(array_join(slice(w, c.start + 1, c.length), ' '), 256) = c.window_id)"
    met_at = paired.select("doc_id", "text_hash", F.expr(f"array_sort({_bound(words('text'), 'w', exact)})").alias("hits"))
    met_at = work.save(met_at.where("size(hits) > 0").distinct(), "hits")
    covered = "aggregate(hits, struct(0 as end, 0L as n), (acc, c) -> struct(greatest(acc.end, c.start + c.length) as end, acc.n + greatest(0, c.start + c.length - greatest(acc.end, c.start)) as n), acc -> acc.n)"
    spans = met_at.select("doc_id", "text_hash", F.expr(covered).cast("long").alias("n_hit"), F.expr("array_distinct(transform(hits, c -> struct(c.start, c.length)))").alias("starts"))
    windows_hit = met_at.select("doc_id", "text_hash", F.explode(F.expr("array_distinct(hits.window_id)")).alias("window_id"))
    of_items = windows_hit.join(broadcast_if_small(owned.select("window_id", F.col("item").cast("string").alias("item")), 128), "window_id").where("item is not null")
    of_items = of_items.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = spans.join(of_items, _same(spans, of_items), "left").select(spans["doc_id"], spans["text_hash"], "n_hit", "starts", "items")
    return work.save(both.select("doc_id", "text_hash", "n_hit", "starts", F.coalesce("items", F.expr(NO_ITEMS)).alias("items")), "found")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Workspace(spark, "op8"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _sql_words(table: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


ORACLE = {
    "op8_decontamination": f"""
WITH d AS ({_sql_words('documents', 'doc_id')}), i AS ({_sql_words('benchmark', 'item_id')}),
wi AS (SELECT DISTINCT item_id, list_slice(w, p, p + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM wi),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
occ AS (SELECT doc_id, p, n, item_id FROM dp JOIN lens ON p + n - 1 <= len(w) JOIN wi ON wi.win = list_slice(w, p, p + n - 1)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""
}
