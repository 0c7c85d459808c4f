"""Queries on the supplied tables and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamix.functions import text as X
from loamix.operators import graph, ltr, sessions, stats, terms
from loamix.plans.base import FIELD_TF, FIELDS, ORACLES, QUERIES, STATS, TF, TOK, Q, query, query_terms, table
from loamix.plans.shared import Workspace
from loamix.sources import writers
from loamix.streaming import events as stream

# ---- term statistics -------------------------------------------------------------------------------------------

@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY term")
def doc_freq(spark, d):
    return terms.doc_freq(table(spark, d, "documents"))


@query(f"WITH {TF} SELECT doc_id, term, f FROM tf")
def term_freq(spark, d):
    return terms.term_freq(table(spark, d, "documents"))


@query(f"WITH {TF} SELECT term, sum(f)::BIGINT AS cf FROM tf GROUP BY term")
def coll_freq(spark, d):
    return terms.term_freq(table(spark, d, "documents")).groupBy("term").agg(F.sum("f").alias("cf"))


@query(f"WITH {TF} SELECT term, sum(f)::BIGINT AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 100")
def top_terms(spark, d):
    return coll_freq(spark, d).orderBy(F.desc("cf"), "term").limit(100)


@query(f"WITH {FIELDS}, {FIELD_TF}, u AS (SELECT doc_id, term FROM tft UNION SELECT doc_id, term FROM tfb) SELECT term, coalesce(a.n, 0) AS title_df, coalesce(b.n, 0) AS body_df, c.n AS union_df FROM (SELECT term, count(*) AS n FROM u GROUP BY term) c LEFT JOIN (SELECT term, count(*) AS n FROM tft GROUP BY term) a USING (term) LEFT JOIN (SELECT term, count(*) AS n FROM tfb GROUP BY term) b USING (term)")
def field_df(spark, d):
    """One pass: a term's field flags per document, then counts."""
    f = terms.fields(table(spark, d, "documents"))
    each = f.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("t"), F.lit(0).alias("b"), F.array_distinct(X.letters(F.col("title"))).alias("w")), F.struct(F.lit(0).alias("t"), F.lit(1).alias("b"), F.array_distinct(X.letters(F.col("body"))).alias("w")))).alias("x"))
    flags = each.select("doc_id", "x.t", "x.b", F.explode("x.w").alias("term")).groupBy("doc_id", "term").agg(F.max("t").alias("t"), F.max("b").alias("b"))
    return flags.groupBy("term").agg(F.sum("t").alias("title_df"), F.sum("b").alias("body_df"), F.count("*").alias("union_df"))


@query(f"WITH {TF}, {STATS} SELECT n::BIGINT AS docs, (SELECT sum(dl)::BIGINT FROM dl) AS words, round(avgdl, 6) AS avgdl FROM st")
def doc_len_stats(spark, d):
    dl = terms.doc_lengths(terms.term_freq(table(spark, d, "documents")))
    return dl.agg(F.count("*").alias("docs"), F.sum("dl").alias("words"), F.round(F.avg("dl"), 6).alias("avgdl"))


@query(f"WITH {TF}, {Q} SELECT doc_id, term, f FROM tf WHERE term IN (SELECT term FROM q)")
def vocab_prune(spark, d):
    return terms.vocabulary(terms.term_freq(table(spark, d, "documents")), query_terms(spark, d)).select("doc_id", "term", "f")


@query(f"WITH {TF}, {STATS} SELECT term, df FROM df, st WHERE df <= n / 2")
def common_term_skip(spark, d):
    index = terms.TermIndex.build(terms.term_freq(table(spark, d, "documents")), Workspace(spark, "terms"))
    return index.df.where(F.col("df") <= index.n / 2).select("term", "df")


@query(r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{Nd}+|[\p{L}_]+')) AS w FROM documents) WHERE NOT regexp_matches(w, '^[0-9]{5}') GROUP BY w")
def digit_drop(spark, d):
    return table(spark, d, "documents").select(F.explode(X.drop_numbers(X.letters_or_digits(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) WHERE w NOT IN ('the', 'of', 'and', 'a', 'to', 'in', 'is') GROUP BY w")
def stop_word_drop(spark, d):
    words = X.drop_stop_words(X.word_chars(F.col("text")), ["the", "of", "and", "a", "to", "in", "is"])
    return table(spark, d, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS w FROM conversations) GROUP BY w")
def space_words(spark, d):
    return table(spark, d, "conversations").select(F.explode(X.spaces(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_KEYS = f"'{X.LATIN_KEYS.replace(chr(39), chr(39) * 2)}', '{X.CYRILLIC_KEYS}'"


@query(
    rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\S+')) AS word FROM benchmark),
    v AS (SELECT DISTINCT lower(translate(word, {_KEYS})) AS term FROM w WHERE length(word) % 2 = 0 AND regexp_matches(word, '^[a-zA-Z]+$'))
    SELECT word, CASE WHEN regexp_matches(word, '^[a-zA-Z]+$') AND lower(translate(word, {_KEYS})) IN (SELECT term FROM v) THEN translate(word, {_KEYS}) ELSE word END AS fixed FROM w"""
)
def layout_fixes(spark, d):
    """Words typed on the wrong keys; the vocabulary knows those with an even number of letters."""
    words = table(spark, d, "benchmark").select(F.explode(X.spaces(F.col("text"))).alias("word")).distinct()
    known = words.where("length(word) % 2 = 0").where(F.col("word").rlike("^[a-zA-Z]+$")).select(F.lower(F.translate("word", X.LATIN_KEYS, X.CYRILLIC_KEYS)).alias("term"))
    return X.fixed_words(words, known)


def _grams_sql(table, n):
    return f"SELECT gram, count(*) AS df FROM (SELECT DISTINCT k, substr(p, i, {n}) AS gram FROM (SELECT k, p, unnest(range(1, length(p) - {n} + 2)) AS i FROM (SELECT doc_id AS k, repeat('$', {n - 1}) || text || repeat('$', {n - 1}) AS p FROM {table} WHERE text <> ''))) GROUP BY gram"


@query(_grams_sql("documents", 3))
def char_trigrams_df(spark, d):
    return table(spark, d, "documents").select(F.explode(F.array_distinct(X.char_ngrams(F.col("text"), 3))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


@query(_grams_sql("documents", 2))
def char_bigrams_df(spark, d):
    return table(spark, d, "documents").select(F.explode(F.array_distinct(X.char_ngrams(F.col("text"), 2))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


@query(f"SELECT gram, count(*) AS n FROM (SELECT substr(p, i, 3) AS gram FROM (SELECT p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT '#' || array_to_string({TOK.format('text')}, '#') || '#' AS p FROM documents))) WHERE substr(gram, 2, 1) <> '#' GROUP BY gram")
def hash_trigram_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(X.hash_trigrams(X.letters(F.col("text")))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"WITH {TF}, a AS (SELECT term, sum(f) AS f FROM tf GROUP BY term), b AS (SELECT term, count(*) AS f FROM (SELECT unnest({TOK.format('text')}) AS term FROM conversations) GROUP BY term) SELECT term, (coalesce(a.f, 0) - coalesce(b.f, 0))::BIGINT AS f FROM a FULL JOIN b USING (term)")
def bag_difference(spark, d):
    words = table(spark, d, "conversations").select(F.explode(X.letters(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("f"))
    return terms.bag_difference(coll_freq(spark, d).withColumnRenamed("cf", "f"), words)


# ---- URLs and pages --------------------------------------------------------------------------------------------

_HOST = r"regexp_replace(split_part(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':', 1), '^www\.', '')"
_CLICKS = f"c AS (SELECT {_HOST} AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1), ''), '-') AS query FROM pages), n AS (SELECT host, query, count(*) AS n FROM c GROUP BY ALL)"


def _clicks(spark, d):
    return table(spark, d, "pages").select("url", F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1), F.lit("")), F.lit("-")).alias("query"))


_BEST = f"WITH {_CLICKS} SELECT host, query, n FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, query) AS p FROM n) WHERE p = 1"


@query(f"{_BEST} AND n >= 3")
def host_top_query_least(spark, d):
    """Hosts whose most frequent query comes three times or more."""
    return sessions.top_query_per_host(_clicks(spark, d), least=3)


@query(_BEST)
def host_top_query(spark, d):
    return sessions.top_query_per_host(_clicks(spark, d))


@query(f"WITH {_CLICKS}, e AS (SELECT host, query, n FROM (SELECT *, max(query) OVER (PARTITION BY host) AS l FROM n) WHERE query <> l AND n > 1 UNION ALL SELECT host, min(query), 1 FROM n GROUP BY host) SELECT host, query, n FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, query) AS p FROM e) WHERE p = 1")
def host_top_query_strict(spark, d):
    return sessions.top_query_per_host(_clicks(spark, d), strict=True)


_SPOILT = """CASE WHEN page_id % 7 = 0 THEN replace(url, '://', ':') WHEN page_id % 11 = 0 THEN regexp_replace(url, '://[^/?#]*', '://a_b.com') ELSE url END"""


@query(f"SELECT count(*) FILTER (NOT regexp_matches(u, '^[a-z]+://[A-Za-z0-9.-]+(:[0-9]+)?([/?#]|$)')) AS bad, count(*) AS total FROM (SELECT {_SPOILT} AS u FROM pages)")
def bad_urls(spark, d):
    """Some addresses are spoilt: without slashes, or with a host that no address may have."""
    spoilt = F.when(F.col("page_id") % 7 == 0, F.replace("url", F.lit("://"), F.lit(":")))
    spoilt = spoilt.when(F.col("page_id") % 11 == 0, F.regexp_replace("url", "://[^/?#]*", "://a_b.com")).otherwise(F.col("url"))
    return sessions.bad_urls(table(spark, d, "pages").select(spoilt.alias("url")))


@query(r"SELECT page_id, url FROM pages WHERE contains(url, '/e')")
def url_contains(spark, d):
    return table(spark, d, "pages").where(F.contains("url", F.lit("/e"))).select("page_id", "url")


_CANON = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^http://', ''), '^https://', ''), '^www\.', ''), '/$', '')"
_LOGGED = "'http://www.' || regexp_replace(url, '^[a-z]+://(www\\.)?', '') || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END".replace("\\\\", "\\")


@query(f"SELECT p.page_id, count(*) AS n FROM pages p JOIN (SELECT {_LOGGED} AS u FROM pages WHERE page_id % 3 = 0) l ON {_CANON.format('p.url')} = {_CANON.format('l.u')} GROUP BY p.page_id")
def click_pages(spark, d):
    """A log that writes addresses in another way is joined with the pages by canonical address."""
    pages = table(spark, d, "pages")
    bare = F.concat(F.lit("http://www."), F.regexp_replace("url", r"^[a-z]+://(www\.)?", ""), F.when(F.col("page_id") % 2 == 0, "/").otherwise(""))
    log = pages.where("page_id % 3 = 0").select(X.canonical_url(bare).alias("u"))
    return pages.select("page_id", X.canonical_url(F.col("url")).alias("u")).join(log, "u").groupBy("page_id").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^http://', ''), '^https://', ''), '^www\.', ''), '/$', '') AS url FROM pages")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


_HREF = "links AS (SELECT page_id AS src, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS href FROM pages), l AS (SELECT src, CASE WHEN starts_with(href, '/') THEN origin || href ELSE href END AS dst FROM links WHERE href <> '')"


@query(f"WITH {_HREF} SELECT src, dst, count(*) AS n FROM l GROUP BY ALL")
def page_links(spark, d):
    return graph.page_links(table(spark, d, "pages")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {_HREF}, k AS (SELECT dst FROM l GROUP BY dst HAVING count(DISTINCT src) >= 2) SELECT src, dst, count(*) AS n FROM l WHERE dst IN (SELECT dst FROM k) GROUP BY ALL")
def known_links(spark, d):
    """Only links to addresses of a dictionary: those that two pages or more link to."""
    pages = table(spark, d, "pages")
    known = graph.page_links(pages).groupBy(F.col("dst").alias("url")).agg(F.countDistinct("src").alias("n")).where("n >= 2")
    return graph.page_links(pages, Workspace(spark, "known").save(known, "known")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|title|a)\\b[^>]*>.*?</(script|style|title|a)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages")
def page_fields(spark, d):
    return table(spark, d, "pages").select("page_id", X.title(F.col("html")).alias("title"), X.body_text(F.col("html")).alias("body"))


@query()
def html_udf(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_fields(F.col("html")).alias("f")).select("page_id", "f.*")


# ---- graphs ----------------------------------------------------------------------------------------------------

_EDGES = "ed AS (SELECT DISTINCT l_suppkey AS src, nxt AS dst FROM (SELECT l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem) WHERE nxt <> l_suppkey)"


def _edges(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst")).where("dst <> src").distinct()


def _pagerank_sql(steps, dangling):
    parts = [_EDGES, "nd AS (SELECT src AS id FROM ed UNION SELECT dst FROM ed)", "deg AS (SELECT src, count(*)::DOUBLE AS k FROM ed GROUP BY src)", "r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS r FROM nd)"]
    for i in range(1, steps + 1):
        lost = f"+ coalesce((SELECT sum(r) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM deg)), 0) / (SELECT count(*) FROM nd)" if dangling else ""
        parts.append(f"r{i} AS MATERIALIZED (SELECT id, 0.85::DOUBLE * (coalesce(g, 0) {lost}) + 0.15::DOUBLE / (SELECT count(*) FROM nd) AS r FROM nd LEFT JOIN (SELECT dst, sum(r / k) AS g FROM ed JOIN deg USING (src) JOIN r{i - 1} ON id = src GROUP BY dst) ON dst = id)")
    return f"WITH {', '.join(parts)} SELECT id, round(r, 8) AS rank FROM r{steps}"


@query(_pagerank_sql(5, False))
def pagerank_mr(spark, d):
    work = Workspace(spark, "pagerank")
    return graph.pagerank(work.save(_edges(spark, d), "edges"), work, 5).select("id", F.round("rank", 8).alias("rank"))


@query(_pagerank_sql(5, True))
def pagerank_dangling(spark, d):
    work = Workspace(spark, "pagerank")
    return graph.pagerank(work.save(_edges(spark, d), "edges"), work, 5, dangling=True).select("id", F.round("rank", 8).alias("rank"))


_HITS = [_EDGES, "nd AS (SELECT src AS id FROM ed UNION SELECT dst FROM ed)", "h0 AS (SELECT id, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM nd)"]
_HITS += [f"h{i} AS MATERIALIZED (SELECT id, coalesce(h, 0) AS hub, coalesce(x, 0) AS authority FROM nd LEFT JOIN (SELECT src, sum(authority) AS h FROM ed JOIN h{i - 1} ON dst = id GROUP BY src) ON src = id LEFT JOIN (SELECT dst, sum(hub) AS x FROM ed JOIN h{i - 1} ON src = id GROUP BY dst) ON dst = id)" for i in (1, 2, 3)]


def _hits(spark, d):
    work = Workspace(spark, "hits")
    return graph.hits(work.save(_edges(spark, d), "edges"), work, 3)


@query(f"WITH {', '.join(_HITS)} SELECT id, hub, authority FROM h3")
def hits_jacobi(spark, d):
    return _hits(spark, d)


@query(f"WITH {', '.join(_HITS)} SELECT id, s_name AS name, hub FROM h3 JOIN supplier ON s_suppkey = id ORDER BY hub DESC, id LIMIT 30")
def hits_top(spark, d):
    return _hits(spark, d).join(table(spark, d, "supplier"), F.col("id") == F.col("s_suppkey")).select("id", F.col("s_name").alias("name"), "hub").orderBy(F.desc("hub"), "id").limit(30)


@query(f"WITH {', '.join(_HITS)} SELECT kind, id FROM (SELECT 'hub' AS kind, id, row_number() OVER (ORDER BY hub DESC, id) AS p FROM h3 UNION ALL SELECT 'authority', id, row_number() OVER (ORDER BY authority DESC, id) FROM h3) WHERE p = 1")
def hits_best(spark, d):
    """The best hub and the best authority; of equal ones the first."""
    found = Workspace(spark, "best").save(_hits(spark, d), "hits")
    best = lambda kind: found.orderBy(F.desc(kind), "id").limit(1).select(F.lit(kind).alias("kind"), "id")
    return best("hub").unionByName(best("authority"))


@query(f"{_pagerank_sql(5, True)} ORDER BY rank, id")
def rank_export(spark, d):
    """Pages by ascending rank."""
    return pagerank_dangling(spark, d).orderBy("rank", "id")


@query(f"WITH {_EDGES} SELECT src AS page, round(1.0::DOUBLE / (SELECT count(*) FROM (SELECT src FROM ed UNION SELECT dst FROM ed)), 12) AS rank, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS links FROM ed GROUP BY src")
def adjacency(spark, d):
    return graph.adjacency(_edges(spark, d)).select("page", F.round("rank", 12).alias("rank"), "links")


# ---- learning to rank ------------------------------------------------------------------------------------------

_L0 = "l0 AS (SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, floor(l_quantity / 11)::INTEGER AS y, l_extendedprice / 10000 AS s FROM lineitem)"
_LTR = f"{_L0}, rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, idx DESC) - 1 AS pos, row_number() OVER (PARTITION BY qid ORDER BY y DESC, idx DESC) - 1 AS ipos FROM l0)"


def _ltr(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.row_number().over(w).alias("idx"), F.floor(F.col("l_quantity") / 11).cast("int").alias("y"), (F.col("l_extendedprice") / 10000).alias("s"))


_NDCG = "nd AS (SELECT qid, sum((pow(2, y) - 1) / log2(pos + 2)) FILTER (pos < {0}) AS dcg, sum((pow(2, y) - 1) / log2(ipos + 2)) FILTER (ipos < {0}) AS idcg FROM rk GROUP BY qid)"


@query(f"WITH {_LTR}, {_NDCG.format(5)} SELECT qid, round(dcg, 8) AS dcg, round(idcg, 8) AS idcg, round(dcg / nullif(idcg, 0), 8) AS ndcg FROM nd")
def ndcg_at_5(spark, d):
    return ltr.ndcg(_ltr(spark, d), 5).select("qid", *[F.round(c, 8).alias(c) for c in ("dcg", "idcg", "ndcg")])


@query(f"WITH {_LTR}, {_NDCG.format(1000000)} SELECT round(avg(dcg / nullif(idcg, 0)), 8) AS mean_ndcg FROM nd")
def mean_ndcg(spark, d):
    return ltr.ndcg(_ltr(spark, d)).agg(F.round(F.avg("ndcg"), 8).alias("mean_ndcg"))


_SHIFTED = _NDCG.format(1000000).replace("log2(pos + 2)", "({0}(pos + {1}) + 1)").replace("log2(ipos + 2)", "({0}(ipos + {1}) + 1)")


@query(f"WITH {_LTR}, {_SHIFTED.format('log2', 2)} SELECT qid, round(dcg, 8) AS dcg, round(idcg, 8) AS idcg, round(dcg / nullif(idcg, 0), 8) AS ndcg FROM nd")
def ndcg_shifted(spark, d):
    return ltr.ndcg(_ltr(spark, d), discount="shifted").select("qid", *[F.round(c, 8).alias(c) for c in ("dcg", "idcg", "ndcg")])


@query(f"WITH {_LTR}, {_SHIFTED.format('log2', 1)} SELECT round(avg(coalesce(dcg / nullif(idcg, 0), 0)), 8) AS loss FROM nd")
def ndcg_loss(spark, d):
    return ltr.ndcg_loss(_ltr(spark, d)).select(F.round("loss", 8).alias("loss"))


@query(f"WITH {_L0} SELECT qid, idx::INTEGER AS idx, dense_rank() OVER (PARTITION BY qid ORDER BY y)::INTEGER AS y FROM l0 WHERE qid IN (SELECT qid FROM l0 GROUP BY qid HAVING min(y) <> max(y))")
def dense_relabel(spark, d):
    return ltr.prepare(_ltr(spark, d)).select("qid", "idx", "y")


_PAIRS = f"{_LTR}, ic AS (SELECT qid, sum((pow(2, y) - 1) / log2(ipos + 2)) AS idcg FROM rk GROUP BY qid), pr AS (SELECT a.qid, a.idx AS i, b.idx AS j, a.s AS si, b.s AS sj, abs((pow(2, a.y) - pow(2, b.y)) * (1 / log2(a.pos + 2) - 1 / log2(b.pos + 2))) / idcg AS delta, 1 / (1 + exp(a.s - b.s)) AS rho FROM rk a JOIN rk b ON a.qid = b.qid AND a.y > b.y JOIN ic ON ic.qid = a.qid WHERE idcg > 0)"


@query(f"WITH {_PAIRS} SELECT qid, idx::INTEGER AS idx, round(sum(l), 8) + 0 AS lam, round(sum(w), 8) AS w FROM (SELECT qid, i AS idx, delta * rho AS l, delta * rho * (1 - rho) AS w FROM pr UNION ALL SELECT qid, j, -delta * rho, delta * rho * (1 - rho) FROM pr) GROUP BY qid, idx")
def lambda_grad(spark, d):
    return ltr.lambdas(_ltr(spark, d)).select("qid", "idx", (F.round("lam", 8) + 0).alias("lam"), F.round("w", 8).alias("w"))


_INVERTED = _PAIRS.replace("log2(ipos + 2)", "(log2(ipos + 1) + 1)").replace("log2(a.pos + 2)", "(log2(a.pos + 1) + 1)").replace("log2(b.pos + 2)", "(log2(b.pos + 1) + 1)")


@query(f"WITH {_INVERTED} SELECT qid, idx::INTEGER AS idx, round(sum(g), 8) + 0 AS gradient, round(sum(h), 8) AS hessian FROM (SELECT qid, i AS idx, -delta * rho AS g, delta * rho * (1 - rho) AS h FROM pr UNION ALL SELECT qid, j, delta * rho, delta * rho * (1 - rho) FROM pr) GROUP BY qid, idx")
def pair_gradients(spark, d):
    """Gradient and curvature with inverted-rank discounts."""
    return ltr.gradients(_ltr(spark, d)).select("qid", "idx", (F.round("gradient", 8) + 0).alias("gradient"), F.round("hessian", 8).alias("hessian"))


@query(f"WITH {_PAIRS} SELECT qid, round(sum(delta * CASE WHEN si - sj < -20 THEN sj - si WHEN si - sj > 20 THEN 0 ELSE ln(1 + exp(sj - si)) END), 8) AS loss FROM pr GROUP BY qid")
def pair_loss(spark, d):
    return ltr.pair_loss(_ltr(spark, d)).select("qid", F.round("loss", 8).alias("loss"))


# ---- sessions and tests ----------------------------------------------------------------------------------------


def _ratings(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("mid"), F.to_date("o_orderdate").alias("date"))


@query("SELECT uid, mid, day::INTEGER AS day, lag(mid) OVER (PARTITION BY uid ORDER BY day, mid) AS prev, round(1.0::DOUBLE / count(*) OVER (PARTITION BY uid), 8) AS share FROM (SELECT o_custkey AS uid, o_orderkey AS mid, date_diff('day', DATE '1999-11-10', o_orderdate::DATE) AS day FROM orders)")
def history_features(spark, d):
    return sessions.history_features(_ratings(spark, d)).select("uid", "mid", "day", "prev", F.round("share", 8).alias("share"))


@query("SELECT l_partkey AS item, round(avg(l_quantity), 6) AS mean, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_partkey")
def mean_by_item(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.countDistinct("l_orderkey").alias("orders"))


def _arms(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 2).cast("int").alias("arm"), "ts", "event_id", F.array((F.col("event_type") == "click").cast("int")).alias("clicks"))


_BLOCKS = "bl AS (SELECT arm, block, avg(c) AS ctr FROM (SELECT (user_id % 2)::INTEGER AS arm, (row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts, event_id) - 1) // 100 AS block, (event_type = 'click')::INTEGER AS c FROM events) GROUP BY arm, block HAVING count(*) = 100)"


@query(f"WITH {_BLOCKS} SELECT arm, block::BIGINT AS block, round(ctr, 8) AS ctr FROM bl")
def ctr_blocks(spark, d):
    return sessions.click_blocks(_arms(spark, d), ["ts", "event_id"], 100, Workspace(spark, "blocks"), ["arm"]).select("arm", "block", F.round("ctr", 8).alias("ctr"))


@query("SELECT block, round(avg((c > 0)::INTEGER), 8) AS ctr, round(avg((f > 0)::INTEGER), 8) AS first_rate, round(avg(c), 8) AS mean_clicks FROM (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 1000 AS block, event_id % 3 + event_id % 2 AS c, event_id % 3 AS f FROM events) GROUP BY block HAVING count(*) = 1000")
def block_rates(spark, d):
    """All three rates, over all sessions in one order; a session has two places."""
    events = table(spark, d, "events").select("ts", "event_id", F.array((F.col("event_id") % 3).cast("int"), (F.col("event_id") % 2).cast("int")).alias("clicks"))
    found = sessions.click_blocks(events, ["ts", "event_id"], 1000, Workspace(spark, "blocks"))
    return found.select("block", *[F.round(c, 8).alias(c) for c in ("ctr", "first_rate", "mean_clicks")])


@query(f"WITH {_BLOCKS} SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, ((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) > 1.96)::INTEGER AS rejected FROM (SELECT avg(ctr) AS m, var_pop(ctr) AS v, count(*) AS n FROM bl WHERE arm = 0) a, (SELECT avg(ctr) AS m, var_pop(ctr) AS v, count(*) AS n FROM bl WHERE arm = 1) b")
def one_sided_t(spark, d):
    rows = sessions.click_blocks(_arms(spark, d), ["ts", "event_id"], 100, Workspace(spark, "blocks"), ["arm"]).withColumnRenamed("ctr", "x")
    return stats.t_test(rows.where("arm = 0"), rows.where("arm = 1"), welch=False).select(F.round("t", 6).alias("t"), "rejected")


@query(f"WITH {_BLOCKS} SELECT round(abs(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, (abs(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) > 1.96)::INTEGER AS rejected FROM (SELECT avg(ctr) AS m, var_samp(ctr) AS v, count(*) AS n FROM bl WHERE arm = 0) a, (SELECT avg(ctr) AS m, var_samp(ctr) AS v, count(*) AS n FROM bl WHERE arm = 1) b")
def welch_t(spark, d):
    rows = sessions.click_blocks(_arms(spark, d), ["ts", "event_id"], 100, Workspace(spark, "blocks"), ["arm"]).withColumnRenamed("ctr", "x")
    return stats.t_test(rows.where("arm = 0"), rows.where("arm = 1")).select(F.round("t", 6).alias("t"), "rejected")


_DRAWS = """dr AS (
    SELECT b, arm, ((b * 7919 + j * 104729 + arm * 1299709) * 1103515245 + 12345) % 2147483648 % n AS i
    FROM range(300) r(b), range(50) s(j), nn)"""
_RESAMPLED = f"""WITH {_BLOCKS}, nn AS (SELECT arm, count(*) AS n FROM bl GROUP BY arm), {_DRAWS},
x AS (SELECT b, arm, avg(ctr) AS m, var_samp(ctr) AS v FROM dr JOIN bl USING (arm) WHERE block = i GROUP BY b, arm),
rt AS (SELECT p.b, abs(p.m - q.m) / nullif(sqrt((p.v + q.v) / 50), 0) AS t FROM x p JOIN x q ON p.b = q.b WHERE p.arm = 0 AND q.arm = 1) """


@query(f"{_RESAMPLED} SELECT avg(coalesce((t > 1.0)::INTEGER, 0)) AS share, count(*) AS n FROM rt")
def bootstrap_share(spark, d):
    """The share of resamples that reject, at a limit that some exceed."""
    rows = sessions.click_blocks(_arms(spark, d), ["ts", "event_id"], 100, Workspace(spark, "blocks"), ["arm"]).select("arm", F.col("block").alias("i"), F.col("ctr").alias("x"))
    return stats.rejected_share(stats.bootstrap(Workspace(spark, "bootstrap").save(rows, "arms"), 300, 50), 1.0)


@query(f"{_RESAMPLED} SELECT b, round(t, 6) AS t FROM rt")
def bootstrap_t(spark, d):
    rows = sessions.click_blocks(_arms(spark, d), ["ts", "event_id"], 100, Workspace(spark, "blocks"), ["arm"]).select("arm", F.col("block").alias("i"), F.col("ctr").alias("x"))
    return stats.bootstrap(Workspace(spark, "bootstrap").save(rows, "arms"), 300, 50).select("b", F.round("t", 6).alias("t"))


@query("WITH m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m) SELECT user_id, session::BIGINT AS session, event_type, count(*) AS n, string_agg(DISTINCT event_id::VARCHAR, ',' ORDER BY event_id::VARCHAR) AS events FROM s GROUP BY user_id, session, event_type")
def session_collapse(spark, d):
    got = sessions.collapse_sessions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", {"events": F.col("event_id").cast("string")})
    return got.select("user_id", "session", "event_type", "n", F.array_join("events", ",").alias("events"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(avg((event_type = 'click')::INTEGER), 8) AS ctr FROM events GROUP BY 1")
def windowed_clicks(spark, d):
    return stream.windowed_clicks(table(spark, d, "events")).select("start", "n", F.round("ctr", 8).alias("ctr"))


@query("WITH m AS (SELECT user_id, ts, (coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= 1800, true))::INTEGER AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS end, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    found = stream.sessions(table(spark, d, "events"))
    return found.select("user_id", "start", "end", "n")


@query("SELECT count(*) AS rows, count(*) FILTER (event_type = 'click') AS clicks FROM events")
def progress_counts(spark, d):
    """Counted while the rows are written elsewhere, not by a pass of their own."""
    counts = stats.observed(table(spark, d, "events"), {"rows": F.count(F.lit(1)), "clicks": F.count_if(F.col("event_type") == "click")}, lambda df: Workspace(spark, "observed").save(df, "events"))
    return spark.createDataFrame([(counts["rows"], counts["clicks"])], "rows long, clicks long")


@query("SELECT p_partkey, p_name, p_type FROM part")
def prefixed_columns(spark, d):
    from loamix.sources import readers

    return readers.prefixed(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("x_name"), "p_size", F.col("p_type").alias("x_type")), "x_", "p_partkey").toDF("p_partkey", "p_name", "p_type")


_PRED = "p AS (SELECT quality AS label, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id)), c AS (SELECT class, count(*) FILTER (label = class AND pred = class) AS tp, count(*) FILTER (pred = class) AS said, count(*) FILTER (label = class) AS support FROM p, (SELECT 0 AS class UNION ALL SELECT 1) GROUP BY class), m AS (SELECT class::VARCHAR AS class, coalesce(tp / nullif(said, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall, support FROM c), f AS (SELECT class, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM m)"


@query(f"WITH {_PRED}, r AS (SELECT * FROM f UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM f UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f) SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support::BIGINT AS support FROM r")
def class_report(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("pred"))
    return stats.class_report(rows).select("class", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("SELECT round(sum(abs(l_quantity - m)), 4) AS l1, round(sqrt(sum((l_quantity - m) * (l_quantity - m))), 4) AS l2 FROM lineitem, (SELECT median(l_quantity) AS m FROM lineitem)")
def error_norms(spark, d):
    rows = table(spark, d, "lineitem")
    median = F.broadcast(rows.agg(F.median("l_quantity").alias("pred")))
    return stats.error_norms(rows.select(F.col("l_quantity").alias("y")).crossJoin(median)).select(F.round("l1", 4).alias("l1"), F.round("l2", 4).alias("l2"))


# ---- exports ---------------------------------------------------------------------------------------------------

_DICT = "dict AS (SELECT grp AS \"group\", value, (row_number() OVER (ORDER BY grp, value) + 14)::INTEGER AS idx FROM (SELECT DISTINCT 'name' AS grp, unnest(string_split(p_name, ' ')) AS value FROM part UNION SELECT DISTINCT 'type', p_type FROM part))"


def _groups():
    return {"name": F.split("p_name", " "), "type": F.array("p_type")}


@query(f"WITH {_DICT} SELECT * FROM dict")
def cat_dictionary(spark, d):
    return writers.category_dictionary(table(spark, d, "part"), _groups(), Workspace(spark, "dictionary"))


@query(f"WITH {_DICT}, ids AS (SELECT p_partkey, string_agg(idx || ':1', ' ' ORDER BY idx) AS tail FROM (SELECT DISTINCT p_partkey, idx FROM (SELECT p_partkey, 'name' AS g, unnest(string_split(p_name, ' ')) AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part) x JOIN dict ON dict.\"group\" = g AND dict.value = x.value) GROUP BY p_partkey) SELECT p_partkey, p_partkey % 2 || ' 1:' || p_size || ' ' || tail AS line FROM part JOIN ids USING (p_partkey)")
def libsvm_rows(spark, d):
    return writers.libsvm_rows(table(spark, d, "part"), "p_partkey", F.col("p_partkey") % 2, [F.col("p_size")], _groups(), Workspace(spark, "libsvm"))


@query("SELECT p_partkey, p_partkey % 2 || ' ' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: 'name_' || x || ':1'), ' ') || ' type_' || p_type || ':1' AS line FROM part")
def sparse_rows(spark, d):
    return table(spark, d, "part").select("p_partkey", writers.sparse_line(F.col("p_partkey") % 2, _groups()).alias("line"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '-1' ELSE '1' END || ' |n 1:' || p_size || ' c2_' || replace(p_name, ' ', '') AS line FROM part")
def vw_rows(spark, d):
    fields = [(F.col("p_partkey") % 2).cast("string"), F.col("p_size").cast("string"), F.col("p_name")]
    return table(spark, d, "part").select("p_partkey", writers.vw_line(fields, convert_zeros=True).alias("line"))


@query("SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey)::INTEGER AS \"Id\", s_suppkey AS \"Target\" FROM supplier")
def submission_rows(spark, d):
    return writers.submission(table(spark, d, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")], {"Target": F.col("s_suppkey")}, Workspace(spark, "submission"))


@query("SELECT id FROM ((SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def set_ops(spark, d):
    """Union, intersection and difference, none of them empty."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    some = orders.select(F.col("o_custkey").alias("id")).union(customers.where("id % 2 = 0")).distinct()
    known = some.intersect(customers.where("id % 3 <> 0"))
    return known.join(orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id")), "id", "left_anti")


# The other catalogs register their queries too.
from loamix.plans import io, models, retrieval  # noqa: E402, F401
