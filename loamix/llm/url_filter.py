"""URL filtering by host-suffix and path-prefix rules, in DataFrame functions only.

Every URL is expanded into (host suffix, path prefix) expressions of the shapes that the rules have, the
expressions meet the rules in an equi-join on the first 32 bits of their SHA-256, the full digest confirms
a match, and the most specific rule decides.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the default
verdict. Repeated rows each get a row; null ids stay null. Of rules that fit, the one with the longest text wins, then
the one with the longer host, then block over allow. An empty rule table gives every URL the default
verdict; an empty page table gives no rows. Columns other than the id and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamix.plans.shared import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column, as the module's text defines them."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(authority) + 1), r"^[^?#]*", 0)
    return F.translate(authority, UPPER, LOWER), path


def _digest(host: str, path: str) -> str:
    return f"sha2(concat({host}, '\\n', {path}), 256)"


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    keyed = rules.select(
        F.expr(_digest("rule_host", "rule_path")).alias("rule_digest"),
        F.concat("rule_host", "rule_path").alias("rule"),
        "rule_verdict",
        F.struct(F.length(F.concat("rule_host", "rule_path")).alias("text"), F.length("rule_host").alias("host"), (F.col("rule_verdict") == "block").cast("int").alias("block"), F.concat("rule_host", "rule_path").alias("rule")).alias("rank"),
    ).withColumn("key", F.left("rule_digest", F.lit(8)))
    # Shapes: numbers of labels and path lengths in the rules. There are no more than labels x lengths that URLs can have, however many rules there are.
    shapes = rules.select((F.length("rule_host") - F.length(F.replace("rule_host", F.lit("."), F.lit(""))) + 1).alias("l"), F.length("rule_path").alias("p")).distinct().collect()
    found = None
    if shapes:
        wanted = "array(" + ", ".join(f"named_struct('l', {s.l}, 'p', {s.p})" for s in sorted(shapes)) + ")"
        host, path = split_url(F.col("url"))
        urls = own.select("url").where("url is not null").distinct().select("url", host.alias("host"), path.alias("path"))
        urls = urls.withColumn("labels", F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1)
        each = urls.select("url", F.explode(F.expr(f"transform(filter({wanted}, s -> labels >= s.l and length(path) >= s.p), s -> {_digest("substring_index(host, '.', -s.l)", 'substr(path, 1, s.p)')})")).alias("digest"))
        each = each.withColumn("key", F.left("digest", F.lit(8)))
        met = each.join(broadcast_if_small(keyed, 512), "key").where(F.col("digest") == F.col("rule_digest"))
        found = met.groupBy("url").agg(F.max(F.struct("rank", "rule", F.col("rule_verdict").alias("verdict"))).alias("best")).select("url", "best.rule", "best.verdict")
    joined = own.join(found, "url", "left") if found is not None else own.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    host, path = split_url(F.coalesce("url", F.lit("")))
    return joined.select(F.col("id").alias(id_col), host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark))


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = {
    "op10_url_filter": f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULE_ROWS}),
cut AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
fit AS (SELECT rid, rh || rp AS rule, rv, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS n
        FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fit WHERE n = 1) USING (rid)"""
}
