"""Queries of trees, boosting and models. Trees of a fixed depth have SQL: one group of CTEs for each level."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamix.functions import text as X
from loamix.operators import ltr, ml, ranking, trees
from loamix.plans.base import query, table
from loamix.plans.shared import Workspace

# ---- SQL of trees ----------------------------------------------------------------------------------------------


def _level_sql(name: str, rows: str, features: list[str], penalty: str | None = None) -> list[str]:
    """CTEs: ``name``b (node, feature, threshold, error), the best split of each node of ``rows`` (node, features, y)."""
    cells = " UNION ALL ".join(f"SELECT node, {i} AS feature, {f} AS x, y FROM {rows}" for i, f in enumerate(features))
    if penalty is None:
        error = "ql - sl * sl / nl + (qt - ql) - (st - sl) * (st - sl) / (nt - nl)"
        good = "WHERE error < qt - st * st / nt - 1e-12"
    else:
        error = f"-(sl * sl / (nl + {penalty}) + (st - sl) * (st - sl) / (nt - nl + {penalty}) - st * st / (nt + {penalty}) - {penalty})"
        good = ""
    return [
        f"""{name}v AS (
            SELECT node, feature, x, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q
            FROM ({cells}) GROUP BY ALL)""",
        f"""{name}c AS (
            SELECT node, feature, x, lead(x) OVER r AS nx, sum(n) OVER r AS nl, sum(s) OVER r AS sl, sum(q) OVER r AS ql,
                sum(n) OVER p AS nt, sum(s) OVER p AS st, sum(q) OVER p AS qt
            FROM {name}v
            WINDOW r AS (PARTITION BY node, feature ORDER BY x), p AS (PARTITION BY node, feature))""",
        f"""{name}b AS MATERIALIZED (
            SELECT node, feature, threshold, error
            FROM (
                SELECT *, row_number() OVER (PARTITION BY node ORDER BY error, feature, threshold) AS place
                FROM (SELECT node, feature, (x + nx) / 2 AS threshold, round({error}, 9) AS error, qt, st, nt FROM {name}c WHERE nx IS NOT NULL)
            )
            {good or 'WHERE true'} AND place = 1)""",
    ]


def _split_sql(rows: str, splits: str, features: list[str]) -> str:
    """``rows`` moved to the children of their nodes."""
    value = "CASE feature " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(features)) + " END"
    return f"""
        SELECT r.* EXCLUDE (node), CASE WHEN feature IS NULL THEN r.node WHEN {value} <= threshold THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node
        FROM {rows} r LEFT JOIN {splits} s ON r.node = s.node"""


def _tree_sql(name: str, rows: str, features: list[str], depth: int, penalty: str | None = None) -> list[str]:
    """CTEs that end with ``name``t: ``rows`` (features, y, ..) with the leaf as ``node``."""
    out, now = [f"{name}r0 AS MATERIALIZED (SELECT *, 0 AS node FROM {rows})"], f"{name}r0"
    for level in range(depth):
        out += _level_sql(f"{name}{level}", now, features, penalty)
        out.append(f"{name}r{level + 1} AS MATERIALIZED ({_split_sql(now, f'{name}{level}b', features)})")
        now = f"{name}r{level + 1}"
    if penalty is None:
        out.append(f"{name}t AS MATERIALIZED (SELECT * FROM {now})")
        return out
    # Depth two: splits of leaves with a negative gain go, then the first if nothing is left below it.
    assert depth == 2
    out.append(f"{name}p1 AS (SELECT * FROM {name}1b WHERE error <= 0)")
    out.append(f"{name}p0 AS (SELECT * FROM {name}0b WHERE error <= 0 OR EXISTS (SELECT 1 FROM {name}p1))")
    out.append(f"{name}q1 AS MATERIALIZED ({_split_sql(f'{name}r0', f'{name}p0', features)})")
    out.append(f"{name}t AS MATERIALIZED ({_split_sql(f'{name}q1', f'{name}p1', features)})")
    return out


_PART = "base AS (SELECT p_partkey AS row_id, p_size::DOUBLE AS f0, (p_partkey % 97)::DOUBLE AS f1, p_retailprice AS y FROM part)"
_F = ["f0", "f1"]


def _boost_sql(rounds: int, start: str, gradient: str, leaf: str, penalty: str | None = None) -> str:
    """CTEs s0 .. s<rounds>: (row_id, f0, f1, label, score) after each tree of depth two, with rate 0.1."""
    out = [_PART, f"s0 AS MATERIALIZED (SELECT row_id, f0, f1, y AS label, (SELECT {start} FROM base)::DOUBLE AS score FROM base)"]
    for k in range(rounds):
        out.append(f"g{k} AS MATERIALIZED (SELECT row_id, f0, f1, label, score, {gradient} AS y FROM s{k})")
        out += _tree_sql(f"t{k}_", f"g{k}", _F, 2, penalty)
        out.append(f"v{k} AS (SELECT node, {leaf} AS value FROM t{k}_t GROUP BY node)")
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT row_id, f0, f1, label, score + 0.1::DOUBLE * value AS score FROM t{k}_t JOIN v{k} USING (node))")
    return "WITH " + ", ".join(out)


def _parts(spark, d):
    features = F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 97).cast("double"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), features.alias("features"), F.col("p_retailprice").alias("y"))


# ---- splits and trees ------------------------------------------------------------------------------------------


def _one_split(value: str, penalty: str | None = None) -> str:
    rows = f"{_PART}, r AS (SELECT *, 0 AS node FROM base)"
    return f"WITH {rows}, {', '.join(_level_sql('a', 'r', _F, penalty))} SELECT feature, threshold, {value} FROM ab"


@query(_one_split("round(error, 2) AS error"))
def best_split(spark, d):
    found = trees.best_splits(_parts(spark, d).withColumn("node", F.lit(0)), Workspace(spark, "split"))
    return found.select("feature", "threshold", F.round("error", 2).alias("error"))


@query(_one_split("round(-error, 2) AS gain", "0.1::DOUBLE"))
def second_order_split(spark, d):
    found = trees.best_splits(_parts(spark, d).withColumn("node", F.lit(0)), Workspace(spark, "split"), 0.1, 0.1)
    return found.select("feature", "threshold", F.round(-F.col("error"), 2).alias("gain"))


@query(f"WITH {_PART}, {', '.join(_tree_sql('c', 'base', _F, 3))} SELECT row_id, node AS leaf, round(avg(y) OVER (PARTITION BY node), 6) AS pred FROM ct")
def cart_depth3(spark, d):
    rows = _parts(spark, d)
    tree = trees.grow(rows, Workspace(spark, "cart"), 3)
    return rows.select("row_id", tree.node().alias("leaf"), F.round(tree.predict(), 6).alias("pred"))


_LAD = _boost_sql(2, "median(y)", "sign(label - score)::DOUBLE", "median(label - score)")


@query(f"{_LAD} SELECT row_id, label AS y, round(score, 6) AS pred FROM s2")
def lad_rounds(spark, d):
    _, scored = trees.boost_lad(_parts(spark, d), Workspace(spark, "lad"), 2, 2)
    return scored.select("row_id", "y", F.round("score", 6).alias("pred"))


@query(f"{_LAD} " + " UNION ALL ".join(f"SELECT row_id, {k} AS stage, round(score, 6) AS score FROM s{k}" for k in range(3)))
def lad_staged(spark, d):
    """Scores after each tree, from a model that was saved and loaded."""
    rows, work = _parts(spark, d), Workspace(spark, "staged")
    model, _ = trees.boost_lad(rows, work, 2, 2)
    model.save(spark, work.at("model"))
    found = trees.Ensemble.load(spark, work.at("model")).staged(rows)
    return found.select("row_id", "stage", F.round("score", 6).alias("score"))


_SECOND = _boost_sql(2, "avg(y)", "score - label", "-sum(y) / (count(*) + 0.1::DOUBLE)", "0.1::DOUBLE")


@query(f"{_SECOND} SELECT row_id, label AS y, round(score, 6) AS pred FROM s2")
def second_order_rounds(spark, d):
    _, scored = trees.boost_second_order(_parts(spark, d), Workspace(spark, "newton"), 2, 2)
    return scored.select("row_id", "y", F.round("score", 6).alias("pred"))


def _lambda_sql(k: int) -> list[str]:
    """CTEs: g<k>, lambda gradients y and weights w of the rows of s<k>."""
    return [
        f"""k{k} AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, idx DESC) - 1 AS pos,
                row_number() OVER (PARTITION BY qid ORDER BY y DESC, idx DESC) - 1 AS ipos
            FROM s{k})""",
        f"i{k} AS (SELECT qid, sum((pow(2, y) - 1) / log2(ipos + 2)) AS idcg FROM k{k} GROUP BY qid)",
        f"""p{k} AS MATERIALIZED (
            SELECT a.qid, a.idx AS i, b.idx AS j, 1 / (1 + exp(a.s - b.s)) AS rho,
                abs((pow(2, a.y) - pow(2, b.y)) * (1 / log2(a.pos + 2) - 1 / log2(b.pos + 2))) / idcg AS delta
            FROM k{k} a JOIN k{k} b ON a.qid = b.qid AND a.y > b.y JOIN i{k} x ON x.qid = a.qid WHERE idcg > 0)""",
        f"""l{k} AS MATERIALIZED (
            SELECT qid, idx, sum(l) AS lam, sum(w) AS w
            FROM (SELECT qid, i AS idx, delta * rho AS l, delta * rho * (1 - rho) AS w FROM p{k}
                  UNION ALL SELECT qid, j, -delta * rho, delta * rho * (1 - rho) FROM p{k})
            GROUP BY qid, idx)""",
        f"g{k} AS MATERIALIZED (SELECT r.qid, r.idx, r.label, f0, f1, f2, s, coalesce(lam, 0) AS y, coalesce(w, 0) AS w FROM (SELECT *, y AS label FROM s{k}) r LEFT JOIN l{k} USING (qid, idx))",
    ]


def _lambdamart_sql(rounds: int) -> str:
    out = [
        """s0 AS MATERIALIZED (
            SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INTEGER AS idx,
                floor(l_quantity / 11)::INTEGER AS y, l_extendedprice AS f0, l_discount AS f1, l_tax AS f2, 0.0::DOUBLE AS s
            FROM lineitem)"""
    ]
    for k in range(rounds):
        out += _lambda_sql(k)
        out += _tree_sql(f"t{k}_", f"g{k}", ["f0", "f1", "f2"], 2)
        out.append(f"v{k} AS (SELECT node, coalesce(sum(y) / nullif(sum(w), 0), 0) AS value FROM t{k}_t GROUP BY node)")
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT qid, idx, label AS y, f0, f1, f2, s + value AS s FROM t{k}_t JOIN v{k} USING (node))")
    return "WITH " + ", ".join(out) + f" SELECT qid, idx, y, round(s, 6) AS score FROM s{rounds}"


def _ltr_features(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    features = F.array("l_extendedprice", "l_discount", "l_tax")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.row_number().over(w).alias("idx"), F.floor(F.col("l_quantity") / 11).cast("int").alias("y"), features.alias("features"))


@query(_lambdamart_sql(2))
def lambdamart_rounds(spark, d):
    """Two trees on lambda gradients with Newton leaves; features are price, discount and tax. The second goes on with the saved first."""
    work = Workspace(spark, "lambdamart")
    rows = work.save(_ltr_features(spark, d), "rows")
    ltr.lambdamart(rows, work, 1, 2, keep=work.at("model"))
    _, scored = ltr.lambdamart(rows, work, 1, 2, model=trees.Ensemble.load(spark, work.at("model")))
    return scored.select("qid", "idx", "y", F.round("s", 6).alias("score"))


@query()
def lambdamart_half_samples(spark, d):
    """Each tree learns from half of the rows."""
    work = Workspace(spark, "lambdamart-half")
    model, scored = ltr.lambdamart(work.save(_ltr_features(spark, d), "rows"), work, 2, 2, rate=0.5, share=0.5)
    return scored.select("qid", "idx", "y", F.round("s", 6).alias("score"), F.round(model.predict(1), 6).alias("first"))


# ---- features --------------------------------------------------------------------------------------------------


@query(
    """WITH e AS (
        SELECT o_orderkey AS row_id, 'status=' || o_orderstatus AS name, 1.0::DOUBLE AS value FROM orders
        UNION ALL SELECT o_orderkey, 'priority=' || o_orderpriority, 1.0 FROM orders WHERE o_orderpriority IS NOT NULL
        UNION ALL SELECT o_orderkey, 'price', o_totalprice FROM orders
    ), n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS col FROM (SELECT DISTINCT name FROM e))
    SELECT row_id, col, value FROM e JOIN n USING (name)"""
)
def one_hot_entries(spark, d):
    """Entries of the matrix of feature dictionaries: texts become columns of their own, numbers keep their name."""
    orders = table(spark, d, "orders")
    words = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    numbers = F.create_map(F.lit("price"), F.col("o_totalprice"))
    rows = orders.select(F.col("o_orderkey").alias("row_id"), words.alias("words"), numbers.alias("numbers"))
    return ml.one_hot(rows, Workspace(spark, "one-hot"))


@query("SELECT o_orderkey AS id, ('0x' || substr(md5(o_orderkey || ':42'), 1, 8))::BIGINT % 100 < 33 AS test FROM orders")
def hash_split(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return rows.withColumn("test", ml.in_test(F.col("id"), 33, 42))


# ---- models, no SQL form ---------------------------------------------------------------------------------------


@query()
def gbt_active(spark, d):
    rows = ml.vectors(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", F.col("p_retailprice").alias("y")), ["p_size"])
    return ml.query_uncertain(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), trees=5)


@query()
def gbt_active_epochs(spark, d):
    """Two epochs: what the first asks for is known in the second."""
    rows = ml.vectors(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", F.col("p_retailprice").alias("y")), ["p_size"])
    return ml.active_epochs(rows.where("id % 20 = 0"), rows.where("id % 20 <> 0"), 2, Workspace(spark, "active"), trees=3)


def _conversation_words(spark, d):
    return table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), X.letters(F.col("text")).alias("words"))


@query()
def word2vec_docs(spark, d):
    return ml.document_vectors(_conversation_words(spark, d)).select("doc_id", "vector")


@query()
def word2vec_knn(spark, d):
    """The nearest turns of each first turn, by the mean of their words' vectors."""
    vectors = Workspace(spark, "vectors").save(ml.document_vectors(_conversation_words(spark, d)).select(F.col("doc_id").alias("vec_id"), "vector"), "vectors")
    queries = vectors.where(F.substring_index("vec_id", ":", -1) == "0").select(F.col("vec_id").alias("qid"), F.col("vector").alias("q"))
    return ranking.knn(vectors, queries, 5, "vector").select("qid", "doc_id", "score", "rank")


@query()
def classifier_comparison(spark, d):
    columns = ["l_quantity", "l_discount", "l_tax"]
    rows = ml.vectors(table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), *columns, "l_orderkey"), columns)
    got = ml.compare_classifiers(rows.where("l_orderkey % 3 <> 0"), rows.where("l_orderkey % 3 = 0"), Workspace(spark, "classifiers"))
    return got.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 6).alias("accuracy"))


@query()
def pca_2d(spark, d):
    return ml.pca(ml.vectors(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])).select("p_partkey", "pca")
