import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loamix.functions import text as X
from loamix.operators import corpora, graph, ltr, ordering, ranking, scan, sessions, stats, terms, trees
from loamix.plans.shared import Workspace
from loamix.sources import readers, writers
from loamix.sources.collection import ZlibCollection


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_document_frequency(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "B c"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.term: r.df for r in terms.doc_freq(docs).collect()} == {"a": 1, "b": 2, "c": 1}


def test_text_functions(spark):
    rows = spark.createDataFrame([("http://www.x.com/p",), ("http://x.com",), ("http://a_b.com/",), ("not a url",)], "u string")
    assert [r[0] for r in rows.select(X.host(F.col("u"))).collect()] == ["x.com", "x.com", None, None]
    assert one(spark, X.canonical_url(F.col("u")), u="https://www.x.com/a/") == "x.com/a"
    assert one(spark, X.char_ngrams(F.col("u"), 2), u="ab") == ["$a", "ab", "b$"]
    assert one(spark, X.char_ngrams(F.col("u"), 3), u="ab") == ["$$a", "$ab", "ab$", "b$$"]
    assert one(spark, X.hash_trigrams(X.spaces(F.col("u"))), u="ab c") == ["#ab", "ab#", "#c#"]
    assert one(spark, X.fix_layout(F.col("u")), u="ghbdtn") == "привет"
    assert one(spark, X.html_fields(F.col("u")), u="<title>A &amp; b</title><script>x</script><p>c<a href='/d'>e</a></p>").asDict() == {"title": "A & b", "keywords": "", "links": "e", "text": "c", "description": ""}


def test_top_query_per_host(spark):
    clicks = spark.createDataFrame([(q, "http://h/") for q in ("q1", "q2", "q2", "q3", "q3", "q3")], "query string, url string")
    assert sessions.top_query_per_host(clicks).first() == ("h", "q3", 3)
    assert sessions.top_query_per_host(clicks, strict=True).first() == ("h", "q2", 2)


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long")
    ranks = {r.id: r.rank for r in graph.pagerank(edges, Workspace(spark, "t"), 1, dangling=True).collect()}
    assert ranks == pytest.approx({1: 0.144444, 2: 0.286111, 3: 0.569444}, abs=1e-6) and sum(ranks.values()) == pytest.approx(1)
    got = {r.id: (r.hub, r.authority) for r in graph.hits(edges, Workspace(spark, "t"), 1).collect()}
    assert got == {1: (2, 0), 2: (1, 1), 3: (0, 2)}


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([(1, 0, 1, 3.0), (1, 1, 0, 2.0), (1, 2, 2, 1.0)], "qid long, idx int, y int, s double")
    got = ltr.ndcg(rows).first()
    assert (got.dcg, got.idcg, got.ndcg) == pytest.approx((2.5, 3.630930, 0.688529), abs=1e-6)
    assert ltr.lambdas(rows).agg(F.sum("lam")).first()[0] == pytest.approx(0)
    assert [r.y for r in ltr.prepare(spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 5)], "qid long, idx int, y int")).orderBy("idx").collect()] == [1, 2, 1]


def test_trees(spark):
    rows = spark.createDataFrame([(i, [float(i)], y) for i, y in ((1, 0.0), (2, 0.0), (3, 10.0), (4, 10.0))], "row_id long, features array<double>, y double")
    best = trees.best_splits(rows.withColumn("node", F.lit(0)), Workspace(spark, "t")).first()
    assert (best.threshold, best.error) == (2.5, 0)
    tree = trees.grow(rows, Workspace(spark, "t"), 3)
    assert [r[0] for r in rows.orderBy("row_id").select(tree.predict()).collect()] == [0, 0, 10, 10]
    work = Workspace(spark, "t")
    model, scored = trees.boost_second_order(rows, work, 2, 2)
    assert model.start == 5 and len(model.trees) == 2 and scored.count() == 4
    model.save(spark, work.at("model"))
    again = trees.Ensemble.load(spark, work.at("model"))
    assert again == model
    stages = again.staged(rows).where("row_id = 4").orderBy("stage").collect()
    assert [r.stage for r in stages] == [0, 1, 2] and stages[0].score == 5
    assert stages[-1].score == pytest.approx(scored.where("row_id = 4").first().score)
    assert rows.where("row_id = 4").select(again.predict(1)).first()[0] == pytest.approx(stages[1].score)


def test_weak_split_above_strong_ones(spark):
    """Of two features that only count together the first split gains nothing; it stays, since those below it do."""
    rows = spark.createDataFrame([(i, [float(a), float(b)], 10.0 * (a ^ b)) for i, (a, b) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)] * 5)], "row_id long, features array<double>, y double")
    centred = rows.withColumn("y", F.col("y") - 5)
    tree = trees.grow(centred, Workspace(spark, "t"), 2, 0.1, 0.1)
    assert set(tree.splits) == {0, 1, 2} and len({round(x, 6) for x in tree.leaves.values()}) == 2
    flat = trees.grow(centred.withColumn("y", F.lit(0.0)), Workspace(spark, "t"), 2, 0.1, 0.1)
    assert not flat.splits


def test_numbers_and_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    got = ordering.numbered(df, [F.desc("x"), "i"], Workspace(spark, "t"), ["g"]).collect()
    for g in "ab":
        want = [i for _, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))]
        assert [r.i for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == want
        assert sorted(r.place for r in got if r.g == g) == list(range(len(want)))
    assert ordering.numbered(df.limit(0), ["x"], Workspace(spark, "t")).count() == 0
    values = spark.createDataFrame([(g, x, float(x)) for g in "ab" for x in range(0, 50, 1 + (g == "b"))], "g string, x int, n double")
    sums = {(r.g, r.x): (r.next, r.nl, r.nt) for r in ordering.running(values, ["g"], "x", ["n"], Workspace(spark, "t")).collect()}
    assert sums["a", 10] == (11, 55, 1225) and sums["b", 48] == (None, 600, 600) and sums["a", 49][0] is None and sums["b", 0] == (2, 0, 600)


def test_nearest_vectors(spark, monkeypatch):
    monkeypatch.setattr(ranking, "KNN_BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 5), (102, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 7 = 0 or vec_id > 99").selectExpr("vec_id as qid", "embedding as q")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ranking.knn(vectors, asked, 4).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.doc_id
    want = {i: [j for j in sorted(range(60), key=lambda j: (-round(float(u[i] @ u[j]), 6), j)) if j != i][:4] for i in range(0, 60, 7)}
    assert {q: [got[q][k] for k in (1, 2, 3, 4)] for q in want} == want and set(got) == set(want)


def plain_bm25(docs, asked, cut, k1=1.5, b=0.75):
    """(qid, doc_id) -> score of (doc_id, text) and (qid, text)."""
    tf = {}
    for i, text in docs:
        for t in cut(text or ""):
            tf.setdefault(i, Counter())[t] += 1
    df, n = Counter(t for own in tf.values() for t in own), len(tf)
    avgdl = sum(sum(own.values()) for own in tf.values()) / n
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, text in asked:
        for t in set(cut(text)):
            for i, own in tf.items():
                if t in own and i is not None:
                    part = (floor if raw[t] < 0 else raw[t]) * own[t] * (k1 + 1) / (own[t] + k1 * (1 - b + b * sum(own.values()) / avgdl))
                    out[q, i] = out.get((q, i), 0.0) + part
    return out


def plain_grams(n):
    return lambda text: [p[i : i + n] for p in ["$" * (n - 1) + text + "$" * (n - 1)] for i in range(len(p) - n + 1)] if text else []


def plain_top(scores, k):
    out = {}
    for (q, i), s in sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0][1])):
        out.setdefault(q, []).append((i, round(s, 6)))
    return {q: own[:k] for q, own in out.items()}


def scanned(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.qid, []).append((r.doc_id, r.score))
    return out


@pytest.fixture
def scan_rows():
    """Copies, rows of one id, texts that are null, empty or short, pairs of code units, frequent and absent characters."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("aaaaabcde é😀") for _ in range(rng.randrange(1, n)))
    docs = [(i, text(60)) for i in range(70)]
    docs += [(100 + i, docs[3][1]) for i in range(9)] + [(5, text(40)), (6, docs[6][1]), (None, text(30)), (None, text(30)), (200, None), (201, ""), (202, "a"), (203, "\U00020000$z")]
    return docs, [(q, text(25)) for q in range(12)] + [(50, "zzz"), (51, docs[3][1])]


def test_bm25_of_ngrams_without_a_term_table(spark, scan_rows, monkeypatch):
    docs, asked = scan_rows
    rows = spark.createDataFrame(docs, "doc_id long, body string").repartition(5)
    queries = spark.createDataFrame(asked, "qid int, text string")
    for n in (1, 2, 3):
        want = plain_top(plain_bm25(docs, asked, plain_grams(n)), 4)
        for limit, codes, seen in ((None, scan.CODES, scan.SEEN), (900, 1, 1)):  # the second takes turns, and codes without tables
            monkeypatch.setattr(scan, "CODES", codes)
            monkeypatch.setattr(scan, "SEEN", seen)
            got = scanned(scan.bm25_top(rows, [scan.Part("body", n)], queries, 4, Workspace(spark, "t"), limit=limit))
            assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
            assert all([s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6) for q in want)


def most_saved(spark, monkeypatch, name):
    """Most rows of a table that a query saves."""
    import __spark_entry__

    saved, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda *a, **b: saved.append(save(*a, **b)) or saved[-1])
    found = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    rows = found.collect()
    assert len({r.qid for r in rows}) > 10
    return max(x.count() for x in saved)


def test_bigrams_of_bodies_save_no_pairs(spark, monkeypatch):
    """A row for each pair of characters at most, not for each document and pair."""
    assert most_saved(spark, monkeypatch, "bm25_bigrams_body") < 5000


def test_bigrams_of_titles_save_no_pairs(spark, monkeypatch):
    assert most_saved(spark, monkeypatch, "bm25_bigrams_title") < 5000



def test_trigrams_of_bodies_save_no_pairs(spark, monkeypatch):
    assert most_saved(spark, monkeypatch, "bm25_trigrams_body") < 10000



def test_sum_of_normalised_rankings_without_term_tables(spark, scan_rows, monkeypatch):
    docs, asked = scan_rows
    docs = [(i, text, None if text is None else text[::-1] + " ab") for i, text in docs]
    rows = spark.createDataFrame(docs, "doc_id long, title string, body string").repartition(5)
    queries = spark.createDataFrame(asked, "qid int, text string")
    parts = [scan.Part("title", 0, 1.0), scan.Part("title", 2, 0.7), scan.Part("body", 0, 0.5), scan.Part("body", 3, 0.2)]
    want = {}
    for p in parts:
        cut = plain_grams(p.n) if p.n else lambda text: "".join(c if c.isalpha() else " " for c in text.lower()).split()
        own = plain_bm25([(i, title if p.field == "title" else body) for i, title, body in docs], asked, cut)
        for x, s in own.items():
            want[x] = want.get(x, 0.0) + s / max(own.values()) * p.weight
    want = plain_top(want, 4)
    for limit in (None, 900):
        got = scanned(scan.bm25_top(rows, parts, queries, 4, Workspace(spark, "t"), normalise=True, limit=limit))
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
        assert all([s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6) for q in want)
    assert most_saved(spark, monkeypatch, "ensemble_matrix") < 30000



def test_candidates_as_corpora(spark, monkeypatch):
    """Candidates of their own, shared, overlapping and none; many buckets and one; fewer rows are saved than pairs of candidates and terms."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 9))), " ".join(word() for _ in range(20)) if i % 7 else None) for i in range(60)]
    asked = [(q, word()) for q in range(8) for _ in range(5)]
    cands = [(q, i) for q in range(7) for i in range(60) if i % 3 == q % 3 or (q == 6 and i % 2)] + [(5, 999)]
    weights, want = {"a": 1.0, "b": 0.5}, {}
    for q in range(8):
        for c, (name, weight) in enumerate(weights.items()):
            tf = {i: own for x in docs if (q, i := x[0]) in cands and (own := Counter((x[1 + c] or "").split()))}
            df = Counter(t for own in tf.values() for t in own)
            for i, own in tf.items():
                w = {t: f * math.log2(len(tf) / df[t]) for t, f in own.items()}
                norm, hits = math.sqrt(sum(x * x for x in w.values())), {t for p, t in asked if p == q} & set(w)
                if hits:
                    want[q, i] = want.get((q, i), 0.0) + weight * (sum(w[t] for t in hits) / norm if norm else 0.0)
    want[3, 5] = want.get((3, 5), 0.0) + 2.0
    frames = [spark.createDataFrame(x, s) for x, s in ((docs, "doc_id long, a string, b string"), (asked, "qid int, term string"), (cands, "qid int, doc_id long"), ([(3, 5, 2.0)], "qid int, doc_id long, boost double"))]
    for bucket in (corpora.BUCKET, 50):
        monkeypatch.setattr(corpora, "BUCKET", bucket)
        got = corpora.tfidf_candidates(frames[0].repartition(3), weights, frames[1], frames[2], Workspace(spark, "t"), frames[3])
        assert {(r.qid, r.doc_id): r.score for r in got.collect()} == pytest.approx(want)
    monkeypatch.undo()
    assert most_saved(spark, monkeypatch, "tfidf_candidate_fields") < 10000



def test_lambdamart_goes_on_from_a_saved_model(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(q, i, rng.randrange(3), [rng.random(), float(i)]) for q in range(20) for i in range(5)], "qid int, idx int, y int, features array<double>")
    work = Workspace(spark, "t")
    whole, scored = ltr.lambdamart(rows, work, 2, 2, rate=0.5)
    ltr.lambdamart(rows, work, 1, 2, rate=0.5, keep=work.at("model"), every=1)
    again, resumed = ltr.lambdamart(rows, work, 1, 2, model=trees.Ensemble.load(spark, work.at("model")))
    key = lambda df: [r.s for r in df.orderBy("qid", "idx").collect()]
    assert [t.splits for t in again.trees] == [t.splits for t in whole.trees] and key(scored) == pytest.approx(key(resumed))


def test_statistics(spark):
    a, b = (spark.createDataFrame([(float(x),) for x in v], "x double") for v in ((1, 2, 3), (4, 5, 6)))
    got = stats.t_test(a, b).first()
    assert (got.t, got.rejected) == (pytest.approx(3.674235, abs=1e-6), 1)
    one_sided = stats.t_test(a, b, welch=False).first()
    assert (one_sided.t, one_sided.rejected) == (pytest.approx(-4.5, abs=1e-6), 0)
    report = {r["class"]: r for r in stats.class_report(spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, pred int")).collect()}
    assert report["0"].recall == 0.5 and report["1"].precision == 0.5


def test_vw_row(spark):
    fields = [F.col(c) for c in "abcde"]
    assert one(spark, writers.vw_line(fields, convert_zeros=True), a="0", b="0", c="2.5", d="red dog", e="") == "-1 |n 2:2.5 c3_reddog"


def test_zlib_collection(spark, tmp_path):
    texts = ["one", "zwei é", ""]
    parts = [zlib.compress(t.encode()) for t in texts]
    (tmp_path / "docs").write_bytes(b"".join(parts))
    (tmp_path / "docs.idx").write_bytes(struct.pack(f"<{len(parts)}i", *map(len, parts)))
    spark.dataSource.register(ZlibCollection)
    got = spark.read.format("zlib_collection").option("bytes_per_map", "15").load(str(tmp_path)).orderBy("doc_idx").collect()
    assert [r.text for r in got] == texts and [r.csize for r in got] == [len(p) for p in parts]


def test_edge_reader(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n1\t2\nx y\n3 4\n")
    assert sorted(readers.edges(spark, str(tmp_path / "e.txt")).collect()) == [(1, 2), (3, 4)]


def test_readers_of_odd_lines(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2 3\n 4  5 6 \nx 1 2\n7 8\n\n")
    assert sorted(map(tuple, readers.labelled_matrix(spark, [str(tmp_path / "m.txt")], ["a", "b"]).collect())) == [(1, 2, 3), (4, 5, 6)]
    (tmp_path / "d.tsv").write_text("1\ttitle\tbody\n2\n3\t\n")
    assert sorted(map(tuple, readers.documents(spark, str(tmp_path / "d.tsv")).collect())) == [(1, "title", "body"), (2, "", ""), (3, "", "")]
    (tmp_path / "c.tsv").write_text("q\tu\nonly\n")
    assert sorted((r.query, r.url) for r in readers.clicks(spark, str(tmp_path / "c.tsv")).collect()) == [("only", None), ("q", "u")]
    (tmp_path / "s.txt").write_text("0 1 0\n\n1 x\n")
    assert sorted(r.clicks for r in readers.click_sessions(spark, str(tmp_path / "s.txt")).collect() if None not in r.clicks) == [[], [0, 1, 0]]


def test_classifier_comparison_after_observed_metrics(spark):
    from loamix.plans.models import classifier_comparison

    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    found = classifier_comparison(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.model for r in found) == ["adaboost", "boosting", "forest", "svm"]
    assert len({r.n for r in found}) == 1 and all(0.5 < r.accuracy <= 1 for r in found)


def test_sessions_on_streams(spark, tmp_path):
    from loamix.streaming.events import sessions as event_sessions

    rows = spark.createDataFrame([(i % 2, i * i) for i in range(40)], "user_id long, m long").selectExpr("user_id", "timestamp_seconds(m * 60) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    run = event_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("es").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(spark.table("es").collect()) == sorted(event_sessions(rows).collect())


def test_streaming_matches_batch(spark, tmp_path):
    from loamix.streaming.events import windowed_clicks

    rows = spark.createDataFrame([(i, "click" if i % 3 else "view") for i in range(100)], "i long, event_type string").selectExpr("timestamp_seconds(i * 600) as ts", "event_type")
    rows.write.parquet(str(tmp_path / "in"))
    run = windowed_clicks(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(spark.table("w").collect()) == sorted(windowed_clicks(rows).collect())
