"""TF-IDF in which each query's candidates are a corpus of their own, with one compact shuffle of the terms.

Queries with the same candidates share a corpus. The terms of a document are counted where it is read and go to buckets by corpus and term as arrays;
a bucket has all documents of its terms, so that it knows their frequencies and needs to send on sums by document only. In the buckets terms are told
apart by 64-bit hashes, corpora by the number of their documents and two 64-bit hashes of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.operators.scan import Part, one_row_each, small_batches
from loamix.plans.shared import Workspace, broadcast_if_small

#: Words that a bucket has at most, as far as they are spread evenly; bytes of documents that a worker counts at a time.
BUCKET, LOT = 1 << 21, 4 << 20


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _record(corpus, bucket, asks, ids, kind, runs, hashes, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(corpus, pa.int32()), pa.array(bucket, pa.int32()), pa.array(asks, pa.bool_()), pa.array(ids, pa.list_(kind)), pa.array(runs, pa.binary()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())],
        ["corpus", "bucket", "asks", "ids", "runs", "hashes", "counts"],
    )


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to LOT bytes; the smaller the lots, the more rows are sent."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= LOT:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _sent(columns: list[str], key: str, buckets: int, asks: bool):
    """A function of batches (key, corpora, lists of words): a row for each corpus and bucket with its documents, terms and counts by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lots(batches):
            lists = [batch.column(c) for c in columns]
            coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            ids, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            if not width:
                continue
            rows = np.concatenate([np.repeat(np.arange(len(batch)), np.diff(x.offsets.to_numpy())) for x in lists])
            pairs, at = np.unique(rows * width + ids, return_inverse=True)
            ends = np.cumsum([len(x.flatten()) for x in lists])
            counts = np.stack([np.bincount(part, minlength=len(pairs)) for part in np.split(at, ends[:-1])]).astype(np.uint32)
            row, term = np.divmod(pairs, width)
            corpora = batch.column("corpora")
            first, own = corpora.offsets.to_numpy() - corpora.offsets[0].as_py(), corpora.flatten().to_numpy(zero_copy_only=False)
            many = np.diff(first)[row]
            entry = np.repeat(np.arange(len(pairs)), many)
            if not len(entry):
                continue
            corpus = own[first[row[entry]] + np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)]
            hashes = _hashes(coded.dictionary)[term[entry]]
            bucket = ((hashes >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((row[entry], bucket, corpus))
            corpus, bucket, hashes, entry = corpus[order], bucket[order], hashes[order], entry[order]
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(corpus) != 0) | (np.diff(bucket) != 0)]))
            keys, out = batch.column(key).to_pylist(), ([], [], [], [], [], [], [])
            for lo, hi in zip(starts, [*starts[1:], len(entry)]):
                own_rows, sizes = np.unique(row[entry[lo:hi]], return_counts=True)
                values = (corpus[lo], bucket[lo], asks, [keys[i] for i in own_rows], sizes.astype(np.uint32).tobytes(), hashes[lo:hi].tobytes(), counts[:, entry[lo:hi]].tobytes())
                for column, value in zip(out, values):
                    column.append(value)
            corpus_, bucket_, asks_, ids_, runs_, hashes_, counts_ = out
            yield _record(corpus_, bucket_, asks_, ids_, batch.column(key).type, runs_, hashes_, counts_)

    return run


def _weighed(sizes: dict[int, list[int]], names: list[str]):
    """A function of a bucket: sums of squared weights by document (query null) and sums of weights by query and document, of each field."""

    def entries(rows: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        ids, runs, hashes, counts = [], [], [], []
        for i, r, h, c in zip(*(rows.column(x).to_pylist() for x in ("ids", "runs", "hashes", "counts"))):
            ids += i
            runs.append(np.frombuffer(r, np.uint32))
            hashes.append(np.frombuffer(h, np.uint64))
            counts.append(np.frombuffer(c, np.uint32).reshape(-1, len(hashes[-1])))
        return ids, np.repeat(np.arange(len(ids)), np.concatenate(runs)), np.concatenate(hashes), np.concatenate(counts, axis=1)

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks()
        kinds = table.schema.field("ids").type.value_type
        blocks = []
        corpus = table.column("corpus")[0].as_py()
        own = table.filter(pc.invert(asks))
        if own.num_rows:
            ids, doc, hashes, counts = entries(own)
            terms, term = np.unique(hashes, return_inverse=True)

            def weights(i: int) -> np.ndarray:
                f, has = counts[i], counts[i] > 0
                df, w = np.bincount(term, weights=has, minlength=len(terms)), np.zeros(len(f))
                w[has] = f[has] * np.log2(sizes[corpus][i] / df[term[has]])
                return w

            squares = (np.square(weights(i)) for i in range(len(counts)))
            blocks.append(([None] * len(ids), ids, [np.bincount(doc, weights=w, minlength=len(ids)) for w in squares]))
            wanted = table.filter(asks)
            if wanted.num_rows:
                qids, asked, ask_hashes, _ = entries(wanted)
                at = np.minimum(np.searchsorted(terms, ask_hashes), len(terms) - 1)
                found = terms[at] == ask_hashes
                asked, at = asked[found], at[found]
                order = np.argsort(at, kind="stable")
                asked, at = asked[order], at[order]
                lo, hi = np.searchsorted(at, term, "left"), np.searchsorted(at, term, "right")
                entry = np.repeat(np.arange(len(term)), hi - lo)
                if len(entry):
                    query = asked[lo[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
                    pairs, pair = np.unique(query * len(ids) + doc[entry], return_inverse=True)
                    sums = []
                    for i, f in enumerate(counts):
                        some = np.bincount(pair, weights=f[entry] > 0, minlength=len(pairs)) > 0
                        sums.append(pa.array(np.bincount(pair, weights=weights(i)[entry], minlength=len(pairs)), mask=~some))
                    blocks.append(([qids[i] for i in pairs // len(ids)], [ids[i] for i in pairs % len(ids)], sums))
        parts = [pa.table([pa.array([corpus] * len(i), pa.int32()), pa.array(q, kinds), pa.array(i, kinds), *[pa.array(v) for v in values]], ["corpus", "q", "id", *names]) for q, i, values in blocks]
        if parts:
            return pa.concat_tables(parts)
        return pa.table([pa.array([], pa.int32()), pa.array([], kinds), pa.array([], kinds), *[pa.array([], pa.float64()) for _ in names]], ["corpus", "q", "id", *names])

    return run


def tfidf_candidates(docs: DataFrame, weights: dict[str, float], queries: DataFrame, candidates: DataFrame, work: Workspace, boosts: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score) of TF-IDF of several fields in which each query's candidates are a corpus of their own.

    ``docs`` (doc_id, <name> ..) texts, ``queries`` (qid, term), ``candidates`` (qid, doc_id). Of each field, document vectors f * log2(N/df) have length
    one, N and df counted over the query's candidates with the field; a document's score is the weighted sum over the query's terms. ``boosts``
    (qid, doc_id, boost) are added.
    """
    parts, key_kind = [Part(n) for n in weights], docs.schema["doc_id"].dataType.simpleString()
    sign = candidates.distinct().groupBy("qid").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("a"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("b"))
    sign = work.save(sign, "signatures")
    corpora = work.save(sign.groupBy("n", "a", "b").agg(F.min("qid").alias("first"), F.collect_list("qid").alias("qids")), "corpora")
    number = {r.first: i for i, r in enumerate(corpora.select("first").orderBy("first").collect())}
    named = docs.sparkSession.createDataFrame(list(number.items()), f"first {candidates.schema['qid'].dataType.simpleString()}, corpus int")
    named = corpora.join(broadcast_if_small(named, 16), "first")
    # A corpus has the candidates of its first query, which are those of each.
    of = candidates.join(broadcast_if_small(named.select(F.col("first").alias("qid"), "corpus"), 16), "qid").groupBy("doc_id").agg(F.collect_set("corpus").alias("corpora"))
    of = work.save(of, "corpora_of_documents")
    rows = one_row_each(docs, parts, "doc_id", work).join(broadcast_if_small(of, 32), "doc_id")
    columns = {n: f"`{p.column()}`" for n, p in zip(weights, parts)}
    total = rows.select(F.explode("corpora").alias("corpus"), *[F.size(c).alias(n) for n, c in columns.items()]).groupBy("corpus")
    total = total.agg(F.sum(sum(F.col(n) for n in weights)).alias("all"), *[F.count_if(F.col(n) > 0).alias(n) for n in weights]).collect()
    sizes = {r.corpus: [r[n] for n in weights] for r in total}
    buckets = max([1, *[-(-r["all"] // BUCKET) for r in total]])
    kind = f"corpus int, bucket int, asks boolean, ids array<{key_kind}>, runs binary, hashes binary, counts binary"
    names = [p.column() for p in parts]
    asked = queries.groupBy("qid").agg(F.collect_set("term").alias("w"))
    asked = asked.join(broadcast_if_small(named.select(F.explode("qids").alias("qid"), F.array("corpus").alias("corpora")), 32), "qid")
    asked = asked.select(F.col("qid").cast(key_kind).alias("doc_id"), "corpora", *[F.col("w").alias(n) for n in names[:1]])
    both = small_batches(rows).mapInArrow(_sent(names, "doc_id", buckets, False), kind).unionByName(asked.mapInArrow(_sent(names[:1], "doc_id", buckets, True), kind))
    sums = [f"v{i}" for i in range(len(names))]
    out = both.groupBy("corpus", "bucket").applyInArrow(_weighed(sizes, sums), f"corpus int, q {key_kind}, id {key_kind}, " + ", ".join(f"{v} double" for v in sums))
    out = work.save(out, "sums")
    norms = out.where("q is null").groupBy("corpus", "id").agg(*[F.sqrt(F.sum(v)).alias(f"n{v}") for v in sums])
    hits = out.where("q is not null").groupBy("corpus", "q", "id").agg(*[F.sum(v).alias(v) for v in sums]).join(norms, ["corpus", "id"])
    part = lambda v, weight: F.when(F.col(v).isNotNull(), weight * F.coalesce(F.try_divide(v, f"n{v}"), F.lit(0.0))).otherwise(0.0)
    score = sum((part(v, w) for v, w in zip(sums, weights.values())), F.lit(0.0))
    found = hits.select(F.col("q").cast(queries.schema["qid"].dataType).alias("qid"), F.col("id").alias("doc_id"), score.alias("part"))
    if boosts is not None:
        found = found.unionByName(boosts.select("qid", "doc_id", F.col("boost").alias("part")))
    return found.groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))
