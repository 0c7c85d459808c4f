"""Removal of repeated passages with a log-structured fingerprint index.

A window is ``window`` consecutive words. A word of a document goes if a window that covers it also starts in a document with
a smaller id. Windows are indexed by anchors: the least hashed of a window's shingles of ``SHINGLE`` words. Equal
windows have equal anchors at equal places, so only windows with one anchor have to be compared. Neighbouring windows mostly share
their anchor; such a run of windows is a span, fingerprinted by a 128-bit digest of its words.

The index is a list of immutable runs, each sorted by (anchor, span, check), with the least document that has the span. A batch of
documents is fingerprinted, written as a run, and merge-joined with each run so far; a match is verified by ``check``, the second half of
the digest of the words themselves. A span that a smaller document has is removed whole. When there are too many runs they are
merged into one. A batch may hold ids below those of earlier batches: these are then joined with its run. The index lives in a
folder; ``SpanIndex.reopen`` goes on with it in a later session. Last, anchors with several different spans are resolved: the windows of
their spans, each from the least document only, are compared by 128-bit hashes of their words.
Copies thus meet as counts, not as pairs, and all joins are between written tables, so a span, anchor or window that
many documents share is split.

Defined results: a null text has no words. Texts shorter than a window lose nothing. A null id counts as smaller than all
others; rows of one id do not remove each other's words. Repeated rows each get a row. Columns other than id and
text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamix.llm.memory import enter
from loamix.plans.shared import Workspace, broadcast_if_small

SHINGLE, MOST_RUNS = 8, 4
#: Odd multipliers of two rolling hashes modulo 2^64, and of the final mixing.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(32))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the base and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 15, 1 << (n + 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64)]) for b in (base, inverse))
        _powers[base] = have
    return have


class Rolling:
    """Hashes of any runs of words of one document, for each of ``bases``."""

    def __init__(self, words: list[bytes], bases: tuple[int, ...] = BASES):
        self.n, digest = len(words), xxhash.xxh3_64_intdigest
        own = np.fromiter([digest(w) for w in words], np.uint64, self.n)
        self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(own * _power(b, self.n)[0][: self.n], dtype=np.uint64)]) for b in bases]

    def of(self, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of words first .. last - 1."""
        return _mixed((self.sums[which][last] - self.sums[which][first]) * _power(BASES[which], self.n)[1][first])


def spans(words: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(anchor, span, check, first, last): runs of windows first .. last that share the anchor at one place."""
    roll = Rolling(words, BASES[:1])
    count = roll.n - window + 1
    if count <= 0:
        return (np.empty(0, np.int64),) * 5
    at = np.arange(roll.n - SHINGLE + 1)
    values = roll.of(at, at + SHINGLE)
    inside = window - SHINGLE + 1
    place = np.empty(count, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(values, inside)
    for i in range(0, count, 1 << 14):
        place[i : i + (1 << 14)] = view[i : i + (1 << 14)].argmin(axis=1) + np.arange(i, min(count, i + (1 << 14)))
    first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
    last = np.concatenate([first[1:] - 1, [count - 1]])
    anchor = values[place[first]]
    # Runs of windows are equal if their words, the anchor's place and the number of windows are.
    shape = (place[first] - first) * 1_000_003 + (last - first)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, roll.n) + 1)
    starts = ends[first] - 1 - np.fromiter((len(words[i]) for i in first.tolist()), np.int64, len(first))
    digest, places = xxhash.xxh3_128_digest, zip(starts.tolist(), (ends[last + window - 1] - 1).tolist(), shape.tolist(), strict=True)
    halves = np.frombuffer(b"".join(digest(joined[a:b], seed) for a, b, seed in places), np.int64).reshape(-1, 2)
    return anchor.view(np.int64), halves[:, 0], halves[:, 1], first, last


_FIELDS = ("anchor", "span", "check", "size", "firsts")
_SPANS = T.ArrayType(T.StructType([*(T.StructField(n, T.LongType()) for n in _FIELDS[:3]), T.StructField("size", T.IntegerType()), T.StructField("firsts", T.ArrayType(T.IntegerType()))]))


def fingerprints(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, copy, n_words, sha256, spans) for each row; ``copy`` is a hash of the text."""
    kind = T.StructType([docs.schema["doc_id"], docs.schema["copy"], T.StructField("n_words", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("spans", _SPANS)])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts, sums, found, ends, within, places = [], [], [], [0], [np.zeros(1, np.int64)], 0
                for text in part.column(2):
                    words = split(text.as_py())
                    counts.append(len(words))
                    sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    anchor, span, check, first, last = spans(words, window)
                    # A span that a document has several times is one entry with all its places.
                    order = np.lexsort((first, check, span, anchor))
                    anchor, span, check, first, last = (x[order] for x in (anchor, span, check, first, last))
                    new = np.ones(len(order), bool)
                    new[1:] = (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1]) | (check[1:] != check[:-1])
                    starts = np.nonzero(new)[0]
                    within.append(np.append(starts[1:], len(order))[: len(starts)] + places)
                    places += len(order)
                    found.append((anchor[new], span[new], check[new], (last - first)[new], first))
                    ends.append(ends[-1] + len(starts))
                columns = [np.concatenate([f[i] for f in found]) for i in range(5)]
                firsts = pa.ListArray.from_arrays(pa.array(np.concatenate(within).astype(np.int32)), pa.array(columns[4].astype(np.int32)))
                fields = pa.StructArray.from_arrays([*map(pa.array, columns[:3]), pa.array(columns[3].astype(np.int32)), firsts], list(_FIELDS))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(sums), lists], names=["doc_id", "copy", "n_words", "sha256", "spans"])

    return docs.select("doc_id", "copy", "text").mapInArrow(hashed, kind)


KEY = ["anchor", "span", "check"]


def _smaller(least: str, own: str) -> Column:
    """Whether id ``least`` is below id ``own``; null is below all others."""
    return F.coalesce(F.col(least) < F.col(own), F.col(least).isNull() & F.col(own).isNotNull())


def _least(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, least_id): the smallest id of each group of ``keys`` in which ids differ; null is the smallest."""
    found = rows.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull()).alias("none"))
    return found.where("low < high or (none and low is not null)").select(*keys, F.when(~F.col("none"), F.col("low")).alias("least_id"))


class SpanIndex:
    """Sorted immutable runs of (anchor, span, check, least): ``least`` is the smallest (doc_id, copy, size, firsts) with the span.

    The folder of ``work`` holds the index: its runs, the fingerprints of each batch, and the list of those that count.
    """

    def __init__(self, work: Workspace, window: int = 50, most_runs: int = MOST_RUNS):
        self.work, self.window, self.most_runs = work, window, most_runs
        self.runs: list[str] = []
        self.batches: list[str] = []
        self.removed: list[str] = []
        self.serial = 0

    @classmethod
    def reopen(cls, work: Workspace) -> SpanIndex:
        """The index that an earlier session left in the folder of ``work``."""
        state = json.loads(max(work.spark.read.json(work.at("states")).collect(), key=lambda r: r.serial).state)
        index = cls(work, state.pop("window"), state.pop("most_runs"))
        index.__dict__.update(state)
        return index

    def _keep(self) -> None:
        """Write down which tables count; a run that is cut off leaves the last whole state."""
        state = {k: v for k, v in self.__dict__.items() if k != "work"}
        self.work.spark.createDataFrame([(self.serial, json.dumps(state))], "serial long, state string").coalesce(1).write.mode("append").json(self.work.at("states"))

    def _table(self, name: str) -> DataFrame:
        return self.work.spark.read.parquet(self.work.at(name))

    def _named(self, kind: str) -> str:
        self.serial += 1
        return f"{kind}-{self.serial}"

    def _all(self, names: list[str]) -> DataFrame:
        out = self._table(names[0])
        for name in names[1:]:
            out = out.unionByName(self._table(name))
        return out

    def _write(self, rows: DataFrame) -> str:
        name = self._named("run")
        self.work.save(rows.groupBy(*KEY).agg(F.min("least").alias("least")).sortWithinPartitions(*KEY), name)
        return name

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            old, self.runs = self.runs, [self._write(self._all(self.runs))]
            self._keep()
            for name in old:
                self.work.drop(name)

    def _spans(self, batch: str) -> DataFrame:
        return self._table(batch).select("doc_id", "copy", F.explode("spans").alias("s")).select("doc_id", "copy", "s.*")

    def _remove(self, batch: str, run: str) -> None:
        """Note the spans of a batch that a smaller document of a run has."""
        known = self._table(run).select(*KEY, F.col("least.doc_id").alias("least_id"))
        met = self._spans(batch).join(known.hint("merge"), KEY).where(_smaller("least_id", "doc_id"))
        gone = met.select("doc_id", "copy", F.explode("firsts").alias("first"), "size")
        name = self._named("removed")
        self.work.save(gone.select("doc_id", "copy", "first", (F.col("first") + F.col("size")).alias("last")), name)
        self.removed.append(name)

    def _bounds(self, batches: list[str]):
        """(some id is null, smallest id, largest id)"""
        return self._all(batches).agg(F.coalesce(F.max(F.col("doc_id").isNull()), F.lit(False)), F.min("doc_id"), F.max("doc_id")).first()

    def ingest(self, docs: DataFrame) -> None:
        """Add a batch (doc_id, copy, text): its run, and the spans that smaller documents of any batch have."""
        batch = self._named("batch")
        self.work.save(fingerprints(docs, self.window), batch)
        run = self._write(self._spans(batch).select(*KEY, F.struct("doc_id", "copy", "size", "firsts").alias("least")))
        for known in [*self.runs, run]:
            self._remove(batch, known)
        if self.batches:
            null, low, _ = self._bounds([batch])
            for earlier in self.batches:
                high = self._bounds([earlier])[2]
                if high is not None and (null or (low is not None and low < high)):
                    self._remove(earlier, run)
        self.runs.append(run)
        self.batches.append(batch)
        self._keep()
        if len(self.runs) > self.most_runs:
            self.compact()

    def documents(self) -> DataFrame:
        """(doc_id, copy, n_words, sha256) of every row of every batch."""
        return self._all(self.batches).select("doc_id", "copy", "n_words", "sha256")

    def _open(self) -> DataFrame:
        """(doc_id, copy, open): the least documents' spans of anchors that have several different spans."""
        run = self._table(self.runs[0])
        several = self.work.save(run.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "several")
        several = broadcast_if_small(several, 16)
        wide = run.join(several, "anchor", "left_semi")
        spans = wide.select("least.*")
        # Rows of the least id with another text have the span too, and may meet smaller documents in other spans.
        twins = self._all(self.batches).groupBy("doc_id").agg(F.min("copy").alias("a"), F.max("copy").alias("b")).where("a < b").select("doc_id")
        twins = self.work.save(twins, "twins")
        if twins.limit(1).count():
            own = F.col("doc_id").eqNullSafe(F.col("twin"))
            each = self._all(self.batches).join(broadcast_if_small(twins.withColumnRenamed("doc_id", "twin"), 16), own, "left_semi")
            each = each.select("doc_id", "copy", F.explode("spans").alias("s")).select("doc_id", "copy", "s.*")
            known = wide.select(*KEY, F.col("least.doc_id").alias("least_id"), F.col("least.copy").alias("least_copy"))
            more = each.join(known, KEY).where(F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("copy") != F.col("least_copy")))
            spans = spans.unionByName(more.select("doc_id", "copy", "size", "firsts"))
        listed = spans.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("size", "firsts")).alias("open"))
        return self.work.save(listed, "open")

    def resolve(self, docs: DataFrame) -> DataFrame:
        """(doc_id, copy, first, last): all removed runs of windows, after comparing the windows of anchors with several spans."""
        self.compact()
        found = with_text(docs, self._open())
        window = self.window

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    part = batch.slice(start, 64)
                    rows, hashes, places = [], [[], []], []
                    for i, (text, open_) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                        roll = Rolling(split(text.as_py()))
                        at = np.concatenate([np.arange(first, first + x["size"] + 1) for x in open_.as_py() for first in x["firsts"]])
                        at = np.unique(at)
                        for which in (0, 1):
                            hashes[which].append(roll.of(at, at + window, which))
                        rows.append(np.full(len(at), i))
                        places.append(at)
                    if rows:
                        take = pa.array(np.concatenate(rows))
                        w = [pa.array(np.concatenate(h).view(np.int64)) for h in hashes]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *w, pa.array(np.concatenate(places).astype(np.int32))], names=["doc_id", "copy", "w0", "w1", "at"])

        kind = T.StructType([docs.schema["doc_id"], docs.schema["copy"], T.StructField("w0", T.LongType()), T.StructField("w1", T.LongType()), T.StructField("at", T.IntegerType())])
        # The text's hash may come in several rows, with the same windows.
        windows = self.work.save(found.mapInArrow(hashed, kind), "windows")
        hashes = ["w0", "w1"]
        least = self.work.save(_least(windows, hashes), "least")
        seen = windows.join(broadcast_if_small(least, 48), hashes).where(_smaller("least_id", "doc_id"))
        removed = seen.select("doc_id", "copy", F.col("at").alias("first"), F.col("at").alias("last"))
        return removed.unionByName(self._all(self.removed)) if self.removed else removed


def with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, copy, text, ...): ``rows`` (one for each doc_id and copy) with the texts of its documents.

    Documents that are not in ``rows`` are left out before the shuffle if the ids are few.
    """
    ids = rows.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c"))
    texts = docs.join(broadcast_if_small(ids, 32), same, "left_semi")
    others = [c for c in rows.columns if c not in ("doc_id", "copy")]
    renamed = rows.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), *others)
    return texts.join(renamed, same).select("doc_id", "copy", "text", *others)


def remove_repeats(docs: DataFrame, work: Workspace, window: int = 50, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for every row; ``spans`` lists the removed (first word, end)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))
    # Bounds between batches; the batches together are all documents.
    bounds = own.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    bounds = sorted(set(bounds or []))
    index = SpanIndex(work, window)
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = own
        if low is not None:
            part = part.where(F.col("doc_id") > F.lit(low))
        if high is not None:
            part = part.where(F.col("doc_id").isNull() | (F.col("doc_id") <= F.lit(high)) if low is None else F.col("doc_id") <= F.lit(high))
        index.ingest(part)
    removed = index.resolve(own)
    cuts = work.save(removed.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("first", "last")).alias("cuts")), "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, out = [], [], []
            for text, cuts in zip(batch.column(2), batch.column(3), strict=True):
                words = split(text.as_py())
                change = np.zeros(len(words) + 1, np.int64)
                for x in cuts.as_py():
                    change[x["first"]] += 1
                    change[x["last"] + window] -= 1
                gone = np.cumsum(change)[:-1] > 0
                edges = np.nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))[0]
                counts.append(int(gone.sum()))
                sums.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
                out.append([{"first": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(out, kind)], names=["d", "c", "n_removed", "kept_sha256", "spans"])

    kind = T.StructType([T.StructField("d", own.schema["doc_id"].dataType), T.StructField("c", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    changed = work.save(with_text(own, cuts).mapInArrow(cut, kind).dropDuplicates(["d", "c"]), "changed")
    info = index.documents()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c"))
    joined = info.join(changed, same, "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), F.coalesce("spans", F.expr("cast(array() as array<struct<first:int,end:int>>)")).alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "op2"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM p),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS q FROM rep),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
}
