"""SimHash fingerprints, and groups of fingerprints within a Hamming distance, found by Golay-code keys.

A fingerprint is cut into segments of at most 23 bits. The perfect binary Golay code assigns every 23-bit
word the one codeword within distance 3. The codewords of all words at most one bit from a segment are
its keys (one or six for a full segment): two segments that differ in two bits or fewer share a key,
since a word half-way between them is one bit from both. A bucket is named by some segments taken exactly and
some by key; by the pigeonhole principle two fingerprints within the distance share a bucket.

Equal fingerprints are merged first, so a group of copies is one node. Inside a bucket, distances are
computed block against block and only a minimum spanning forest of the close pairs leaves the task: as many edges as
members, never all pairs. Buckets of any size are handled, large ones as pairs of blocks on different tasks.

Defined results: a null text has no words; a text with no words has fingerprint zero and links like any
other. Repeated rows each get a row. A null id sorts below all ids but never labels a group that has another id.
Columns other than the id and the text are not read. An empty table gives no rows.

Documents that are similar by their sets of shingles are found apart from this, by the shingles of their prefixes in one order of all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamix.llm.components import components
from loamix.llm.memory import enter, remembers
from loamix.llm.substrings import BASES, Rolling
from loamix.plans.shared import Workspace, broadcast_if_small, partitions

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the perfect (23, 12) Golay code.
GENERATOR, CODE_BITS, DATA_BITS = 0b110001110101, 23, 12
#: Members of a bucket that one task compares; larger buckets are dealt out as pairs of blocks.
BLOCK = 512


@dataclass(frozen=True)
class Scheme:
    """How fingerprints are cut: segments as (first bit, width), and buckets as (segments exact, segments by key)."""

    segments: tuple[tuple[int, int], ...]
    buckets: tuple[tuple[tuple[int, ...], tuple[int, ...]], ...]
    distance: int


#: Two differing bits over three segments leave one segment untouched and two bits at most in the next.
WITHIN_2 = Scheme(((0, 22), (22, 21), (43, 21)), (((0,), (1,)), ((1,), (2,)), ((2,), (0,))), 2)


@cache
def golay_index() -> np.ndarray:
    """Index of the nearest codeword for each of the 2^23 words."""
    data = np.arange(1 << DATA_BITS, dtype=np.uint32)
    rest = data << (CODE_BITS - DATA_BITS)
    for bit in range(CODE_BITS - 1, CODE_BITS - DATA_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ np.uint32(GENERATOR << (bit - (CODE_BITS - DATA_BITS))), rest)
    words = data << (CODE_BITS - DATA_BITS) | rest
    table = np.empty(1 << CODE_BITS, np.uint16)
    one = [1 << i for i in range(CODE_BITS)]
    errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    for error in errors:
        table[words ^ np.uint32(error)] = data
    return table


remembers("simhash", golay_index.cache_clear)


def segment_keys(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index), each pair once: the codewords of every word at most one bit from the value."""
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
    near = np.sort(golay_index()[values.astype(np.uint32)[:, None] ^ flips], axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(new)[0], near[new]


def cut(words: np.ndarray, first: int, width: int) -> np.ndarray:
    """Bits first .. first + width - 1 of fingerprints given as uint64 columns."""
    at, shift = divmod(first, 64)
    out = words[:, at] >> np.uint64(shift)
    if shift + width > 64:
        out = out | words[:, at + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << width) - 1)


def bucket_keys(words: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) for all buckets of all fingerprints; a bucket is a 64-bit number."""
    rows, keys = [], []
    parts = [cut(words, *s) for s in scheme.segments]
    near = {j: segment_keys(parts[j], scheme.segments[j][1]) for _, by_key in scheme.buckets for j in by_key}
    for number, (exact, by_key) in enumerate(scheme.buckets):
        row = np.arange(len(words))
        key = np.full(len(words), number, np.uint64)
        for i in exact:
            key = key << np.uint64(scheme.segments[i][1]) | parts[i]
        for j in by_key:
            of, index = near[j]
            starts = np.searchsorted(of, np.arange(len(words) + 1))
            times = (starts[1:] - starts[:-1])[row]
            picked = np.repeat(starts[row], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, key = np.repeat(row, times), np.repeat(key, times) << np.uint64(DATA_BITS) | index[picked]
        rows.append(row)
        keys.append(key)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: str | None, shingle: int, longs: int = 1, distinct: bool = False) -> np.ndarray:
    """``longs`` 64-bit words; the word hashed with seed 42 is first. Only A-Z are lower-cased, ASCII white space parts words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.zeros(longs, np.uint64)
    if not tokens:
        return out
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - shingle + 1)
    pieces = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[len(tokens) - n :].tolist(), strict=True)]
    if distinct:
        pieces = list(set(pieces))
    for k in range(longs):
        digest = xxhash.xxh64_intdigest
        out[k] = majority(np.fromiter([digest(p, 42 + k) for p in pieces], np.uint64, len(pieces)))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, longs: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0 .. f<longs-1>) with one row for each row of ``docs``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType
    names = [f"f{k}" for k in range(longs)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle, longs, distinct) for x in batch.column(1)], np.uint64).reshape(-1, longs)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k].view(np.int64)) for k in range(longs))], names=["id", *names])

    return source.mapInArrow(hashed, T.StructType([T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in names)]))


def join_groups(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of ``a`` and ``b`` in ``label``, which names each node's group by its least node."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label] != label).any():
            label[up] = label[label[up]]


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the edges of a minimum spanning forest: every group takes its lightest edge to another, until there is none."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    # A rank of its own for each edge, so that chosen edges form no ring.
    rank = np.empty(len(a), np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(a))
    label, left, keep = np.arange(len(names)), np.arange(len(a)), []
    while len(left):
        u, v = label[x[left]], label[y[left]]
        left, u, v = left[u != v], u[u != v], v[u != v]
        best = np.full(len(names), len(a))
        np.minimum.at(best, u, rank[left])
        np.minimum.at(best, v, rank[left])
        chosen = left[(best[u] == rank[left]) | (best[v] == rank[left])]
        keep.append(chosen)
        join_groups(label, x[chosen], y[chosen])
    return np.sort(np.concatenate(keep)) if keep else np.empty(0, np.int64)


def _bucket_edges(group: np.ndarray, node: np.ndarray, words: np.ndarray, distance: int) -> tuple[np.ndarray, ...]:
    """Forest of the pairs within the distance that share a group; rows come sorted by group."""
    found = []
    active = np.arange(len(group) - 1)
    step = 1
    while len(active):
        active = active[active + step < len(group)]
        active = active[group[active] == group[active + step]]
        bits = np.bitwise_count(words[active] ^ words[active + step]).sum(axis=1)
        near = active[(bits <= distance) & (node[active] != node[active + step])]
        if len(near):
            found.append((near, near + step, np.bitwise_count(words[near] ^ words[near + step]).sum(axis=1)))
            if sum(len(x[0]) for x in found) > 1 << 20:
                found = [_shrink(found, node)]
        step += 1
    if not found:
        return (np.empty(0, np.int64),) * 3
    a, b, bits = _shrink(found, node)
    return node[a], node[b], bits


def _shrink(found: list, node: np.ndarray) -> tuple[np.ndarray, ...]:
    a, b, bits = (np.concatenate([x[i] for x in found]) for i in range(3))
    keep = forest(node[a], node[b], bits)
    return a[keep], b[keep], bits[keep]


def whole_groups(batches: Iterator[pd.DataFrame], order: list[str]) -> Iterator[pd.DataFrame]:
    """The rows, sorted by ``order``, cut anew where it changes."""
    rest = None
    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        where = rest[order].to_numpy()
        change = np.nonzero((where[1:] != where[:-1]).any(axis=1))[0]
        if not len(change):
            continue
        yield rest.iloc[: change[-1] + 1]
        rest = rest.iloc[change[-1] + 1 :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def links(nodes: DataFrame, scheme: Scheme, longs: int, work: Workspace) -> DataFrame:
    """(u, v, bits): for each bucket a minimum spanning forest of its pairs within ``scheme.distance``.

    ``nodes`` has a distinct long ``node`` and the fingerprint f0 .. f<longs-1>.
    """
    spark = nodes.sparkSession
    names = [f"f{k}" for k in range(longs)]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 2048):
                part = pdf.iloc[start : start + 2048].reset_index(drop=True)
                row, key = bucket_keys(part[names].to_numpy(np.int64).view(np.uint64).reshape(-1, longs), scheme)
                yield part.iloc[row].assign(key=key)[["key", "node", *names]]

    fields = ", ".join(f"{n} long" for n in ("key", "node", *names))
    keys = nodes.select("node", *names).mapInPandas(keyed, fields)
    large = work.save(keys.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    dealt = keys.join(broadcast_if_small(large, 32), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", *names)
    order = ["key", "lo", "hi"]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(closed, whole_groups(batches, order))

    def closed(pdf: pd.DataFrame) -> pd.DataFrame:
        where = pdf[order].to_numpy()
        group = np.concatenate([[0], np.cumsum((where[1:] != where[:-1]).any(axis=1))])
        u, v, bits = _bucket_edges(group, pdf["node"].to_numpy(), pdf[names].to_numpy(np.int64).view(np.uint64).reshape(-1, longs), scheme.distance)
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v), "bits": bits.astype(np.int32)})

    edges = dealt.repartition(partitions(spark), *order).sortWithinPartitions(*order).mapInPandas(compared, "u long, v long, bits int")
    return edges.groupBy("u", "v").agg(F.min("bits").alias("bits"))


def near_duplicates(prints: DataFrame, scheme: Scheme, longs: int, work: Workspace) -> DataFrame:
    """(id, f0 .., component_id) for each row of ``prints``.

    ``component_id`` is the smallest id of the rows that can be reached by links.
    """
    names = [f"f{k}" for k in range(longs)]
    # One long names a fingerprint: itself, or the 64-bit hash of its words if it has several.
    prints = work.save(prints, "prints").withColumn("node", F.col("f0") if longs == 1 else F.xxhash64(*names))
    nodes = work.save(prints.groupBy("node", *names).agg(F.min("id").alias("least")), "nodes")
    edges = work.save(links(nodes, scheme, longs, work), "edges")
    return labelled(prints, nodes, components(edges.select("u", "v"), work), work).select("id", *names, "component_id")


def labelled(prints: DataFrame, nodes: DataFrame, roots: DataFrame, work: Workspace) -> DataFrame:
    """``prints`` with component_id: the smallest id of the nodes with the same root."""
    grouped = work.save(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "root", "least"), "rooted")
    # Written, so that both sides of the joins are plain tables and a hot group is split.
    of_root = work.save(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "of_root")
    return prints.join(work.save(grouped.join(of_root, "root").select("node", "component_id"), "named"), "node")


#: Documents sampled for common shingles, and how many of these are told apart by their counts.
SAMPLE, COMMON = 8_000, 100_000
#: Bits of a node's sketches, in longs: of the one that goes into buckets, and of the one for pairs that pass it.
SKETCH, WIDE = 3, 32
#: Sets of a key that one task compares; more are dealt out as pairs of blocks.
SETS = 4096


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    at = np.arange(max(1, len(words) - width + 1))
    return np.unique(Rolling(words, BASES[:1]).of(at, np.minimum(at + width, len(words))))


def least_shared(size, share: float):
    """The fewest shingles that are ``share`` of ``size``."""
    return np.ceil(share * size - 1e-9).astype(np.int64)


def common_shingles(keyed: DataFrame, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, counts) of the shingles that several documents of a sample have."""
    rows = keyed.count()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), width).view(np.int64))], names=["key"])

    sample = keyed.select("text").sample(min(1.0, SAMPLE / max(1, rows)), 3)
    counts = sample.mapInArrow(listed, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(COMMON).toPandas()
    keys = counts["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], counts["n"].to_numpy(np.int64)[order]


_NAMES = [f"s{k}" for k in range(SKETCH)]


def parities(shingles: np.ndarray, longs: int) -> np.ndarray:
    """A sketch of a set: a bit for the parity of the shingles that fall on it. Every differing bit of two sketches is a shingle that one set lacks."""
    bits = np.bincount((shingles % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def shingle_prints(keyed: DataFrame, similarity: float, common, width: int = 5) -> DataFrame:
    """(id, node, f0, size, s0 .., wide, prefix) for each row: hash, SimHash fingerprint, size, sketches and prefix of the shingle set.

    All sets are ordered alike, common shingles last, and a set's prefix is one shingle longer than the share that a similar set may
    lack: similar sets meet in their prefixes. ``common`` only moves shingles in that order, so it costs or saves time and no pair.
    """
    longs = [T.StructField(n, T.LongType()) for n in ("node", "f0", *_NAMES)]
    kind = T.StructType([keyed.schema["id"], *longs, T.StructField("size", T.IntegerType()), T.StructField("wide", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def described(text: str | None, known: np.ndarray, counts: np.ndarray) -> tuple:
        shingles = shingle_set(text, width)
        times = np.zeros(len(shingles), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            times = np.where(known[at] == shingles, counts[at], 0)
        length = len(shingles) - int(least_shared(np.int64(len(shingles)), similarity)) + 1 if len(shingles) else 0
        names = np.array([xxhash.xxh64_intdigest(shingles.tobytes(), 2), majority(shingles)], np.uint64).view(np.int64)
        return (*names, *parities(shingles, SKETCH)), len(shingles), parities(shingles, WIDE).tobytes(), shingles[np.argsort(times, kind="stable")[:length]]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                numbers, sizes, wide, prefixes = zip(*(described(x.as_py(), *common.value) for x in part.column(1)), strict=True)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes).view(np.int64)))
                columns = [pa.array(x) for x in np.array(numbers, np.int64).T.copy()]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(sizes, pa.int32()), pa.array(wide, pa.binary()), lists], schema=pa.schema([batch.schema.field(0).with_name("id"), *(pa.field(f.name, pa.int64()) for f in longs), pa.field("size", pa.int32()), pa.field("wide", pa.binary()), pa.field("prefix", pa.list_(pa.int64()))]))

    return keyed.mapInArrow(hashed, kind)


def shared_shingles(nodes: DataFrame, work: Workspace) -> DataFrame:
    """(key, node, size, place, s0 ..): the prefix shingles that several nodes have."""
    entries = nodes.select("node", "size", F.posexplode("prefix").alias("place", "key"))
    several = work.save(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
    return entries.join(broadcast_if_small(several, 16), "key").join(nodes.select("node", *_NAMES), "node")


def blocked(entries: DataFrame, work: Workspace) -> DataFrame:
    """``entries`` (key, node, root, ..) of keys with several roots, dealt out as pairs (lo, hi) of blocks of nodes."""
    buckets = entries.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"))
    buckets = work.save(buckets.where("low < high").select("key", F.ceil(F.col("rows") / SETS).cast("int").alias("blocks")), "buckets")
    dealt = entries.join(broadcast_if_small(buckets, 32), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "block", "other")


_ORDER = ["key", "lo", "hi"]


def _close(size: np.ndarray, place: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, share: float) -> tuple[np.ndarray, ...]:
    """(a, b, bits) of the pairs whose sizes, places and sketches allow that they share ``share`` of the sum of their sizes."""
    total = size[a] + size[b]
    need = least_shared(total, share)
    # The first shingle that both have is followed by as many more as they share.
    good = np.minimum(size[a] - place[a], size[b] - place[b]) >= need
    a, b, most = a[good], b[good], (total - 2 * need)[good]
    bits = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
    good = bits <= most
    return a[good], b[good], bits[good]


def candidates(dealt: DataFrame, similarity: float, how: str) -> DataFrame:
    """Of the pairs of different roots in a block that may be similar: a spanning ``forest`` or ``all`` as (u, v), or the ``nodes`` that have one as (key, lo, hi, node).

    Sketches are s0 .., or ``wide`` if there is that column.
    """
    wide, share = "wide" in dealt.columns, similarity / (1 + similarity)

    def paired(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        where = pdf[_ORDER].to_numpy()
        group = np.concatenate([[0], np.cumsum((where[1:] != where[:-1]).any(axis=1))])
        node, root, size, place = (pdf[c].to_numpy(np.int64) for c in ("node", "root", "size", "place"))
        words = np.frombuffer(b"".join(pdf["wide"]), np.uint64).reshape(len(pdf), -1) if wide else pdf[_NAMES].to_numpy(np.int64).view(np.uint64)
        marked, found = np.zeros(len(pdf), bool), [(np.empty(0, np.int64),) * 3]

        def merged() -> tuple[np.ndarray, ...]:
            """The pairs found, without those that the others stand for."""
            a, b, bits = (np.concatenate([x[i] for x in found]) for i in range(3))
            if how == "all":
                keep = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1, return_index=True)[1]
            else:
                keep = forest(root[a], root[b], bits)
            return a[keep], b[keep], bits[keep]

        def named(a: np.ndarray, b: np.ndarray, _: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"u": np.minimum(node[a], node[b]), "v": np.maximum(node[a], node[b])})

        active, step = np.arange(len(group) - 1), 1
        while len(active):
            active = active[active + step < len(group)]
            active = active[group[active] == group[active + step]]
            for start in range(0, len(active), 1 << 16):
                a = active[start : start + (1 << 16)]
                a = a[root[a] != root[a + step]]
                close = _close(size, place, words, a, a + step, share)
                if how == "nodes":
                    marked[close[0]] = marked[close[1]] = True
                else:
                    found.append(close)
            step += 1
            if sum(len(x[0]) for x in found) > 1 << 18:
                found = [merged()]
                if len(found[0][0]) > 1 << 17:
                    yield named(*found.pop())
                    found.append((np.empty(0, np.int64),) * 3)
        if how == "nodes":
            yield pdf.loc[marked, [*_ORDER, "node"]]
        else:
            yield named(*merged())

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("simhash")
        for pdf in whole_groups(batches, _ORDER):
            yield from paired(pdf)

    rows = dealt.select(*_ORDER, "node", "root", "size", "place", *(["wide"] if wide else _NAMES))
    rows = rows.repartition(partitions(dealt.sparkSession), *_ORDER).sortWithinPartitions(*_ORDER)
    if how == "nodes":
        return rows.mapInPandas(compared, "key long, lo int, hi int, node long")
    return rows.mapInPandas(compared, "u long, v long").distinct()


@dataclass(frozen=True)
class Verifier:
    """Keeps the pairs of nodes whose shingle sets have at least the Jaccard ``similarity``: first by wide sketches, then by the sets themselves.

    ``keyed`` has id and text, ``nodes`` the node, its least id, size and wide sketch, ``ids`` the node of each row.
    """

    keyed: DataFrame
    nodes: DataFrame
    ids: DataFrame
    work: Workspace
    similarity: float
    width: int = 5

    def _ends(self, pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
        return broadcast_if_small(self.work.save(ends, name), 8)

    def likely(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose wide sketches allow the similarity."""
        share = self.similarity / (1 + self.similarity)
        known = self.work.save(self.nodes.join(self._ends(pairs, f"ends-{name}"), "node", "left_semi").select("node", "size", "wide"), f"wide-{name}")

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (3, 5))
                bits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                keep = bits <= sizes - 2 * least_shared(sizes, share)
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep))

        side = lambda end, n: known.select(F.col("node").alias(end), F.col("size").alias(f"size_{n}"), F.col("wide").alias(f"wide_{n}"))
        both = pairs.select("u", "v").join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "size_a", "wide_a", "size_b", "wide_b")
        return self.work.save(both.mapInArrow(close, "u long, v long"), f"likely-{name}")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        pairs = self.likely(pairs, name)
        wanted = self.nodes.join(self._ends(pairs, f"sure-{name}"), "node", "left_semi").select(F.col("node").alias("of"), F.col("least").alias("id"))
        # Documents of one id and text have equal sets; one of them is enough.
        rows = self.ids.join(broadcast_if_small(self.work.save(wanted, f"least-{name}"), 40), "id").groupBy("of", "id").agg(F.count("*").alias("rows"))
        rows = self.work.save(rows, f"wanted-{name}")
        texts = self.keyed.join(broadcast_if_small(rows, 48), "id").select(F.col("of").alias("node"), "text", "rows")
        once = texts.where("rows = 1")
        if rows.where("rows > 1").limit(1).count():
            once = once.unionByName(texts.where("rows > 1").dropDuplicates(["node"]))
        width, similarity = self.width, self.similarity

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    sets = [shingle_set(x.as_py(), width).tobytes() for x in part.column(1)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

        def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for a, b in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

        sets = self.work.save(once.select("node", "text").mapInArrow(listed, "node long, shingles binary"), f"sets-{name}")
        left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
        right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
        found = self.work.save(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(similar, "u long, v long"), f"verified-{name}")
        for table in ("ends", "wide", "sure", "least", "wanted", "sets"):
            self.work.drop(f"{table}-{name}")
        return found


#: Rounds that look for forests of similar pairs before all pairs that are left are looked at.
ROUNDS = 1


def similar_documents(docs: DataFrame, work: Workspace, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for each row, both as (id, hash of the text): groups of documents linked by similar shingle sets.

    Documents of one shingle set are one node, told by a 64-bit hash of the set. Links found by the Golay keys of the sets' fingerprints are
    verified; two bits apart is nearer than the similarity asks, so an exact way finds the rest: every two nodes whose Jaccard similarity
    is ``similarity`` or more share a shingle of their prefixes and pass all filters. First a spanning forest of such pairs of different
    groups is verified, and joins groups; then every such pair that is left is verified.
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("copy")).alias("id"), F.col(text_col).cast("string").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(keyed))
    prints = work.save(shingle_prints(keyed, similarity, common), "prints")
    described = [F.first(c).alias(c) for c in ("f0", "size", *_NAMES, "wide", "prefix")]
    nodes = work.save(prints.groupBy("node").agg(F.min("id").alias("least"), *described), "nodes")
    ids = work.save(prints.select("id", "node"), "ids")
    work.drop("prints")
    entries = work.save(shared_shingles(nodes, work), "entries")
    # Prefixes, most of the table, are not needed any more.
    nodes = work.save(nodes.select("node", "least", "f0", "size", "wide"), "described")
    work.drop("nodes")
    work.drop("several")
    verifier = Verifier(keyed, nodes, ids, work, similarity)
    pairs = links(nodes.select("node", "f0"), WITHIN_2, 1, work).select("u", "v")
    tried, edges, roots = None, None, nodes.select("node", F.col("node").alias("root"))
    for step in range(ROUNDS + 1):
        if edges is None:
            rooted = entries.withColumn("root", F.col("node"))
        else:
            rooted = entries.join(broadcast_if_small(roots, 24), "node", "left").withColumn("root", F.coalesce("root", "node"))
        dealt = blocked(work.save(rooted, "rooted"), work)
        if step == ROUNDS:
            # Rows that have a partner by the short sketch get the wide one.
            marked = work.save(candidates(dealt, similarity, "nodes"), "marked")
            wide = nodes.join(broadcast_if_small(work.save(marked.select("node").distinct(), "marked-nodes"), 8), "node", "left_semi").select("node", "wide")
            dealt = dealt.join(marked, [*_ORDER, "node"], "left_semi").join(wide, "node")
        found = candidates(dealt, similarity, "all" if step == ROUNDS else "forest")
        pairs = found if step else pairs.union(found).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = work.save(pairs, f"pairs-{step}")
        for table in ("large", "rooted", "buckets", "marked", "marked-nodes"):
            work.drop(table)
        if not pairs.limit(1).count():
            if step < ROUNDS:
                continue
            break
        new = verifier.verified(pairs, str(step))
        tried = pairs if tried is None else tried.union(pairs)
        edges = new if edges is None else edges.union(new)
        roots = work.save(components(edges, work, f"cc{step}"), f"roots-{step}")
    return labelled(ids, nodes, roots, work).select("id", "component_id")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op9")
    prints = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3)
    found = near_duplicates(prints, WITHIN_2, 1, work)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
