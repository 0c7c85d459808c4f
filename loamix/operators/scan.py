"""BM25 by passes over the documents: what each has is counted where it is read, so that no term table is written or shuffled.

For kinds of tokens of which most queries share many with most documents, such as character n-grams, a term table and its hits are many times the
text. Here a first pass counts documents and lengths, the next scores each document against all queries and keeps each task's best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamix.functions import text as X
from loamix.operators.ranking import TERM_BYTES, raw_idf, top_k
from loamix.plans.shared import BROADCAST_BYTES, Workspace, broadcast_if_small

#: Documents, characters or words, and cells of a matrix that a worker takes at a time; rows of document frequencies it gathers before they are sent.
ROWS, TOKENS, CELLS, GATHERED = 256, 1 << 20, 1 << 20, 1 << 20
#: Sizes up to which a table by n-gram code is used, and cells of a table of documents and n-grams.
CODES, SEEN = 1 << 23, 1 << 25
CHARS = 0x110000


@dataclass(frozen=True)
class Part:
    """One ranking: a text column, cut by ``words`` or, if ``n``, into runs of n characters with n - 1 pads on either side."""

    field: str
    n: int = 0
    weight: float = 1.0
    words: Callable[[Column], Column] = X.letters

    def __post_init__(self):
        if not 0 <= self.n <= 3:  # codes of three characters fill a long
            raise ValueError("n is 0, for words, to 3")

    def column(self) -> str:
        return f"{self.field} {'text' if self.n else 'words'}"

    def tokenizer(self) -> Callable[[Column], Column]:
        return (lambda c: X.char_ngrams(c, self.n)) if self.n else self.words


def one_row_each(docs: DataFrame, parts: list[Part], key: str, work: Workspace) -> DataFrame:
    """(key, <column of a part> ..): arrays of texts or of words. Rows of one key, which are few, are put together."""
    own = {p.column(): F.array_compact(F.array(p.field)) if p.n else F.coalesce(p.words(F.col(p.field)), F.array().cast("array<string>")) for p in parts}
    rows = docs.select(key, *[c.alias(name) for name, c in own.items()])
    again = work.save(docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("again")), "again")
    if again.isEmpty():
        return rows
    again = broadcast_if_small(again, 16)
    same = F.col(key).eqNullSafe(F.col("again"))
    many = rows.join(again, same, "left_semi").groupBy(key).agg(*[F.flatten(F.collect_list(F.col(f"`{c}`"))).alias(c) for c in own])
    return rows.join(again, same, "left_anti").unionByName(many)


# ---- in the workers --------------------------------------------------------------------------------------------


def small_batches(df: DataFrame) -> DataFrame:
    """Rows go to the workers 2 MB at a time, unless the session says otherwise."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if limit not in conf.getAll:
        conf.set(limit, str(2 << 20))
    return df


class _Texts:
    """The texts of a batch, cut into n-grams by ranges of documents."""

    def __init__(self, lists: pa.ListArray, n: int):
        self.n, self.offsets = n, lists.offsets.to_numpy() - lists.offsets[0].as_py()
        self.texts = lists.flatten().to_pylist()
        sizes = [len(t) + n - 1 if t else 0 for t in self.texts]
        self.cost = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])[self.offsets]  # tokens before each document

    def characters(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The padded texts of documents lo to hi as code points, the document of each n of them, and which of these runs leave their text."""
        first, last, pad = self.offsets[lo], self.offsets[hi], "$" * (self.n - 1)
        texts = [pad + t + pad if t else "" for t in self.texts[first:last]]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        rows = np.repeat(np.repeat(np.arange(hi - lo), np.diff(self.offsets[lo : hi + 1])), sizes)
        size, ends = max(0, len(points) - self.n + 1), np.cumsum(sizes)[sizes > 0]
        over = np.concatenate([ends - i for i in range(1, self.n)] or [ends[:0]])
        return points, rows[:size], over[over < size]

    def frequencies(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (21 bits a character) of the different n-grams, and in how many of the documents each is."""
        points, rows, over = self.characters(lo, hi)
        seen = np.zeros(CHARS, dtype=bool)
        seen[points] = True
        letters = np.flatnonzero(seen)
        lut = np.zeros(CHARS, dtype=np.int32)
        lut[letters] = np.arange(len(letters))
        inside = np.ones(len(rows), dtype=bool)
        inside[over] = False
        codes, rows = _codes(lut[points], self.n, len(letters))[inside], rows[inside]
        if len(letters) ** self.n <= CODES:
            at = np.zeros(len(letters) ** self.n, dtype=np.int32)
            at[codes] = 1
            different = np.flatnonzero(at)
            at[different] = np.arange(len(different))
            ids = at[codes]
        else:
            different, ids = np.unique(codes, return_inverse=True)
        size = len(different)
        if (hi - lo) * size <= SEEN:
            has = np.zeros((hi - lo) * size, dtype=bool)
            has[rows * size + ids] = True
            df = has.reshape(hi - lo, size).sum(axis=0)
        else:
            df = np.bincount(np.unique(rows * size + ids) % size, minlength=size)
        packed = np.zeros(size, dtype=np.int64)
        for _ in range(self.n):  # the last character first
            different, letter = np.divmod(different, max(1, len(letters)))
            packed = (packed << 21) | letters[letter]
        return packed, df


def _codes(ids: np.ndarray, n: int, base: int) -> np.ndarray:
    """Of each run of n ids the number that they are to a base."""
    size = max(0, len(ids) - n + 1)
    codes = ids[:size].astype(np.int64)
    for i in range(1, n):
        codes = codes * base + ids[i : i + size]
    return codes


def _unpacked(codes: np.ndarray, n: int) -> list[str]:
    points = np.stack([(codes >> (21 * i)) & 0x1FFFFF for i in range(n)], axis=1).astype("<u4")
    whole = points.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + n] for i in range(0, len(whole), n)]


class _Grams:
    """Numbers for n-grams: those that are wanted count from 0, any other is their count."""

    def __init__(self, terms: list[str], n: int):
        self.n, self.size = n, len(terms)
        letters = sorted({ord(c) for t in terms for c in t})
        self.base, self.lut = len(letters) + 1, np.zeros(CHARS, dtype=np.int32)
        self.lut[letters] = np.arange(1, self.base)
        codes = np.array([_codes(self.lut[[ord(c) for c in t]], n, self.base)[0] for t in terms], dtype=np.int64)
        self.table = None
        if self.base**n <= CODES:
            self.table = np.full(self.base**n, self.size, dtype=np.int32)
            self.table[codes] = np.arange(self.size)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]

    def counts(self, texts: _Texts, lo: int, hi: int) -> np.ndarray:
        points, rows, over = texts.characters(lo, hi)
        codes = _codes(self.lut[points], self.n, self.base)
        if self.table is not None:
            ids = self.table[codes]
        else:
            at = np.minimum(np.searchsorted(self.codes, codes), self.size - 1)
            ids = np.where(self.codes[at] == codes, self.order[at], self.size)
        ids[over] = self.size
        return _matrix(rows, ids, hi - lo, self.size)


class _Words:
    """As _Texts, for lists of words."""

    def __init__(self, lists: pa.ListArray, n: int = 0):
        self.offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        self.ids, self.words, self.cost = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, self.offsets
        self.numbers: dict[int, np.ndarray] = {}


class _Vocabulary:
    """As _Grams, for words."""

    def __init__(self, terms: list[str], n: int = 0):
        self.size, self.terms = len(terms), pa.array(terms, pa.string())

    def counts(self, words: _Words, lo: int, hi: int) -> np.ndarray:
        if id(self) not in words.numbers:
            found = pc.fill_null(pc.index_in(words.words, value_set=self.terms), self.size)
            words.numbers[id(self)] = found.to_numpy(zero_copy_only=False)
        first, last = words.offsets[lo], words.offsets[hi]
        rows = np.repeat(np.arange(hi - lo), np.diff(words.offsets[lo : hi + 1]))
        return _matrix(rows, words.numbers[id(self)][words.ids[first:last]], hi - lo, self.size)


def _matrix(rows: np.ndarray, ids: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.bincount(rows * (width + 1) + ids, minlength=height * (width + 1)).reshape(height, width + 1)[:, :width].astype(np.float64)


def _ranges(costs: list[np.ndarray], rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many documents and, if they are more than one, TOKENS tokens."""
    cost, lo, size = np.sum(costs, axis=0), 0, len(costs[0]) - 1
    while lo < size:
        hi = int(np.searchsorted(cost, cost[lo] + TOKENS, "right")) - 1
        hi = min(size, lo + rows, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def _gram_frequencies(column: str, n: int):
    """A function of batches: (term, df) of n-grams, and in the same columns null and, of all documents that have any, their number and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        docs = length = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return codes, np.bincount(at, weights=np.concatenate([d for _, d in held]), minlength=len(codes)).astype(np.int64)

        def sent(codes, df):
            return pa.RecordBatch.from_pydict({"term": pa.array(_unpacked(codes, n), pa.string()), "df": df, "docs": pa.nulls(len(df), pa.int64()), "length": pa.nulls(len(df), pa.int64())})

        for batch in batches:
            texts = _Texts(batch.column(column), n)
            lengths = np.diff(texts.cost)
            docs, length = docs + int((lengths > 0).sum()), length + int(lengths.sum())
            for lo, hi in _ranges([texts.cost], ROWS):
                if texts.cost[hi] > texts.cost[lo]:
                    held.append(texts.frequencies(lo, hi))
            if sum(len(c) for c, _ in held) > GATHERED:
                held = [merged()]
                if len(held[0][0]) > GATHERED // 2:
                    yield sent(*held.pop())
        if held:
            yield sent(*merged())
        yield pa.RecordBatch.from_pydict({"term": pa.nulls(1, pa.string()), "df": pa.nulls(1, pa.int64()), "docs": pa.array([docs]), "length": pa.array([length])})

    return run


@dataclass(frozen=True)
class _Scale:
    """What the scores of a part need: mean length and, of each wanted term, queries and weights."""

    part: Part
    avgdl: float
    terms: list[str]
    at: np.ndarray  # term and query of each weight
    weights: np.ndarray
    factor: float = 1.0


def _scored(scales: list[_Scale], queries: int, k1: float, b: float, key: str):
    """A function of batches to (document ids, a matrix of scores by part, a matrix of hits by part) of ranges of documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        made = [(_Grams if s.part.n else _Vocabulary)(s.terms, s.part.n) for s in scales]
        tables = []
        for s in scales:
            tables.append(np.zeros((len(s.terms), queries)))
            tables[-1][s.at[0], s.at[1]] = s.weights
        rows = max(1, min(ROWS, CELLS // max([len(s.terms) for s in scales] + [queries, 1])))
        for batch in batches:
            cut = {}
            for s in scales:
                kind = s.part.column(), s.part.n
                if kind not in cut:
                    cut[kind] = (_Texts if s.part.n else _Words)(batch.column(kind[0]), s.part.n)
            own = [cut[s.part.column(), s.part.n] for s in scales]
            for lo, hi in _ranges([c.cost for c in cut.values()], rows):
                yield batch.column(key).slice(lo, hi - lo), (_scores(s, m, t, c, lo, hi, k1, b) for s, m, t, c in zip(scales, made, tables, own))

    return run


def _scores(scale: _Scale, made, table: np.ndarray, cut, lo: int, hi: int, k1: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """The scores of documents lo to hi for each query, and which of them share a term."""
    if not scale.terms:
        return np.zeros((hi - lo, table.shape[1])), np.zeros((hi - lo, table.shape[1]), dtype=bool)
    f, dl = made.counts(cut, lo, hi), np.diff(cut.cost[lo : hi + 1])
    cells = np.flatnonzero(f)
    own, length = f.ravel()[cells], k1 * (1 - b + b * np.maximum(dl, 1) / scale.avgdl)
    f.ravel()[cells] = own * (k1 + 1) / (own + length[cells // f.shape[1]])
    scores = f @ table
    if (scale.weights > 0).all():
        return scores, scores > 0
    present = np.zeros_like(table)
    present[scale.at[0], scale.at[1]] = 1.0
    return scores, (f > 0).astype(np.float64) @ present > 0


def _largest(scored, key: str):
    """(part, most) of each part's largest score in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for _, parts in scored(batches):
            for i, (scores, hits) in enumerate(parts):
                if hits.any():
                    most[i] = max(most.get(i, -np.inf), float(scores[hits].max()))
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(most), pa.int32()), "most": pa.array(list(most.values()), pa.float64())})

    return run


def _best(scored, factors: list[float], queries: int, k: int, digits: int, key: str):
    """(query, key, score) of the k best documents of each query in a task; of equal rounded scores those of the smaller key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(queries)]
        least = np.full(queries, -np.inf)
        kind = None
        for ids, parts in scored(batches):
            kind = ids.type
            total = hit = None
            for factor, (scores, hits) in zip(factors, parts):
                total, hit = (scores * factor, hits) if total is None else (total + scores * factor, hit | hits)
            total = np.round(total, digits)
            good = hit & (total >= least)
            keys = ids.to_pylist()
            order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
            for q in np.flatnonzero(good.any(axis=0)):
                rows = order[good[order, q]]
                rows = rows[np.argsort(-total[rows, q], kind="stable")[:k]]  # stable: the smaller key first
                best[q] = sorted(best[q] + [(-total[i, q], keys[i]) for i in rows])[:k]
                if len(best[q]) == k:
                    least[q] = -best[q][-1][0]
        found = [(q, x, -s) for q, own in enumerate(best) for s, x in own]
        if found:
            query, keys, score = zip(*found)
            yield pa.RecordBatch.from_pydict({"query": pa.array(query, pa.int32()), key: pa.array(keys, kind), "score": pa.array(score, pa.float64())})

    return run


# ---- the whole -------------------------------------------------------------------------------------------------


def _statistics(rows: DataFrame, part: Part, work: Workspace) -> tuple[DataFrame, float, float]:
    """(term, df) of a part, how many documents have a term, and their mean length."""
    column, name = part.column(), f"{part.field}-{part.n}"
    if part.n:
        counts = small_batches(rows).select(F.col(f"`{column}`")).mapInArrow(_gram_frequencies(column, part.n), "term string, df long, docs long, length long")
        counts = work.save(counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "length")]), name)
    else:
        # A null beside a document's different words carries its length.
        words = rows.select(F.col(f"`{column}`").alias("w")).select(F.size("w").alias("dl"), F.array_append(F.array_distinct("w"), F.lit(None).cast("string")).alias("w"))
        alone = F.col("term").isNull()
        words = words.select("dl", F.explode("w").alias("term")).groupBy("term")
        counts = work.save(words.agg(F.count("*").alias("df"), F.count_if(alone & (F.col("dl") > 0)).alias("docs"), F.sum(F.when(alone, F.col("dl"))).alias("length")), name)
    total = counts.where("term is null").first()
    docs, length = (total.docs or 0, total.length or 0) if total else (0, 0)
    return counts.where("term is not null").select("term", "df"), float(docs), length / docs if docs else 0.0


def bm25_top(
    docs: DataFrame,
    parts: list[Part],
    queries: DataFrame,
    k: int,
    work: Workspace,
    k1: float = 1.5,
    b: float = 0.75,
    floor: str | float = "mean",
    normalise: bool = False,
    digits: int = 6,
    key: str = "doc_id",
    limit: int | None = None,
) -> DataFrame:
    """(qid, key, score, rank): the k best documents of each query by the weighted sum of the parts' BM25 scores.

    ``docs`` (key, <field of a part> ..), ``queries`` (qid, text). Each part has document frequencies, lengths and idf of its own, as ``ranking.bm25``;
    with ``normalise`` its scores are divided by the largest of all queries. Queries whose terms exceed ``limit`` bytes take several turns.
    """
    spark = docs.sparkSession
    rows = one_row_each(docs, parts, key, work)
    scored_rows = small_batches(rows.where(F.col(key).isNotNull()))
    cuts = {(p.n, p.words): p.tokenizer() for p in parts}
    asked = {c: queries.select("qid", F.explode(cut(F.col("text"))).alias("term")).distinct() for c, cut in cuts.items()}
    limit, turns = limit or BROADCAST_BYTES, 1
    for x in asked.values():
        n, terms, ids = x.agg(F.count("*"), F.countDistinct("term"), F.countDistinct("qid")).first()
        turns = max(turns, -(-n * TERM_BYTES // limit), int(np.ceil(np.sqrt(terms * ids * 8 / (4 * limit)))))  # a worker holds terms times queries
    statistics = [_statistics(rows, p, work) for p in parts]

    def scales(turn: int) -> tuple[list, list[_Scale]]:
        found = []
        for part, (df, n, avgdl) in zip(parts, statistics):
            mean = 0.25 * (df.agg(F.avg(raw_idf(n))).first()[0] or 0.0) if floor == "mean" else float(floor)
            own = asked[part.n, part.words].where(F.pmod(F.xxhash64("qid"), F.lit(turns)) == turn)
            raw = F.col("raw")
            own = df.select("term", raw_idf(n).alias("raw")).join(broadcast_if_small(own, TERM_BYTES), "term")
            found.append((part, avgdl, own.select("qid", "term", F.when(raw < 0, F.lit(mean)).otherwise(raw).alias("w")).toPandas()))
        ids = sorted({q for _, _, own in found for q in own["qid"]})
        place = {q: i for i, q in enumerate(ids)}
        out = []
        for part, avgdl, own in found:
            terms = sorted(set(own["term"]))
            number = {t: i for i, t in enumerate(terms)}
            at = np.array([[number[t] for t in own["term"]], [place[q] for q in own["qid"]]], dtype=np.int64).reshape(2, len(own))
            out.append(_Scale(part, avgdl, terms, at, own["w"].to_numpy(dtype=np.float64)))
        return ids, out

    factors = [p.weight for p in parts]
    if normalise:
        most: dict[int, float] = {}
        for ids, own in map(scales, range(turns)):
            if ids:
                for r in scored_rows.mapInArrow(_largest(_scored(own, len(ids), k1, b, key), key), "part int, most double").groupBy("part").agg(F.max("most").alias("most")).collect():
                    most[r.part] = max(most.get(r.part, r.most), r.most)
        factors = [p.weight / most[i] if most.get(i) else 0.0 for i, p in enumerate(parts)]
    id_kind, key_kind = queries.schema["qid"].dataType, docs.schema[key].dataType
    out = None
    for ids, own in map(scales, range(turns)):
        numbers = spark.createDataFrame([(i, q) for i, q in enumerate(ids)], f"query int, qid {id_kind.simpleString()}")
        run = _best(_scored(own, len(ids), k1, b, key), factors, len(ids), k, digits, key)
        found = scored_rows.mapInArrow(run, f"query int, {key} {key_kind.simpleString()}, score double") if ids else spark.createDataFrame([], f"query int, {key} {key_kind.simpleString()}, score double")
        found = found.join(F.broadcast(numbers), "query").select("qid", key, "score")  # one row for each query of a turn
        out = found if out is None else out.unionByName(found)
    return top_k(out, k, digits).select("qid", key, "score", "rank")
