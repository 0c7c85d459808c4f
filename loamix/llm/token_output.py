"""Token ids in ORC files, in ascending id order, and reading them back.

Documents are range-partitioned and sorted by id, so each file holds one range of ids and its stripes and
row groups have narrow minima and maxima; with the Bloom filter on the id column a reader skips all stripes and row
groups that cannot hold an id. Token ids are lists of 32-bit integers, which ORC stores run-length
encoded. Stripes can be read in parallel. Each row stores the number of ids before it in its file, so places in the whole
stream need only one sum per file.

Encoding is done by the tokenizers library. If the tokenizer is byte-level BPE with its usual pattern, a text
is the concatenation of the encodings of its units (a run of non-space characters with the space before it, or
white space), since that pattern never joins two units; the library then gets the different units of some texts once,
many in one string, and the ids of texts are gathered as arrays. Units in one string are parted by the letter of a byte that UTF-8 never
holds and no merge has, so none is merged with another. Nothing is remembered from one lot of texts to the next. Other tokenizers, and
texts that hold an added token's string, are encoded whole.

Defined results: a null text is an empty one and has only the end id. Repeated ids follow each other, ordered by the hash of
their text; null ids come first. Columns other than the id and the text are not read. An empty table
gives a readable folder without rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamix.llm.memory import enter, remembers
from loamix.plans.shared import Workspace, broadcast_if_small, partitions

#: White space as Unicode defines it, which is what the tokenizer's pattern means.
SPACE = "\t-\r \x85\xa0  -     　"
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Starts units that have no space before them.
MARK = "\0"
#: Texts whose words are not parted by one space or line break each.
UNEVEN = f"(?:^|[ \n])(?:[ \n]|$)|[\\x00\x1c-\x1f{SPACE.replace(' ', '', 1)}]".replace("-\r", "\x0b-\r")
#: Letters, and marks of which a run is one piece; an apostrophe may begin a piece of its own.
LETTERS, SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
#: Units that are one piece; signs that are a piece of their own at a word's end.
PLAIN, ENDING = rf"^(?:\x00?(?:[{LETTERS}]+|[0-9]+|[{SIGNS}]+)|\n)$", f"([{LETTERS}0-9])([{SIGNS}]+)( |$)"
#: Bytes that stand for themselves in byte-level BPE; the others are moved above them.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: A byte that UTF-8 never holds, units in one string, and units that the library cuts in one call.
NEVER, JOINED, CUT = 0xFF, 64, 4096
#: Bytes of text that are encoded together (one text may have more), and words whose ids are gathered together.
TOGETHER, GATHERED = 8 << 20, 1 << 19


class Encoder:
    """Whole-text encoding without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        about = json.loads(self.library.to_str())
        pre = about.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in about.get("added_tokens", [])]
        others = iter(range(256, 512))
        self.letters = np.array([b if b in PRINTABLE else next(others) for b in range(256)], "<u2")
        model, never = about["model"], chr(self.letters[NEVER])
        self.parting = self.library.token_to_id(never)
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.by_unit = plain and bool(self.added) and about.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and [x for x in model["vocab"] if never in x] == [never]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, units: pa.Array) -> np.ndarray:
        """Ids of units that are one piece each, every unit's with ``parting`` after them."""
        if not len(units):
            return np.empty(0, "<u4")
        lists = pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units.cast(pa.binary()))
        part = bytes([NEVER])
        joined = part + b" " + pc.binary_join(lists, part + b" ")[0].as_py() + part
        own = np.frombuffer(joined.replace(part + b" \0", part).replace(part + b" \n", part + b"\n"), np.uint8)[1:]
        ends = np.flatnonzero(own == NEVER) + 1
        letters, cuts = self.letters[own].tobytes().decode("utf-16-le"), [0, *ends[JOINED - 1 : -1 : JOINED].tolist(), len(own)]
        model = self.library.model
        return np.fromiter((y.id for a, b in zip(cuts[:-1], cuts[1:], strict=True) for y in model.tokenize(letters[a:b])), "<u4")

    def _cut(self, units: list[str]) -> np.ndarray:
        """The same of units that the library's pattern may cut; an added token, which no unit holds, parts them for it."""
        own = [x[1:] if x[0] == MARK else f" {x}" for x in units]
        parted = [[x for unit in own[k : k + CUT] for x in (unit, self.added[0])] for k in range(0, len(own), CUT)]
        ids = [np.array(self.library.encode_batch_fast([x], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4") for x in parted]
        ids = np.concatenate([np.empty(0, "<u4"), *ids])
        return np.where(ids == self.library.token_to_id(self.added[0]), np.uint32(self.parting), ids)

    def _ids_of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different units, where each unit's begin, and how many they are.

        Units with a leading mark stand for the rest, others but a line break for themselves after a space.
        """
        plain = pc.match_substring_regex(units, PLAIN)
        ids = np.concatenate([self._pieces(units.filter(plain)), self._cut(units.filter(pc.invert(plain)).to_pylist())])
        ends, order = np.flatnonzero(ids == self.parting), np.argsort(pc.invert(plain).to_numpy(zero_copy_only=False), kind="stable")
        starts, sizes = np.empty((2, len(units)), np.int64)
        starts[order] = np.append(0, ends[:-1] + 1)[: len(ends)]
        sizes[order] = ends - starts[order]
        return ids, starts, sizes

    def _by_unit(self, words: pa.Array, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of texts whose units are ``words``, each text up to one of ``ends``."""
        coded, parts, counts = words.dictionary_encode(), [], np.zeros(len(words) + 1, np.int64)
        (ids, starts, sizes), codes = self._ids_of(coded.dictionary), coded.indices.to_numpy()
        for k in range(0, len(codes), GATHERED):
            part = codes[k : k + GATHERED]
            n = sizes[part]
            counts[k + 1 : k + 1 + len(part)] = n
            parts.append(ids[np.repeat(starts[part] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        places = np.cumsum(counts)[ends]
        return np.split(np.concatenate([np.empty(0, "<u4"), *parts]), places[:-1]) if len(places) else []

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        texts = pa.array(texts, pa.string())
        out: list[np.ndarray] = [None] * len(texts)
        whole = pa.array(np.full(len(texts), not self.by_unit))
        for x in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        uneven = pc.match_substring_regex(texts, UNEVEN)
        at = [np.flatnonzero(x) for x in (whole, pc.and_not(uneven, whole), pc.invert(pc.or_(uneven, whole)))]
        found = [self._whole(texts.take(pa.array(at[0])).to_pylist())]
        listed = [[MARK + x for x in UNIT.findall(text)] for text in texts.take(pa.array(at[1])).to_pylist()]
        found.append(self._by_unit(pa.array([x for own in listed for x in own], pa.string()), np.cumsum([len(x) for x in listed], dtype=np.int64)))
        even = pc.replace_substring(pc.binary_join_element_wise(MARK, texts.take(pa.array(at[2])), ""), "\n", f" \n {MARK}")
        split = pc.split_pattern(pc.replace_substring_regex(even, ENDING, rf"\1 {MARK}\2\3"), " ")
        found.append(self._by_unit(split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)))
        for places, arrays in zip(at, found, strict=True):
            for i, ids in zip(places.tolist(), arrays, strict=True):
                out[i] = ids
        return out


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, cut or put together to about TOGETHER bytes of text each."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy()
        group = (size + np.cumsum(sizes, dtype=np.int64) - sizes) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if size >= TOGETHER or a:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += int(sizes[a:b].sum())
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


remembers("tokens", encoder.cache_clear)


def _list(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]).astype(np.int32)))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_mb: int = 256, stripe_mb: int = 64) -> None:
    """Encode every text and write (doc_id, row_offset, n_tokens, tokens) as ORC under ``path``.

    There are as many files as shuffle partitions, or more, so that none holds more than about ``file_mb`` of text.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = source.withColumn("tie", F.xxhash64("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = partitions(docs.sparkSession, -(-size // (file_mb << 20)))
    ordered = ordered.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tokens")
        library, before = encoder(tokenizer), 0
        for part in _slices(batches, 1):
            ids = [np.append(x, end_id) for x in library.encode(part.column(1))]
            sizes = np.array([len(x) for x in ids], np.int64)
            offsets = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(offsets), pa.array(sizes), _list(ids)], names=["doc_id", "row_offset", "n_tokens", "tokens"])

    kind = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("row_offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    out = ordered.mapInArrow(encoded, kind)
    settings = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(stripe_mb << 20), "compression": "zstd"}
    out.write.mode("overwrite").options(**settings).orc(path)


def read_tokens(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, tokens): ``start`` counts the ids of all documents before it in the whole stream.

    Filters on doc_id reach the ORC reader.
    """
    kind = T.StructType([T.StructField("doc_id", id_type or T.LongType()), T.StructField("row_offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    rows = spark.read.schema(kind).orc(path).select("*", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("part"))
    # One row for each file.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(broadcast_if_small(before, 64), "part").select("doc_id", (F.col("before") + F.col("row_offset")).alias("start"), F.size("tokens").cast("long").alias("n_tokens"), "tokens")


def with_checksum(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): unsigned crc32 of the ids as little-endian 32-bit integers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = T.StructType([*tokens.schema.fields[:3], T.StructField("ids_crc32", T.LongType())])
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(summed, kind)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files(docs, Workspace(spark, "op1"))


def token_files(docs: DataFrame, work: Workspace) -> DataFrame:
    """Write ``docs`` as token files in ``work`` and summarise what is read back."""
    import public_tokenizers

    write_tokens(docs, work.at("tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return with_checksum(read_tokens(docs.sparkSession, work.at("tokens"), docs.schema["doc_id"].dataType))
