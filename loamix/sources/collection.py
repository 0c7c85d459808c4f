"""Source ``zlib_collection``: files of concatenated zlib streams with an index of little-endian 32-bit sizes beside them.

A partition covers the documents of a file until their compressed sizes exceed ``bytes_per_map``. Each task seeks to its own range.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BYTES_PER_MAP = 134_217_728


class Part(InputPartition):
    def __init__(self, path: str, first: int, offset: int, sizes: list[int]):
        self.path, self.first, self.offset, self.sizes = path, first, offset, sizes


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.limit = int(options.get("bytes_per_map", BYTES_PER_MAP))

    def partitions(self) -> list[Part]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        out = []
        for info in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
            if not info.path.endswith(".idx"):
                continue
            with fs.open_input_file(info.path) as file:
                data = file.read()
            sizes = [x[0] for x in struct.iter_unpack("<i", data[: len(data) // 4 * 4])]
            first = offset = start = total = 0
            for i, size in enumerate(sizes):
                total += size
                if total > self.limit or i == len(sizes) - 1:
                    out.append(Part(info.path[:-4], first, offset, sizes[start : i + 1]))
                    offset, first, start, total = offset + total, i + 1, i + 1, 0
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(partition.path) as file:
            file.seek(partition.offset)
            for i, size in enumerate(partition.sizes):
                yield partition.path, partition.first + i, size, zlib.decompress(file.read(size)).decode("utf-8", "replace")


class ZlibCollection(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zlib_collection"

    def schema(self) -> str:
        return "path string, doc_idx int, csize int, text string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def write_collection(docs: DataFrame, path: str) -> None:
    """Write the texts of ``docs`` (text) below the folder ``path``, a URI: one file and its index for each partition."""

    def write(rows: Iterator) -> None:
        from pyspark import TaskContext

        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        name, sizes = f"{root}/part-{TaskContext.get().partitionId():05d}", []
        with fs.open_output_stream(name) as file:
            for row in rows:
                data = zlib.compress((row.text or "").encode("utf-8", "surrogatepass"))
                sizes.append(len(data))
                file.write(data)
        with fs.open_output_stream(f"{name}.idx") as file:
            file.write(struct.pack(f"<{len(sizes)}i", *sizes))

    docs.select("text").foreachPartition(write)
