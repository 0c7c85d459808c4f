"""Intermediate tables in the folder that all machines share.

Lineage is cut by writing Parquet into the folder named by ``spark.checkpoint.dir``. A lost executor
then costs only its own running tasks: finished tables are read again from the shared folder.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: A side is broadcast only if its rows, as counted, times their width stay below this.
BROADCAST_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; only a local master without the setting gets a temporary one."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="loamix-shared-")
    spark.sparkContext.setCheckpointDir(root)
    spark.conf.set(SETTING, root)
    return root


class Workspace:
    """A folder of intermediate tables of one run, removed when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/loamix/{label}-{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return the table read back."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.at(name))
        return self.load(name, df.schema)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.at(name))

    def _folder(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def drop(self, name: str) -> None:
        fs, path = self._folder(name)
        fs.delete(path, True)

    def only(self, *names: str) -> None:
        """Drop all tables but these."""
        fs, path = self._folder()
        for entry in fs.listStatus(path):
            if entry.getPath().getName() not in names:
                fs.delete(entry.getPath(), True)

    def make(self, name: str) -> str:
        """Create an empty folder for files that tasks write themselves."""
        fs, path = self._folder(name)
        fs.mkdirs(path)
        return self.at(name)

    def remove(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            fs, path = self._folder()
            fs.delete(path, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """A broadcast hint if the counted rows fit under ``limit`` bytes; else the join stays a shuffled one."""
    most = max(1, (limit or BROADCAST_BYTES) // row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
