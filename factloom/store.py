"""Versioned snapshots of tables in a folder that Spark reads and writes.

A snapshot is written beside the older ones and becomes current when an empty file named by its version is made, so a reader sees
the old tables or the new ones, and no plan overwrites what it reads.  One writer at a time.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names.  A session on this machine alone gets a folder of it; on a cluster it is an error
    if none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-"))
    return context.getCheckpointDir().rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def committed(spark: SparkSession, folder: str) -> bool:
    """Whether a write into this folder has come to its end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        base = self._path(f"{self.folder}/_commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(base)) if self._fs.exists(base) else []

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as of a version (the current one, if none is named)."""
        done = [v for v in self.versions() if version is None or v <= version]
        for v in reversed(done):
            if self._fs.exists(self._path(f"{self.folder}/{v}/{table}")):
                return self.spark.read.parquet(f"{self.folder}/{v}/{table}")
        raise LookupError(f"no committed snapshot of {table}")

    def commit(self, **tables: DataFrame) -> int:
        """Writes the tables as the next version; other tables stay as they are."""
        new = max(self.versions(), default=0) + 1
        self._fs.delete(self._path(f"{self.folder}/{new}"), True)  # left by a writer that failed
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{new}/{name}")
        self._fs.mkdirs(self._path(f"{self.folder}/_commits"))
        if not self._fs.createNewFile(self._path(f"{self.folder}/_commits/{new}")):
            raise RuntimeError("another writer has committed this version")
        return new
