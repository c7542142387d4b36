"""Folders shared by driver and executors, checkpoints, and versioned snapshots."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; set here only in local mode where it is unset."""
    here = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if here:
        return here.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    here = f"file:///tmp/docgraph-checkpoints-{os.getuid()}"
    spark.sparkContext.setCheckpointDir(here)
    return here


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df in the shared folder, with the lineage cut; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Snapshots:
    """Named tables in numbered versions under one folder. A version counts once its marker exists, so readers never see half a commit."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}").rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> int:
        """The newest committed version; 0 if there is none."""
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return max((int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.folder}/{n}/_COMMITTED"))), default=0)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v={version or self.current()}/{table}")

    def drop_old(self, keep: int) -> None:
        """Removes all but the last `keep` committed versions, and what aborted commits have left before them."""
        newest = self.current()
        for s in self._fs.listStatus(self._path(self.folder)) if newest else ():
            name = s.getPath().getName()
            if name.startswith("v=") and int(name[2:]) <= newest - keep:
                self._fs.delete(s.getPath(), True)

    def commit(self, **tables: DataFrame) -> int:
        """Writes all tables as the next version, then its marker."""
        version = self.current() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/v={version}/{name}")
        self._fs.create(self._path(f"{self.folder}/v={version}/_COMMITTED"), True).close()
        return version
