"""Documents in a folder for each index and type, and the queue's overflow, on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder on a Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str) -> str:
        return "/".join((self.folder, *names))

    def exists(self, *names: str) -> bool:
        return self._fs.exists(self._path(self.at(*names)))

    def make(self, *names: str) -> None:
        self._fs.mkdirs(self._path(self.at(*names)))

    def remove(self, *names: str) -> bool:
        """Whether there was something to remove."""
        return self._fs.delete(self._path(self.at(*names)), True)

    def names(self, *names: str) -> list[str]:
        """What lies in a folder, by name; hidden names are left out."""
        if not self.exists(*names):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.at(*names))))
        return sorted(n for n in found if not n.startswith(("_", ".")))


class DocumentStore(Folder):
    """Indexes are created and deleted; documents of a type are added to an index. All documents of an index and type have one schema."""

    def create(self, index: str) -> None:
        if self.exists(index):
            raise FileExistsError(f"index {index} exists")
        self.make(index)

    def delete(self, index: str) -> bool:
        """Also if there is no such index; whether there was one."""
        return self.remove(index)

    def insert(self, documents: DataFrame, index: str, kind: str) -> None:
        """Adds those of the documents that belong to the index and type."""
        if not self.exists(index):
            raise FileNotFoundError(f"index {index} doesn't exist")
        k = F.col("key")
        documents.where((k["index"] == index) & (k["type"] == kind)).write.mode("append").parquet(self.at(index, kind))

    def types(self, index: str) -> list[str]:
        return self.names(index)

    def read(self, index: str, kind: str) -> DataFrame:
        return self.spark.read.parquet(self.at(index, kind))


class Overflow(Folder):
    """Changes that a full queue puts aside, in chunks that come back oldest first."""

    def save(self, changes: DataFrame, index: str, now_ms: int) -> str:
        """Changes of an index as one chunk, named by index and time."""
        name = f"{index}-overflow-{now_ms:015d}"
        changes.where(F.col("key")["index"] == index).write.parquet(self.at(name))
        return name

    def chunks(self, index: str) -> list[str]:
        """Names of the chunks of an index, oldest first."""
        head = f"{index}-overflow-"
        return sorted(n for n in self.names() if n.startswith(head) and n[len(head) :].isdigit())

    def load(self, index: str, most: int = 1) -> tuple[DataFrame | None, list[str]]:
        """The oldest chunks, and their names; they stay until they are dropped, so that a failed batch loses nothing."""
        names = self.chunks(index)[:most]
        return (self.spark.read.parquet(*[self.at(n) for n in names]) if names else None), names

    def drop(self, names: list[str]) -> None:
        for n in names:
            self.remove(n)
