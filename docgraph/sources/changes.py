"""Change feeds: the records that say which document changed to which version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import change_from_text
from ..model import key


def stream(spark: SparkSession, folder: str, index: str, files_per_trigger: int = 100) -> DataFrame:
    """Changes from a growing folder of text files, one record a line: action, key, version, retries."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parsed(lines, index)


def parsed(lines: DataFrame, index: str) -> DataFrame:
    c = lines.select(change_from_text(F.col("value")).alias("c"))
    return c.select("c.action", key(F.lit(index), F.col("c.type"), F.col("c.id")).alias("key"), "c.version", "c.retries")


def public_only(changes: DataFrame) -> DataFrame:
    """Without the indexes whose names start with an underscore."""
    return changes.where(~F.col("key")["index"].startswith("_"))


def latest(changes: DataFrame) -> DataFrame:
    """The newest change of each key; of equal versions, a delete wins."""
    order = F.struct("version", (F.col("action") == "DELETE").alias("is_delete"))
    return changes.groupBy("key").agg(F.max_by(F.struct("action", "version", "retries"), order).alias("c")).select("key", "c.*")


def queue_sizes(changes: DataFrame) -> DataFrame:
    return changes.groupBy(F.col("key")["index"].alias("index")).agg(F.count("*").alias("waiting"))
