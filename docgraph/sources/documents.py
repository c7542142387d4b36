"""Documents from tables and JSON folders, and writing them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import as_documents, key

#: Key columns of the tables that have one.
TABLE_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "documents": "doc_id", "labels": "doc_id", "pages": "url", "events": "event_id", "embeddings": "vec_id", "benchmark": "item_id",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_documents(spark: SparkSession, folder: str, name: str, index: str = "shop") -> DataFrame:
    """A table's rows as documents of version 1."""
    return as_documents(table(spark, folder, name), index, name, TABLE_KEYS[name])


def json_folder(spark: SparkSession, folder: str) -> DataFrame:
    """key, version 1, doc (one string column source) of <folder>/<index>/<type>/<id>.json; mapping.json files are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder).withColumn("path", F.input_file_name())
    parts = F.split("path", "/")
    name = F.regexp_replace(F.url_decode(F.element_at(parts, -1)), r"\.json$", "")
    made = files.select(key(F.element_at(parts, -3), F.element_at(parts, -2), name).alias("key"), F.lit(1).cast("long").alias("version"), F.struct(F.col("value").alias("source")).alias("doc"))
    return made.where(F.col("key")["id"] != "mapping")


def valid_json(documents: DataFrame) -> DataFrame:
    """Adds valid: whether the source is JSON; a faulty file is named by its key."""
    return documents.withColumn("valid", F.expr("try_parse_json(doc.source) IS NOT NULL"))


def write_targets(targets: DataFrame, folder: str) -> None:
    """Target documents as Parquet, one folder for each index and type."""
    targets.select(F.col("key")["index"].alias("index"), F.col("key")["type"].alias("type"), F.col("key")["id"].alias("id"), "doc").write.mode("overwrite").partitionBy("index", "type").parquet(folder)


def write_json(targets: DataFrame, folder: str) -> None:
    """Target documents as JSON lines {"id", "doc"}, one folder for each index and type; `read_json` gives them back."""
    rows = targets.select(F.col("key")["index"].alias("index"), F.col("key")["type"].alias("type"), F.to_json(F.struct(F.col("key")["id"].alias("id"), "doc")).alias("value"))
    rows.write.mode("overwrite").partitionBy("index", "type").text(folder)


def read_json(spark: SparkSession, folder: str, doc: str) -> DataFrame:
    """key, doc of documents that write_json wrote; doc: their schema."""
    rows = spark.read.option("basePath", folder).text(folder)
    value = F.from_json("value", f"struct<id:string,doc:{doc}>")
    return rows.select(key(F.col("index"), F.col("type"), value["id"]).alias("key"), value["doc"].alias("doc"))


def scan(documents: DataFrame, indexes: list[str], kind: str | None = None) -> DataFrame:
    """Keys and versions of the documents of some indexes (and a type)."""
    found = documents.where(F.col("key")["index"].isin(indexes))
    return (found if kind is None else found.where(F.col("key")["type"] == kind)).select("key", "version")
