"""Reached vertices joined with the documents they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK, EXPIRED, MISSING = "OK", "EXPIRED", "MISSING"


def get(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests (key, ...) with the document of any version, its version (stored), and whether there is one (found)."""
    store = documents.select("key", F.col("version").alias("stored"), "doc")
    return requests.join(store, "key", "left").withColumn("found", F.col("stored").isNotNull())


def get_versioned(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests (key, version, ...) with the document and a status: missing, or expired where the store has another version."""
    store = documents.select("key", F.col("version").alias("stored"), "doc")
    status = F.when(F.col("stored").isNull(), MISSING).when(F.col("stored") != F.col("version"), EXPIRED).otherwise(OK)
    return requests.join(store, "key", "left").withColumn("status", status)


def resolve(reached: DataFrame, documents: DataFrame, graph_vertices: DataFrame | None = None) -> DataFrame:
    """reached (root, node, ...) with doc, exists and expired.

    A vertex without a document exists as a node without content. With vertices (key, version), a document whose
    version differs from its vertex is expired.
    """
    store = documents.select(F.col("key").alias("node"), F.col("version").alias("stored"), "doc")
    out = reached.join(store, "node", "left")
    if graph_vertices is not None:
        out = out.join(graph_vertices.select(F.col("key").alias("node"), F.col("version").alias("wanted")), "node", "left")
        expired = (F.coalesce("wanted", F.lit(0)) > 0) & F.col("stored").isNotNull() & (F.col("wanted") != F.col("stored"))
        fetched = F.coalesce("wanted", F.lit(0)) > 0
    else:
        expired, fetched = F.lit(False), F.lit(True)
    exists = F.col("stored").isNotNull() & fetched & ~expired
    doc = F.when(exists, F.col("doc"))
    return out.select(*reached.columns, doc.alias("doc"), exists.alias("exists"), expired.alias("expired"))


def expired_roots(resolved: DataFrame) -> DataFrame:
    """Roots with an expired vertex anywhere in their tree; they aren't recomputed."""
    return resolved.groupBy("root").agg(F.bool_or("expired").alias("expired")).where("expired").select("root")
