"""Requests: decoding paths, matching configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode(calls: DataFrame, method: str = "method", path: str = "path") -> DataFrame:
    """Adds action, scope, index, type, id, version and valid from a method and a path of one to four parts.

    DELETE deletes, every other method updates; an update needs all four parts; a version must be a number.
    """
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    at = lambda i: F.when(n >= i, F.get(parts, F.lit(i - 1)))
    action = F.when(F.upper(method) == "DELETE", "DELETE").otherwise("UPDATE")
    scope = F.when(n == 1, "INDEX").when(n == 2, "TYPE_IN_INDEX").when(n == 3, "DOCUMENT_ANY_VERSION").when(n == 4, "DOCUMENT")
    version = F.expr("try_cast(`__v` AS bigint)")
    out = calls.withColumns({"action": action, "scope": scope, "index": at(1), "type": at(2), "id": at(3), "__v": at(4)}).withColumn("version", version)
    valid = F.col("scope").isNotNull() & (F.col("__v").isNull() | F.col("version").isNotNull()) & ((F.col("action") == "DELETE") | (F.col("scope") == "DOCUMENT"))
    return out.withColumn("valid", valid).drop("__v")


def judged(asked: DataFrame, documents: DataFrame, vertices: DataFrame, configs: DataFrame) -> DataFrame:
    """Adds status to requests for documents (key, version, valid): the first of INVALID_REQUEST, NO_CONFIGURATION, NOT_IN_GRAPH (no
    vertex with a document), SOURCE_MISSING, EXPIRED (the store has another version) that applies, or OK. A null version asks for whatever there is."""
    stored = documents.select("key", F.col("version").alias("__stored"))
    known = vertices.where("version > 0").select("key", F.lit(True).alias("__known"))
    configured = match_configs(asked.select("key").distinct(), configs).groupBy("key").agg(F.bool_or(F.col("target_index").isNotNull()).alias("__configured"))
    out = asked.join(stored, "key", "left").join(known, "key", "left").join(configured, "key", "left")
    status = (
        F.when(~F.coalesce("valid", F.lit(False)), "INVALID_REQUEST").when(~F.coalesce("__configured", F.lit(False)), "NO_CONFIGURATION").when(F.col("__known").isNull(), "NOT_IN_GRAPH")
        .when(F.col("__stored").isNull(), "SOURCE_MISSING").when(F.col("__stored") != F.coalesce("version", "__stored"), "EXPIRED").otherwise("OK")
    )
    return out.withColumn("status", status).drop("__stored", "__known", "__configured")


def match_configs(documents: DataFrame, configs: DataFrame) -> DataFrame:
    """Each document's configurations, and those without any as one row with nulls. configs: a small table, a row for each configuration."""
    k = F.col("key")
    on = (k["index"] == F.col("source_index")) & (F.col("source_type").isNull() | (k["type"] == F.col("source_type")))
    return documents.join(F.broadcast(configs), on, "left")


#: From the widest scope to the narrowest.
SCOPES = ("INDEX", "TYPE_IN_INDEX", "DOCUMENT_ANY_VERSION", "DOCUMENT")


def in_scope(scope: Column, of: Column) -> Column:
    """Whether a request of one scope lies within another, which must be as wide at least; null for unknown scopes."""
    known = F.array(*[F.lit(s) for s in SCOPES])
    place = lambda c: F.nullif(F.array_position(known, c), F.lit(0))
    return place(of) <= place(scope)
