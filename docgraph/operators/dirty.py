"""Which documents a change affects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Registry
from ..model import IN, OUT
from ..storage import checkpointed
from . import graph
from .walk import reachable


def affected(edges: DataFrame, changed: DataFrame, directions: tuple[str, ...] = (IN, OUT), max_depth: int | None = None) -> DataFrame:
    """Keys in any walk from the changed keys, themselves included.

    Both directions by default. With only the directions opposite to the configured walks, fewer are recomputed.
    """
    ends = checkpointed(edges.select("tail", "head"))
    out = changed.select("key")
    for d in directions:
        out = out.unionByName(reachable(ends, changed, d, max_depth).select(F.col("node").alias("key")))
    return out.distinct()


def requests(keys: DataFrame, vertices: DataFrame, registry: Registry) -> DataFrame:
    """key, version, target_index, target_type: affected documents that exist, with each matching configuration."""
    live = keys.join(vertices.where("version > 0"), "key")
    configs = F.broadcast(registry.table(keys.sparkSession))  # a row for each configuration
    match = (F.col("key")["index"] == F.col("source_index")) & (F.col("source_type").isNull() | (F.col("key")["type"] == F.col("source_type")))
    return live.join(configs, match).select("key", "version", "target_index", "target_type").distinct()


def around_commit(before: DataFrame, after: DataFrame, changed: DataFrame, directions: tuple[str, ...] = (IN, OUT), pre_by_key: bool = True, max_depth: int | None = None) -> DataFrame:
    """Keys affected before or after a commit. before, after: edges. Without pre_by_key only the state after the commit counts."""
    now = affected(after, changed, directions, max_depth)
    return now if not pre_by_key else now.unionByName(affected(before, changed, directions, max_depth)).distinct()


def after_delete(edges: DataFrame, before: DataFrame, after: DataFrame, gone: DataFrame) -> DataFrame:
    """Keys to recompute after a delete: what the deleted reached, without what no longer exists. before, after: vertices."""
    fate = graph.affected_by_delete(before, after)
    return affected(edges, gone).join(fate, "key", "left_anti")


def fan_out(wanted: DataFrame, vertices: DataFrame) -> DataFrame:
    """Requests on documents from requests with a scope. wanted: request, action, index, type, id, version, of which trailing parts may be null.

    An index or a type stands for all its vertices, symbolic ones included; a document without a version for its current one.
    """
    k = F.col("key")
    on = (
        (F.col("index") == k["index"]) & (F.col("type").isNull() | (F.col("type") == k["type"])) & (F.col("id").isNull() | (F.col("id") == k["id"]))
    )
    asked = wanted.withColumnRenamed("version", "asked")
    return asked.join(vertices, on).select("request", "action", "key", F.coalesce("asked", "version").alias("version"))
