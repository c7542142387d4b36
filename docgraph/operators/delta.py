"""Graph deltas: what changed between two snapshots, as commands for a visual client.

an, ae add; cn, ce change; dn, de delete nodes and edges. A property that was removed appears with null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import IN, OUT, key_text
from .graph import incident


def diff(before: DataFrame, after: DataFrame, name: str, props: str, kind: str) -> DataFrame:
    """op, name, props. kind: n or e; props is a map of strings."""
    a, b = before.select(name, F.col(props).alias("old")), after.select(name, F.col(props).alias("new"))
    both = a.join(b, name, "full_outer")
    op = F.when(F.col("old").isNull(), f"a{kind}").when(F.col("new").isNull(), f"d{kind}").otherwise(f"c{kind}")
    changed = F.map_filter("new", lambda k, v: ~v.eqNullSafe(F.try_element_at(F.col("old"), k)))
    removed = F.transform_values(F.map_filter("old", lambda k, v: ~F.map_contains_key(F.col("new"), k)), lambda k, v: F.lit(None).cast("string"))
    made = F.when(op == f"a{kind}", F.col("new")).when(op == f"d{kind}", F.map_filter("old", lambda k, v: F.lit(False))).otherwise(F.map_concat(changed, removed))
    return both.select(op.alias("op"), F.col(name).alias("name"), made.alias("props")).where((F.col("op") != f"c{kind}") | (F.size("props") > 0))


def nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Commands between two vertex tables (key, version): a version is a property."""
    shape = lambda v: v.select(key_text("key").alias("name"), F.create_map(F.lit("version"), F.col("version").cast("string")).alias("props"))
    return diff(shape(before), shape(after), "name", "props", "n")


def edge_name(tail: Column | str, label: Column | str, head: Column | str) -> Column:
    lab = F.col(label) if isinstance(label, str) else label
    return F.concat(key_text(tail), F.lit("--"), lab, F.lit("->"), key_text(head))


def edges(before: DataFrame, after: DataFrame) -> DataFrame:
    shape = lambda e: e.select(
        edge_name("tail", "label", "head").alias("name"),
        F.map_concat("props", F.create_map(F.lit("source"), key_text("tail"), F.lit("target"), key_text("head"), F.lit("directed"), F.lit("true"))).alias("props"),
    ).dropDuplicates(["name"])
    return diff(shape(before), shape(after), "name", "props", "e")


def encoded(commands: DataFrame) -> DataFrame:
    """One JSON object for each command, {op: {name: props}}; added nodes and edges get size 1 unless they have a size."""
    sized = F.when(F.col("op").isin("an", "ae") & ~F.map_contains_key("props", F.lit("size")), F.map_concat("props", F.create_map(F.lit("size"), F.lit("1")))).otherwise(F.col("props"))
    return commands.withColumn("props", sized).select("op", "name", F.to_json(F.create_map("op", F.create_map("name", "props")), {"ignoreNullFields": "false"}).alias("command"))


def unfold(all_edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Add-commands for the keys' neighbours in both directions and the edges to them, in their true direction."""
    into = incident(all_edges, keys, IN).select(F.col("other").alias("tail"), "label", F.col("key").alias("head"), "other")
    out = incident(all_edges, keys, OUT).select(F.col("key").alias("tail"), "label", F.col("other").alias("head"), "other")
    both = into.unionByName(out)
    seen = both.select(F.lit("an").alias("op"), key_text("other").alias("name")).distinct()
    links = both.select(F.lit("ae").alias("op"), edge_name("tail", "label", "head").alias("name")).distinct()
    return seen.unionByName(links)


def snapshots(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key and state (added, removed, changed) of rows whose value differs."""
    a, b = before.select(key, F.col(value).alias("a"), F.lit(1).alias("x")), after.select(key, F.col(value).alias("b"), F.lit(1).alias("y"))
    state = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state IS NOT NULL")


def state_hash(files: DataFrame, path: str, content: str) -> DataFrame:
    """A hash of a set of files that doesn't depend on their order."""
    return files.agg(F.bit_xor(F.xxhash64(path, content)).alias("state"), F.count("*").alias("files"))
