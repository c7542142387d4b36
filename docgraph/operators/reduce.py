"""Reductions of what a walk reached to one value for each root."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(resolved: DataFrame, by_root: DataFrame, columns: dict[str, Column], where: Column | None = None) -> DataFrame:
    """root and one column for each aggregate; roots without rows get nulls (0 for counts is the caller's coalesce).

    Aggregates are partial before the shuffle, so a hot root costs one row for each task.
    """
    rows = resolved if where is None else resolved.where(where)
    made = rows.groupBy("root").agg(*[c.alias(n) for n, c in columns.items()])
    return by_root.select(F.col("key").alias("root")).distinct().join(made, "root", "left")


def in_degree(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """key, in_degree: how many edges come in."""
    counted = edges.groupBy(F.col("head").alias("key")).agg(F.count("*").alias("in_degree"))
    return keys.select("key").join(counted, "key", "left").select("key", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def collected(value: Column) -> Column:
    """A sorted list of the reached documents' values."""
    return F.sort_array(F.collect_list(value))


def nodes(tree: dict) -> list[dict]:
    """All nodes of a document tree, breadth first."""
    out, level = [], [tree]
    while level:
        out += level
        level = [c for n in level for c in n["_children"]]
    return out


def by_tree(trees: DataFrame, documents: DataFrame, function: Callable[[dict], object], name: str = "value") -> DataFrame:
    """root and the JSON text of function(tree) for each root's traversal tree.

    A node is {"_value": {"exists", "value", "edge", "vertex"}, "_children": [...]}. A root's tree is
    built in one task. Where the function fails the value is null.
    """
    text = lambda c: F.to_json(F.col(c))
    store = documents.select(F.col("key").alias("node"), F.to_json("doc").alias("doc"))
    rows = trees.join(store, "node", "left").select(text("root").alias("root"), text("node").alias("node"), text("parent").alias("parent"), "label", "seq", "doc")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made: dict[str, dict] = {}
        top = None
        for r in pdf.sort_values("seq").itertuples(index=False):
            vertex = list(json.loads(r.node).values())
            value: dict = {"exists": isinstance(r.doc, str), "vertex": vertex}
            if isinstance(r.doc, str):
                value["value"] = json.loads(r.doc)
            if isinstance(r.parent, str):
                value["edge"] = {"label": r.label, "from": list(json.loads(r.parent).values())}
            made[r.node] = {"_value": value, "_children": []}
            if isinstance(r.parent, str):
                made[r.parent]["_children"].append(made[r.node])
            else:
                top = made[r.node]
        try:
            got = json.dumps(function(top), sort_keys=True)
        except Exception:  # noqa: BLE001  a failing reduction gives null, as documented
            got = None
        return pd.DataFrame({"root": [pdf["root"].iloc[0]], name: [got]})

    made = rows.groupBy("root").applyInPandas(build, f"root string, {name} string")
    return made.select(F.from_json("root", "struct<index:string,type:string,id:string>").alias("root"), name)
