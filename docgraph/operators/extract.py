"""Edges from documents: declarative rules, orientation, validation and merging.

Rules are column expressions, so scans are pruned to the referenced columns and nothing leaves the JVM. A
rule may also be any function from documents to (key, other, label, inwards, props).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import RESERVED, key, no_props


@dataclass(frozen=True)
class Reference:
    """One edge from a field of the document (nothing where it is null)."""

    label: str
    index: str
    kind: str
    id_: Callable[[Column], Column]
    inwards: bool = False
    props: Callable[[Column], Column] | None = None

    def rows(self, docs: DataFrame) -> DataFrame:
        return self._rows(docs.select("key", "doc", self.id_(F.col("doc")).alias("ref")))

    def _rows(self, docs: DataFrame) -> DataFrame:
        props = self.props(F.col("doc")) if self.props else no_props()
        return docs.where("ref IS NOT NULL").select(
            "key", key(self.index, self.kind, "ref").alias("other"), F.lit(self.label).alias("label"), F.lit(self.inwards).alias("inwards"), props.alias("props")
        )


@dataclass(frozen=True)
class References(Reference):
    """One edge for each element of an array."""

    def rows(self, docs: DataFrame) -> DataFrame:
        return self._rows(docs.select("key", "doc", F.explode(self.id_(F.col("doc"))).alias("ref")))


@dataclass(frozen=True)
class Matches(Reference):
    """One edge for each match of a pattern's first group in a text."""

    pattern: str = "(.*)"

    def rows(self, docs: DataFrame) -> DataFrame:
        return self._rows(docs.select("key", "doc", F.explode(F.regexp_extract_all(self.id_(F.col("doc")), F.lit(self.pattern), 1)).alias("ref")))


@dataclass(frozen=True)
class Custom:
    """Any function from documents to rows of key, other, label, inwards, props."""

    function: Callable[[DataFrame], DataFrame]

    def rows(self, docs: DataFrame) -> DataFrame:
        return self.function(docs).select("key", "other", "label", "inwards", "props")


def oriented(rows: DataFrame) -> DataFrame:
    """Relative edges as tail, label, head, owner, props: inwards means other -> document."""
    tail = F.when(F.col("inwards"), F.col("other")).otherwise(F.col("key"))
    head = F.when(F.col("inwards"), F.col("key")).otherwise(F.col("other"))
    return rows.select(tail.alias("tail"), "label", head.alias("head"), F.col("key").alias("owner"), "props")


def extract(docs: DataFrame, rules: Iterable) -> DataFrame:
    """All edges of the documents. The same edge twice in one document is one edge."""
    parts = [oriented(r.rows(docs)) for r in rules]
    if not parts:
        raise ValueError("no rules")
    return merged(parts)


def merged(parts: list[DataFrame]) -> DataFrame:
    """The union of edges. Of several with one owner, tail, label and head, the last part's properties stay."""
    if len(parts) == 1:
        numbered = parts[0].withColumn("__at", F.lit(0))
    else:
        numbered = reduce(DataFrame.unionByName, [p.withColumn("__at", F.lit(i)) for i, p in enumerate(parts)])
    return numbered.groupBy("tail", "label", "head", "owner").agg(F.max_by("props", "__at").alias("props")).select("tail", "label", "head", "owner", "props")


def self_loops(edges: DataFrame) -> DataFrame:
    """Edges from a document to itself; a document with one is rejected."""
    return edges.where(F.col("tail") == F.col("head"))


def without_rejected(edges: DataFrame) -> DataFrame:
    """Edges of documents that have no self-loop."""
    bad = self_loops(edges).select("owner").distinct()
    return edges.join(bad, "owner", "left_anti").select(edges.columns)


def merged_props(parts: list[Column]) -> Column:
    """Properties of several configurations; the last one wins."""
    return F.map_from_entries(
        F.aggregate(
            F.flatten(F.array(*[F.map_entries(p) for p in parts])), F.array().cast("array<struct<key:string,value:string>>"),
            lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)),
        )
    )


def valid_props(props: Column) -> Column:
    """Whether no property has a reserved name."""
    return ~F.exists(F.map_keys(props), lambda k: k.isin(*RESERVED))
