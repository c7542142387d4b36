"""The property graph as DataFrames: construction, lookups, commits and deletes.

Edges carry version-less keys and their owner. Vertices follow from committed documents and edges, so a commit
is a replacement of the owner's edges, and what must be collected or claimed falls out of the definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import IN, key, no_props


def vertices(committed: DataFrame, edges: DataFrame) -> DataFrame:
    """key, version: committed documents (key, version) and every end of an edge; 0 for ends without a document."""
    ends = edges.select(F.explode(F.array("tail", "head")).alias("key"), F.lit(0).cast("long").alias("version"))
    return committed.select("key", F.col("version").cast("long").alias("version")).unionByName(ends).groupBy("key").agg(F.max("version").alias("version"))


def symbolic(all_vertices: DataFrame) -> DataFrame:
    return all_vertices.where("version = 0")


def in_index(df: DataFrame, index: str, column: str = "key") -> DataFrame:
    return df.where(F.col(column)["index"] == index)


def in_type(df: DataFrame, index: str, kind: str, column: str = "key") -> DataFrame:
    return df.where((F.col(column)["index"] == index) & (F.col(column)["type"] == kind))


def resolve(all_vertices: DataFrame, index: str, kind: str, id_: str, version: int | None = None) -> DataFrame:
    """The vertex of a key; with a version, only if it has exactly that one."""
    k = F.col("key")
    found = all_vertices.where((k["index"] == index) & (k["type"] == kind) & (k["id"] == id_))
    return found if version is None else found.where(F.col("version") == version)


def find_edges(edges: DataFrame, tail: Column, label: str, head: Column) -> DataFrame:
    return edges.where((F.col("tail") == tail) & (F.col("label") == label) & (F.col("head") == head))


def owned_by(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges of the documents in owners (key)."""
    return edges.join(owners.select(F.col("key").alias("owner")), "owner", "left_semi").select(edges.columns)


def incident(edges: DataFrame, keys: DataFrame, direction: str) -> DataFrame:
    """key, label, other: the edges that come in to or go out of the keys, with their other ends."""
    at, other = ("head", "tail") if direction == IN else ("tail", "head")
    return keys.select("key").join(edges.select(F.col(at).alias("key"), "label", F.col(other).alias("other")), "key")


def ownable(owner: Column, version: Column, me: Column) -> Column:
    """Whether a document may take a vertex: nobody or itself (in any version) owns it, or it is only referred to (version 0)."""
    return owner.isNull() | owner.eqNullSafe(me) | (version == 0)


def opposite(edge_tail: Column, edge_head: Column, me: Column) -> Column:
    return F.when(edge_head == me, edge_tail).otherwise(edge_head)


def owner_conflicts(edges: DataFrame) -> DataFrame:
    """Edges that several documents own."""
    return edges.groupBy("tail", "label", "head").agg(F.countDistinct("owner").alias("owners")).where("owners > 1")


def commit(committed: DataFrame, edges: DataFrame, batch: DataFrame, batch_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New committed, new edges, rejected. batch: key, version, one row for each key.

    Rejected are versions that aren't positive or are older than the committed one, with their edges. Accepted documents replace
    their version and all edges that they own.
    """
    known = committed.select("key", F.col("version").alias("known"))
    judged = batch.join(known, "key", "left").withColumn("ok", (F.col("version") > 0) & (F.col("version") >= F.coalesce("known", F.lit(0))))
    accepted = judged.where("ok").drop("known", "ok")
    rejected = judged.where("NOT ok").drop("known", "ok")
    now = committed.join(accepted.select("key"), "key", "left_anti").unionByName(accepted.select(committed.columns))
    kept = edges.join(accepted.select(F.col("key").alias("owner")), "owner", "left_anti").select(edges.columns)
    return now, kept.unionByName(owned_by(batch_edges, accepted)), rejected


def delete(committed: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New committed and edges without the documents in gone (key). Ends that others refer to stay as symbolic vertices."""
    keys = gone.select("key")
    return committed.join(keys, "key", "left_anti"), edges.join(keys.select(F.col("key").alias("owner")), "owner", "left_anti").select(edges.columns)


def affected_by_delete(before: DataFrame, after: DataFrame) -> DataFrame:
    """Vertices that go away or become symbolic: key, version before, fate."""
    now = after.select("key", F.col("version").alias("now"))
    joined = before.join(now, "key", "left")
    fate = F.when(F.col("now").isNull(), "gone").when((F.col("now") == 0) & (F.col("version") > 0), "symbolic")
    return joined.withColumn("fate", fate).where("fate IS NOT NULL").select("key", "version", "fate")


def duplicates(all_vertices: DataFrame) -> DataFrame:
    """Keys that stand twice; there are none in a sound graph."""
    return all_vertices.groupBy("key").count().where("count > 1")


def draw(*parts: Column | str) -> Column:
    """A number in [0, 1) that follows from the parts: the first 32 bits of an MD5 sum."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("double") / (1 << 32)


def random_graph(numbers: DataFrame, p: float, seed: str = "1") -> DataFrame:
    """Edges of a graph that grows by the vertices of numbers (n: 0, 1, 2, ...): with each new vertex comes, where a random
    number exceeds p, one edge between two earlier ones, unless these are the same. The drawn numbers follow from seed and n, so lost tasks draw them again."""
    ends = numbers.where(draw(seed, "keep", F.col("n")) > p).select("n", *[F.floor(draw(seed, e, F.col("n")) * F.col("n")).alias(e) for e in ("a", "b")]).where("a <> b")
    k = lambda c: key("random", "v", c)
    return ends.select(k("a").alias("tail"), F.lit("edge").alias("label"), k("b").alias("head"), k("n").alias("owner"), no_props().alias("props"))
