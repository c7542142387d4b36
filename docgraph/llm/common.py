"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpointed, shared_dir

LAST_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b), for every node that isn't that smallest one itself.

    Alternates large-star and small-star steps: each node's neighbours are linked to its smallest
    neighbour. Minima are pre-aggregated and joined back, so no neighbourhood is collected; each round is a
    checkpoint, and it ends as soon as all edges form stars.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("o").alias("o"), F.max("i").alias("i")).where("o > 1 OR (o = 1 AND i = 1)").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.where("m < a").select("a", F.col("m").alias("b")))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        e = checkpointed(e)
    raise RuntimeError("components did not converge")


def joined_components(named: DataFrame, links: DataFrame) -> DataFrame:
    """named (node, component) after further links (a, b): only the links between components are worked on."""
    short = links
    for c in ("a", "b"):
        short = short.join(named.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
    short = checkpointed(short.select(F.col("a_in").alias("a"), F.col("b_in").alias("b")).where("a <> b").distinct())
    if short.isEmpty():
        return named
    over = components(short).select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = named.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return moved.unionAll(over.select(F.col("component").alias("node"), F.col("top").alias("component")))
