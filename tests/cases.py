"""Small helpers for graph cases."""

from pyspark.sql import functions as F

from docgraph.model import EDGES, key

DOCS = "index string, type string, id string, version long, source string"


def docs(spark, rows):
    d = spark.createDataFrame([(*r, None)[:5] if len(r) == 4 else r for r in rows], DOCS)
    return d.select(key(F.col("index"), F.col("type"), "id").alias("key"), "version", F.struct("source").alias("doc"))


def edges(spark, rows):
    """(tail, label, head, owner) with keys as 'a/b/c'."""
    k = lambda x: tuple(x.split("/"))
    return spark.createDataFrame([(k(t), lab, k(h), k(o), {}) for t, lab, h, o in rows], EDGES)


def keys(spark, names):
    return spark.createDataFrame([(tuple(n.split("/")),) for n in names], "key struct<index:string,type:string,id:string>")


def text(row):
    return "/".join(row)
