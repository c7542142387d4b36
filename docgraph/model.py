"""Keys, schemas and constructors of the tables that the operators exchange.

documents  key, version, doc (struct of typed columns, or any payload columns)
edges      tail, label, head, owner (keys), props (map of JSON values)
vertices   key, version (0: referred to, but no committed document)
reach      root, node (keys), depth
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = T.StructType([T.StructField(n, T.StringType()) for n in ("index", "type", "id")])
PROPS = T.MapType(T.StringType(), T.StringType())
EDGES = T.StructType(
    [T.StructField("tail", KEY), T.StructField("label", T.StringType()), T.StructField("head", KEY), T.StructField("owner", KEY), T.StructField("props", PROPS)]
)
#: Names that user properties may not take.
RESERVED = ("_identifier", "_owner", "_symbolic", "_symbolicOwner")
IN, OUT = "IN", "OUT"


def key(index: str | Column, kind: str | Column, id_: Column | str) -> Column:
    """A key struct; plain strings for index and type are literals, for id a column name."""

    def lit(x: str | Column) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    return F.struct(lit(index).cast("string").alias("index"), lit(kind).cast("string").alias("type"), (F.col(id_) if isinstance(id_, str) else id_).cast("string").alias("id"))


def key_text(k: Column | str) -> Column:
    k = F.col(k) if isinstance(k, str) else k
    return F.concat_ws("/", k["index"], k["type"], k["id"])


def as_documents(rows: DataFrame, index: str, kind: str, id_: Column | str, version: Column | int = 1) -> DataFrame:
    """Any table as documents: its columns become the struct doc."""
    v = F.lit(version) if isinstance(version, int) else version
    return rows.select(key(index, kind, id_).alias("key"), v.cast("long").alias("version"), F.struct(*[rows[c] for c in rows.columns]).alias("doc"))


def no_props() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
