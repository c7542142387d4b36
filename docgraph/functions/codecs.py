"""Text forms of keys, edges and properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_json(k: Column, version: Column) -> Column:
    """[index, type, id, version] as JSON text."""
    quoted = [F.to_json(F.array(k[n])) for n in ("index", "type", "id")]
    return F.concat(F.lit("["), F.concat_ws(",", *[F.substr(q, F.lit(2), F.length(q) - 2) for q in quoted], version.cast("string")), F.lit("]"))


def id_from_json(c: Column) -> Column:
    a = F.from_json(c, "array<string>")
    return F.struct(a[0].alias("index"), a[1].alias("type"), a[2].alias("id"), a[3].cast("long").alias("version"))


def edge_json(tail: Column, label: Column, head: Column) -> Column:
    return F.to_json(F.struct(tail.alias("tail"), label.alias("label"), head.alias("head")))


def change_text(action: Column, kind: Column, version: Column, retries: Column, id_: Column) -> Column:
    """action,type,version,retries,id; the id comes last and may hold commas."""
    return F.concat_ws(",", action, kind, version.cast("string"), retries.cast("string"), id_)


def change_from_text(c: Column) -> Column:
    p = F.split(c, ",", 5)
    return F.struct(p[0].alias("action"), p[1].alias("type"), p[2].cast("long").alias("version"), p[3].cast("int").alias("retries"), p[4].alias("id"))


def encoded_props(values: dict[str, Column]) -> Column:
    """A property map of JSON values."""
    items = [x for k, v in values.items() for x in (F.lit(k), F.to_json(F.struct(v.alias("v"))))]
    wrapped = F.create_map(*items)
    return F.transform_values(wrapped, lambda k, v: F.substr(v, F.lit(6), F.length(v) - 6))
