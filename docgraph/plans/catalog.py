"""The star tables as documents and their references as a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Property, Registry, SourceConfig, Walk
from ..model import EDGES, IN, OUT, as_documents, key, no_props
from ..operators.extract import Matches, Reference, extract
from ..sources.documents import table, table_documents

RULES = {
    "orders": (Reference("placed_by", "shop", "customer", lambda d: d["o_custkey"]),),
    "customer": (Reference("lives_in", "shop", "nation", lambda d: d["c_nationkey"]),),
    "supplier": (Reference("lives_in", "shop", "nation", lambda d: d["s_nationkey"]),),
    "nation": (Reference("part_of", "shop", "region", lambda d: d["n_regionkey"]),),
    "labels": (Reference("labels", "shop", "documents", lambda d: d["doc_id"]),),
}
HREF = r'href="([^"]+)"'
PAGE_LINKS = (Matches("links_to", "web", "pages", lambda d: d["html"], pattern=HREF),)


def documents(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: table_documents(spark, folder, n) for n in names}


def keys_of(docs: dict[str, DataFrame]) -> DataFrame:
    """key, version of all documents."""
    return reduce(DataFrame.unionByName, [d.select("key", "version") for d in docs.values()])


def edges_of(docs: dict[str, DataFrame]) -> DataFrame:
    """The edges of all documents that have rules. Tables have one owner each, so parts are simply put together."""
    parts = [r.rows(docs[n]) for n in docs for r in RULES.get(n, ())]
    from ..operators.extract import oriented

    return reduce(DataFrame.unionByName, [oriented(p) for p in parts])


def star(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    docs = documents(spark, folder, "orders", "customer", "nation", "region")
    return docs, edges_of(docs)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return as_documents(table(spark, folder, "pages"), "web", "pages", "url")


def page_edges(spark: SparkSession, folder: str) -> DataFrame:
    return extract(pages(spark, folder), PAGE_LINKS)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as documents conv_id-turn."""
    c = table(spark, folder, "conversations")
    return as_documents(c, "chat", "turn", F.concat_ws("-", c["conv_id"], c["turn"]))


def turn_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn answers the one before it."""
    answers = Reference("answers", "chat", "turn", lambda d: F.when(d["turn"] > 0, F.concat_ws("-", d["conv_id"], d["turn"] - 1)))
    return extract(turns(spark, folder), (answers,))


def transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct transitions between event types of a user as edges, loops included."""
    e = table(spark, folder, "events")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = e.select("event_type", following.alias("to")).where("to IS NOT NULL").distinct()
    me = key("log", "type", "event_type")
    return pairs.select(me.alias("tail"), F.lit("then").alias("label"), key("log", "type", "to").alias("head"), me.alias("owner"), no_props().alias("props"))


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a change log: a user's n-th event is version n; purchases are deletes."""
    e = table(spark, folder, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    action = F.when(F.col("event_type") == "purchase", "DELETE").otherwise("UPDATE")
    return e.select(action.alias("action"), key("users", "user", "user_id").alias("key"), n.cast("long").alias("version"), F.lit(0).alias("retries"), "event_id", "event_type")


def together(docs: dict[str, DataFrame]) -> DataFrame:
    """Documents of several tables as one table: the struct doc has the columns of all of them."""
    made = None
    for d in docs.values():
        flat = d.select("key", "version", "doc.*")
        made = flat if made is None else made.unionByName(flat, allowMissingColumns=True)
    return made.select("key", "version", F.struct(*[c for c in made.columns if c not in ("key", "version")]).alias("doc"))


def customer_config(name: str = "customer") -> SourceConfig:
    """Customers with what is known of their orders."""
    is_order = lambda k, d: F.col("depth") == 1
    order_properties = (
        Property("n_orders", lambda d: F.count("*"), empty=0),
        Property("total", lambda d: F.sum(d["o_totalprice"].cast("decimal(18,2)"))),
        Property("first_orders", lambda d: F.slice(F.sort_array(F.collect_list(d["o_orderkey"])), 1, 3)),
    )
    return SourceConfig("enriched", name, "shop", "customer", extract=RULES["customer"], walks=(Walk("orders", IN, order_properties, depth=1, where=is_order),))


def registry() -> Registry:
    return Registry([
        customer_config(),
        SourceConfig("enriched", "order", "shop", "orders", extract=RULES["orders"]),
        SourceConfig("enriched", "place", "shop", "nation", extract=RULES["nation"]),
        SourceConfig("audit", "any", "shop", None),
    ])


def literal_edges(spark: SparkSession, pairs: list[tuple[str, str]], label: str = "e") -> DataFrame:
    k = lambda x: ("lit", "v", x)
    return spark.createDataFrame([(k(a), label, k(b), k(a), {}) for a, b in pairs], EDGES)


__all__ = ["IN", "OUT"]
