"""Queries that must take in all rows of their tables, against plain Python over the same tables."""

import json

import pyarrow.parquet as pq
import pytest

from docgraph.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star():
    """(tail, label, head) of all orders, customers and nations."""
    found = []
    for name, me, label, kind, to in (("orders", "o_orderkey", "placed_by", "customer", "o_custkey"), ("customer", "c_custkey", "lives_in", "nation", "c_nationkey"), ("nation", "n_nationkey", "part_of", "region", "n_regionkey")):
        rows = pq.read_table(f"{SF}/{name}.parquet", columns=[me, to]).to_pylist()
        found += [(f"shop/{name}/{r[me]}", label, f"shop/{kind}/{r[to]}") for r in rows]
    return found


def test_owned_edges_of_all_documents(spark, star):
    assert sorted(tuple(r) for r in q.QUERIES["graph_owned_edges"](spark, SF).collect()) == sorted(star)


def test_unfold_of_all_documents(spark, star):
    want = {("an", end) for tail, _, head in star for end in (tail, head)} | {("ae", f"{tail}--{label}->{head}") for tail, label, head in star}
    got = [tuple(r) for r in q.QUERIES["delta_unfold"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_tree_has_every_document(spark):
    """walk_tree's JSON equals a tree built by hand, suppliers and their names included."""
    region, nation, supplier = (pq.read_table(f"{SF}/{n}.parquet").to_pylist() for n in ("region", "nation", "supplier"))

    def node(kind, row, name, edge, children):
        me = ["shop", kind, str(row[f"{kind[0]}_{name}"])]
        value = {"exists": True, "vertex": me, "value": {"name": row[f"{kind[0]}_name"]}} | ({"edge": {"label": edge[0], "from": edge[1]}} if edge else {})
        return {"_value": value, "_children": sorted(children(me), key=lambda c: c["_value"]["vertex"][2])}

    def tree(r):
        leaves = lambda n: lambda me: [node("supplier", s, "suppkey", ("lives_in", me), lambda _: []) for s in supplier if s["s_nationkey"] == n["n_nationkey"]]
        return node("region", r, "regionkey", None, lambda me: [node("nation", n, "nationkey", ("part_of", me), leaves(n)) for n in nation if n["n_regionkey"] == r["r_regionkey"]])

    want = {f"shop/region/{r['r_regionkey']}": tree(r) for r in region}
    got = {r.root: json.loads(r.value) for r in q.QUERIES["walk_tree"](spark, SF).collect()}
    assert supplier and got == want
