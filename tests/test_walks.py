import json
import random

import pytest
from cases import docs, edges, keys, text
from pyspark.sql import functions as F

from docgraph.config import Property, Registry, SourceConfig, Walk
from docgraph.model import IN, OUT
from docgraph.operators import dirty, graph, recompute, resolve, walk
from docgraph.operators import reduce as red
from docgraph.operators import requests as req
from docgraph.operators.extract import References, extract


def lit(spark, pairs):
    return edges(spark, [(f"l/v/{a}", "e", f"l/v/{b}", f"l/v/{a}") for a, b in pairs])


def nodes(df):
    return sorted(r.node.id for r in df.collect())


def test_cycle_is_walked_once(spark):
    e = lit(spark, ["12", "23", "31"])
    got = {r.node.id: r.depth for r in walk.reach(e, keys(spark, ["l/v/1"]), OUT).collect()}
    assert got == {"1": 0, "2": 1, "3": 2}
    assert nodes(walk.reach(e, keys(spark, ["l/v/1"]), OUT, max_depth=1)) == ["1", "2"]
    assert {(r.root.id, r.node.id): r.depth for r in walk.closure(e, OUT).collect()} == {(a, b): d for a, b, d in [("1", "2", 1), ("1", "3", 2), ("2", "3", 1), ("2", "1", 2), ("3", "1", 1), ("3", "2", 2)]}


def test_fork_and_direction(spark):
    e = lit(spark, ["12", "13", "14"])
    assert nodes(walk.reach(e, keys(spark, ["l/v/1"]), OUT)) == ["1", "2", "3", "4"]
    assert nodes(walk.reach(e, keys(spark, ["l/v/1"]), IN)) == ["1"]
    assert nodes(walk.reach(e, keys(spark, ["l/v/2"]), IN)) == ["1", "2"]
    assert nodes(walk.leaves(walk.reach(e, keys(spark, ["l/v/1"]), OUT), e, OUT)) == ["2", "3", "4"]


def test_siblings_first_then_child_by_child(spark):
    e = lit(spark, ["01", "02", "1a", "ax", "2x"])
    t = walk.tree(walk.reach(e, keys(spark, ["l/v/0"]), OUT), e, OUT).orderBy("seq").collect()
    assert [r.node.id for r in t] == ["0", "1", "2", "a", "x"]
    assert {r.node.id: r.parent.id if r.parent else None for r in t}["x"] == "a"
    lines = [r.line for r in walk.pretty(walk.tree(walk.reach(e, keys(spark, ["l/v/0"]), OUT), e, OUT)).orderBy("seq").collect()]
    assert lines[-1] == "      l/v/x"


def test_reachable_is_the_set_of_all_reached(spark):
    rng = random.Random(5)
    e = lit(spark, [(str(rng.randrange(15)), str(rng.randrange(15))) for _ in range(18)])
    some = keys(spark, ["l/v/1", "l/v/4", "l/v/99"])
    for direction in (IN, OUT):
        for most in (None, 1):
            assert nodes(walk.reachable(e, some, direction, most)) == sorted(set(nodes(walk.reach(e, some, direction, most))))


def test_diamonds_stay_small(spark):
    """A chain of 12 diamonds has 4096 paths; steps go on from places, not from paths."""
    pairs = [p for i in range(12) for p in ((f"a{i}", f"b{i}"), (f"a{i}", f"c{i}"), (f"b{i}", f"a{i + 1}"), (f"c{i}", f"a{i + 1}"))]
    e = edges(spark, [(f"l/v/{b}", "e", f"l/v/{a}", f"l/v/{b}") for a, b in pairs])
    assert walk.chain(e, keys(spark, ["l/v/a0"]), IN, 4).count() == 7


def test_chain_equals_reach(spark):
    rng = random.Random(3)
    e = lit(spark, [(str(rng.randrange(12)), str(rng.randrange(12))) for _ in range(20)])
    roots = e.select(F.col("tail").alias("key"))
    a, b = (sorted((r.root.id, r.node.id, r.depth) for r in df.collect()) for df in (walk.chain(e, roots, OUT, 3), walk.reach(e, roots, OUT, 3)))
    assert a == b


CHILD = (References("part_of", "shed", "tool", lambda d: F.from_json(d["source"], "parts array<string>")["parts"], inwards=True),)


def three(spark):
    d = docs(spark, [("shed", "tool", i, 1, s) for i, s in (("plough", '{"parts":["share","beam","wheel"]}'), ("share", '{"kg":4}'), ("beam", '{"kg":9}'))])
    return d, extract(d, CHILD)


def test_three_documents(spark):
    d, e = three(spark)
    props = lambda n: (Property(n, tree=lambda t: t),)
    cfg = SourceConfig("list", "tool", "shed", "tool", CHILD, walks=(Walk("nodes-in", IN, props("nodes_in")), Walk("nodes-out", OUT, props("nodes_out"))))
    got = {r.key.id: r.doc for r in recompute.recompute(d, e, cfg).collect()}
    count = {k: (len(json.loads(v.nodes_in)["_children"]), len(json.loads(v.nodes_out)["_children"])) for k, v in got.items()}
    assert count == {"plough": (3, 0), "share": (0, 1), "beam": (0, 1)}
    inside = {c["_value"]["vertex"][2]: c["_value"]["exists"] for c in json.loads(got["plough"].nodes_in)["_children"]}
    assert inside == {"share": True, "beam": True, "wheel": False}


def test_delete_by_scope(spark):
    d, e = three(spark)
    d = d.unionByName(docs(spark, [("shed", "spare", "wheel", 1, "{}")]))
    c, e = graph.delete(d.select("key", "version"), e, keys(spark, ["shed/tool/plough"]))
    for wanted, left in ((("shed", "tool"), 1), (("shed", None), 0)):
        ask = spark.createDataFrame([(1, "DELETE", *wanted, None, None)], "request int, action string, index string, type string, id string, version long")
        c, e = graph.delete(c, e, dirty.fan_out(ask, graph.vertices(c, e)))
        assert graph.in_index(graph.vertices(c, e), "shed").count() == left


def test_failing_reduction_is_null_and_nodes_flatten(spark):
    d, e = three(spark)
    t = walk.tree(walk.reach(e, keys(spark, ["shed/tool/plough"]), IN), e, IN)
    assert red.by_tree(t, d, lambda x: 1 / 0).first().value is None
    assert json.loads(red.by_tree(t, d, lambda x: len(red.nodes(x))).first().value) == 4


def test_expired_aborts_the_document(spark):
    d, e = three(spark)
    v = graph.vertices(d.select("key", F.when(F.col("key")["id"] == "beam", 9).otherwise(1).cast("long").alias("version")), e)
    cfg = SourceConfig("t", "x", "shed", "tool", CHILD, walks=(Walk("in", IN, (Property("n", lambda c: F.count("*"), empty=0),)),))
    got = {r.key.id: r.status for r in recompute.recompute(d, e, cfg, vertices=v).collect()}
    assert got == {"plough": "EXPIRED", "share": "OK", "beam": "EXPIRED"}


def test_get_versioned(spark):
    d = docs(spark, [("i", "t", "1", 2, "a")])
    ask = docs(spark, [("i", "t", "1", 2), ("i", "t", "1", 1), ("i", "t", "9", 1)]).select("key", "version")
    assert sorted(r.status for r in resolve.get_versioned(ask, d).collect()) == ["EXPIRED", "MISSING", "OK"]


def test_validation():
    with pytest.raises(ValueError, match="IN or OUT"):
        Walk("w", "BOTH", ())
    p = Property("n", lambda c: F.count("*"))
    with pytest.raises(ValueError, match="unique"):
        SourceConfig("a", "b", "c", "d", walks=(Walk("x", IN, (p,)), Walk("y", OUT, (p,))))
    with pytest.raises(ValueError, match="either"):
        Property("n")


def test_registry_folder(tmp_path, spark):
    (tmp_path / "target").mkdir()
    (tmp_path / "fixtures").mkdir()
    (tmp_path / "target" / "book.conf.py").write_text("CONFIG = dict(source_index='s', source_type='b')")
    reg = Registry.load(tmp_path)
    assert [(c.target_index, c.target_type) for c in reg.configs] == [("target", "book")]
    (tmp_path / "target" / "bad.conf.py").write_text("CONFIG = 1 /")
    assert reg.reload(tmp_path) is reg
    assert [len(reg.matching("s", k)) for k in ("b", "x", None)] == [1, 0, 1]


def test_config_match_and_decode(spark):
    found = req.decode(spark.createDataFrame([("GET", "/a/b/c/1"), ("GET", "/a/b/c"), ("delete", "/a")], "method string, path string")).collect()
    assert [(r.action, r.scope, r.valid) for r in found] == [("UPDATE", "DOCUMENT", True), ("UPDATE", "DOCUMENT_ANY_VERSION", False), ("DELETE", "INDEX", True)]


def test_authors_and_books(spark):
    d = docs(spark, [("alice", "author", "gibson", 1, "book_id_1,book_id_2"), ("bob", "books", "book_id_1", 1, "Neuromancer"), ("bob", "books", "book_id_2", 1, "Count Zero")])
    authors = recompute.sources(d, SourceConfig("x", "y", "alice", "author"))
    e = extract(authors, (References("wrote_book", "bob", "books", lambda c: F.split(c["source"], ",")),))
    w = Walk("bookwalk", OUT, (Property("books", lambda c: red.collected(c["source"])),))
    values, _ = recompute.walk_values(d, e, authors, w)
    assert values.first().books == ["Count Zero", "Neuromancer"]
    assert text(values.first().root) == "alice/author/gibson"
