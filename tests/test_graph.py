import pytest
from cases import docs, edges, keys, text
from pyspark.sql import functions as F

from docgraph.functions import codecs
from docgraph.model import key_text
from docgraph.operators import delta, dirty, graph
from docgraph.operators.extract import Reference, References, extract, merged_props, self_loops, valid_props, without_rejected


def verts(v):
    return {text(r.key): r.version for r in v.collect()}


def empty(spark):
    return docs(spark, []).select("key", "version"), edges(spark, [])


def test_commit_links_to_existing_and_claims_symbolic(spark):
    c, e = empty(spark)
    c, e, _ = graph.commit(c, e, docs(spark, [("a", "b", "c", 1)]).select("key", "version"), edges(spark, [("a/b/c", "l", "d/e/f", "a/b/c")]))
    assert verts(graph.vertices(c, e)) == {"a/b/c": 1, "d/e/f": 0}
    c, e, _ = graph.commit(c, e, docs(spark, [("d", "e", "f", 2)]).select("key", "version"), edges(spark, []))
    assert verts(graph.vertices(c, e)) == {"a/b/c": 1, "d/e/f": 2}
    assert e.count() == 1


def test_dropped_edges_take_symbolic_ends_along(spark):
    c = docs(spark, [("r", "t", "root", 1), ("r", "t", "v1", 1), ("r", "t", "v2", 3)]).select("key", "version")
    e = edges(spark, [("r/t/root", "x", f"r/t/{n}", "r/t/root") for n in ("v1", "v2", "s1", "s2")])
    assert len(verts(graph.vertices(c, e))) == 5
    c, e, _ = graph.commit(c, e, docs(spark, [("r", "t", "root", 2)]).select("key", "version"), edges(spark, []))
    assert verts(graph.vertices(c, e)) == {"r/t/root": 2, "r/t/v1": 1, "r/t/v2": 3}
    assert e.count() == 0


@pytest.mark.parametrize(("version", "ok"), [(0, False), (1, False), (2, True), (3, True)])
def test_versions(spark, version, ok):
    c = docs(spark, [("a", "b", "c", 2)]).select("key", "version")
    now, _, rejected = graph.commit(c, edges(spark, []), docs(spark, [("a", "b", "c", version)]).select("key", "version"), edges(spark, []))
    assert rejected.count() == (0 if ok else 1)
    assert verts(now) == {"a/b/c": version if ok else 2}


def test_delete_in_the_middle(spark):
    c = docs(spark, [("g", "v", n, 1) for n in ("v0", "v1", "v2")]).select("key", "version")
    e = edges(spark, [("g/v/v0", "e", "g/v/v1", "g/v/v0"), ("g/v/v1", "e", "g/v/v2", "g/v/v1")])
    before = graph.vertices(c, e)
    c, e = graph.delete(c, e, keys(spark, ["g/v/v1"]))
    after = graph.vertices(c, e)
    assert verts(after) == {"g/v/v0": 1, "g/v/v1": 0, "g/v/v2": 1}
    assert [(text(r.tail), text(r.head)) for r in e.collect()] == [("g/v/v0", "g/v/v1")]
    assert {text(r.key): r.fate for r in graph.affected_by_delete(before, after).collect()} == {"g/v/v1": "symbolic"}


def test_lookup_by_index_and_type(spark):
    v = graph.vertices(docs(spark, [("a", "b", "c", 1), ("a", "e", "f", 2), ("a", "b", "f", 2)]), edges(spark, []))
    assert [graph.in_index(v, "a").count(), graph.in_type(v, "a", "b").count(), graph.in_type(v, "a", "e").count()] == [3, 2, 1]
    assert graph.resolve(v, "a", "b", "c", 2).count() == 0 and graph.resolve(v, "a", "b", "c").count() == 1


def test_self_loops_reject_the_document(spark):
    e = edges(spark, [("a/b/1", "l", "a/b/1", "a/b/1"), ("a/b/1", "l", "a/b/2", "a/b/1"), ("a/b/3", "l", "a/b/1", "a/b/3")])
    assert self_loops(e).count() == 1
    assert [text(r.owner) for r in without_rejected(e).collect()] == ["a/b/3"]


def test_two_configurations_of_one_source(spark):
    d = docs(spark, [("src", "t", "1", 1, "{}"), ("src", "t", "2", 1, "{}")])
    rules = (Reference("label1", "multi", "b", lambda _: F.lit("virtual-1"), inwards=True), Reference("label2", "multi", "a", lambda _: F.lit("virtual-2")))
    e = extract(d, rules)
    v = graph.vertices(d, e)
    assert e.count() == 4
    assert sorted(verts(v).values()) == [0, 0, 1, 1]


def test_references_skip_nulls_and_repeats(spark):
    d = docs(spark, [("i", "t", "1", 1, "x,y,x"), ("i", "t", "2", 1, None)])
    e = extract(d, (References("r", "o", "t", lambda c: F.split(c["source"], ",")),))
    assert sorted(text(r.head) for r in e.collect()) == ["o/t/x", "o/t/y"]


def test_owner_conflicts_and_owned(spark):
    e = edges(spark, [("a/b/1", "l", "a/b/2", "a/b/1"), ("a/b/1", "l", "a/b/2", "a/b/2"), ("a/b/1", "m", "a/b/2", "a/b/2")])
    assert graph.owner_conflicts(e).count() == 1
    assert graph.owned_by(e, keys(spark, ["a/b/2"])).count() == 2


def test_properties(spark):
    made = spark.range(1).select(
        codecs.encoded_props({"a": F.array(F.lit(1), F.lit(2)), "b": F.lit("abc"), "c": F.lit(3), "d": F.create_map(F.lit("x"), F.lit(2))}).alias("p"),
        merged_props([F.create_map(F.lit("k"), F.lit("1"), F.lit("m"), F.lit("2")), F.create_map(F.lit("k"), F.lit("3"))]).alias("q"),
        valid_props(F.create_map(F.lit("_owner"), F.lit("1"))).alias("ok"),
    ).first()
    assert made.p == {"a": "[1,2]", "b": '"abc"', "c": "3", "d": '{"x":2}'}
    assert made.q == {"k": "3", "m": "2"} and made.ok is False


def test_change_text_keeps_commas_in_ids(spark):
    r = spark.createDataFrame([("UPDATE,book,3,0,a,b",)], "t string").select(codecs.change_from_text(F.col("t")).alias("c")).first().c
    assert (r.action, r.type, r.version, r.retries, r.id) == ("UPDATE", "book", 3, 0, "a,b")


def test_id_json_round_trip(spark):
    k = F.struct(F.lit('a"x').alias("index"), F.lit("b").alias("type"), F.lit("c").alias("id"))
    r = spark.range(1).select(codecs.id_from_json(codecs.id_json(k, F.lit(4))).alias("k")).first().k
    assert tuple(r) == ('a"x', "b", "c", 4)


def test_deltas(spark):
    props = "name string, props map<string,string>"
    a = spark.createDataFrame([("A", {"size": "5", "label": "x"}), ("B", {"size": "1"}), ("D", {"s": "1"})], props)
    b = spark.createDataFrame([("A", {"size": "10"}), ("B", {"size": "1"}), ("C", {"label": "n"})], props)
    got = {(r.op, r.name): r.props for r in delta.diff(a, b, "name", "props", "n").collect()}
    assert got == {("cn", "A"): {"size": "10", "label": None}, ("an", "C"): {"label": "n"}, ("dn", "D"): {}}
    lines = [r.command for r in delta.encoded(delta.diff(a, b, "name", "props", "n")).collect()]
    assert '{"cn":{"A":{"size":"10","label":null}}}' in lines and '{"an":{"C":{"label":"n","size":"1"}}}' in lines


def test_unfold_keeps_directions(spark):
    e = edges(spark, [("a/b/1", "x", "a/b/2", "a/b/1"), ("a/b/2", "y", "a/b/3", "a/b/2")])
    got = sorted(r.name for r in delta.unfold(e, keys(spark, ["a/b/2"])).collect())
    assert got == ["a/b/1", "a/b/1--x->a/b/2", "a/b/2--y->a/b/3", "a/b/3"]


def test_scopes(spark):
    v = graph.vertices(docs(spark, [("i", "t", "1", 4), ("i", "u", "2", 5)]), edges(spark, [("i/t/1", "l", "i/t/s", "i/t/1")]))
    rows = [(1, "DELETE", "i", None, None, None), (2, "DELETE", "i", "t", None, None), (3, "UPDATE", "i", "t", "1", None), (4, "DELETE", "x", None, None, None)]
    got = dirty.fan_out(spark.createDataFrame(rows, "request int, action string, index string, type string, id string, version long"), v)
    assert sorted((r.request, text(r.key), r.version) for r in got.collect()) == [(1, "i/t/1", 4), (1, "i/t/s", 0), (1, "i/u/2", 5), (2, "i/t/1", 4), (2, "i/t/s", 0), (3, "i/t/1", 4)]


def test_random_graph(spark):
    numbers = spark.range(300).withColumnRenamed("id", "n")
    made = [(int(r.tail.id), int(r.head.id), int(r.owner.id)) for r in graph.random_graph(numbers, 0.4).collect()]
    assert all(a != b and max(a, b) < n for a, b, n in made) and len({n for _, _, n in made}) == len(made)
    assert 120 < len(made) < 220 and sorted(made) == sorted((int(r.tail.id), int(r.head.id), int(r.owner.id)) for r in graph.random_graph(numbers.repartition(3), 0.4).collect())
    assert graph.random_graph(numbers, 1.0).count() == 0
