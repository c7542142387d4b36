import random

import pytest
from cases import docs, text
from pyspark.sql import functions as F

from docgraph.config import Property, Registry, SourceConfig, Walk
from docgraph.model import IN, OUT, key
from docgraph.operators.extract import References, extract
from docgraph.operators.recompute import recompute
from docgraph.sources import changes, fixtures
from docgraph.sources.documents import json_folder, read_json, valid_json, write_json, write_targets
from docgraph.storage import Snapshots
from docgraph.sources.store import DocumentStore, Overflow
from docgraph.streaming.deltas import Channels, write_deltas
from docgraph.streaming.updater import Feed, Updater, backoff, split_dead

REFS = (References("r", "s", "t", lambda d: F.filter(F.split(d["source"], ","), lambda x: x != "")),)
CFG = SourceConfig("out", "t", "s", "t", REFS, walks=(Walk("in", IN, (Property("n", lambda d: F.count("*"), empty=0), Property("who", lambda d: F.sort_array(F.collect_list(d["source"]))))),))


def store(spark, state):
    return docs(spark, [("s", "t", k, v, src) for k, (v, src) in state.items()])


def rows(df):
    return {r.key.id: (r.doc.n, r.doc.who, r.doc.source) for r in df.collect()}


def change(spark, items):
    return spark.createDataFrame([(a, ("s", "t", k), v, 0) for a, k, v in items], "action string, key struct<index:string,type:string,id:string>, version long, retries int")


@pytest.mark.parametrize("seed", range(3))
def test_incremental_equals_full(spark, tmp_path, seed):
    rng = random.Random(seed)
    state = {str(i): (1, ",".join(str(rng.randrange(8)) for _ in range(rng.randrange(3)) )) for i in range(6)}
    state = {k: (v, ",".join(x for x in s.split(",") if x != k)) for k, (v, s) in state.items()}
    up = Updater(Snapshots(spark, f"file://{tmp_path}/s"), CFG, lambda: store(spark, state), prune=True)
    up.start_empty()
    for _ in range(3):
        items = []
        for k in rng.sample([str(i) for i in range(8)], 2):
            if k in state and rng.random() < 0.4:
                items.append(("DELETE", k, state.pop(k)[0] + 1))
            else:
                v = state.get(k, (0, ""))[0] + 1
                state[k] = (v, ",".join(str(x) for x in rng.sample(range(8), 2) if str(x) != k))
                items.append(("UPDATE", k, v))
        up.apply(change(spark, items))
        d = store(spark, state)
        full = recompute(d, extract(d, REFS), CFG)
        assert rows(up.snapshots.read("targets")) == rows(full.where("status = 'OK'"))


def test_stream_with_stale_change(spark, tmp_path):
    state = {"1": (2, "2"), "2": (1, "")}
    up = Updater(Snapshots(spark, f"file://{tmp_path}/s"), CFG, lambda: store(spark, state))
    up.start_empty()
    feed = tmp_path / "feed"
    feed.mkdir()
    state["2"] = (2, "1")
    (feed / "a.txt").write_text("UPDATE,t,2,0,2\nUPDATE,t,1,0,1\n")
    q = up.run(changes.stream(spark, str(feed), "s"), f"{tmp_path}/check", f"{tmp_path}/dead")
    q.awaitTermination(120)
    assert q.exception() is None
    assert [(r.key.id, r.version) for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == [("1", 1)]
    assert rows(up.snapshots.read("targets"))["1"][0] == 1
    write_deltas(up.snapshots, 1, 2, f"file://{tmp_path}/deltas")
    assert any('"ae"' in r.value for r in spark.read.text(f"{tmp_path}/deltas").collect())


def test_missing_documents_wait_and_die(spark, tmp_path):
    """An update that comes before its document is retried with backoff, applied once the document is there, and dead after the last retry."""
    state = {"1": (1, "2")}
    up = Updater(Snapshots(spark, f"file://{tmp_path}/s"), CFG, lambda: store(spark, state), base_ms=100, max_retries=2, keep_versions=2)
    up.start_empty()
    waiting = lambda: sorted((r.key.id, r.retries, r.due) for r in up.snapshots.read("waiting").collect())
    assert up.apply(change(spark, [("UPDATE", "7", 1), ("UPDATE", "8", 1)]), 1000).count() == 0
    assert waiting() == [("7", 1, 1100), ("8", 1, 1100)]
    assert up.apply(change(spark, []), 1050).count() == 0 and len(waiting()) == 2  # too early
    state["8"] = (1, "1")
    assert up.apply(change(spark, []), 1100).count() == 0
    assert waiting() == [("7", 2, 1300)] and rows(up.snapshots.read("targets"))["1"][0] == 1
    assert [(r.key.id, r.retries) for r in up.apply(change(spark, []), 1300).collect()] == [("7", 3)]
    assert waiting() == [] and up.snapshots.current() == 5
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["v=4", "v=5"]


def test_updater_with_several_configurations(spark, tmp_path):
    """A change reaches the targets of every configuration whose walks meet it, and edges come from the rules of all."""
    up_refs = (References("up", "s", "t", lambda d: F.filter(F.split(d["source"], ","), lambda x: x == "9")),)
    other = SourceConfig("other", "t", "s", "t", up_refs, filter=lambda d: d["source"] != "", walks=(Walk("up", OUT, (Property("m", lambda d: F.count("*"), empty=0),)),))
    state = {"1": (1, "2"), "2": (1, ""), "9": (1, "")}
    registry = Registry([CFG, other])
    up = Updater(Snapshots(spark, f"file://{tmp_path}/s"), registry, lambda: store(spark, state))
    up.start_empty()
    state["2"] = (2, "9")
    assert up.apply(change(spark, [("UPDATE", "2", 2), ("DELETE", "none", 1)])).count() == 0
    d = store(spark, state)
    edges = extract(d, REFS).unionByName(extract(d, up_refs))
    for config in registry.configs:
        want = recompute(d, edges, config).where("status = 'OK'")
        now = {r.key.id: (tuple(r.doc), r.from_source.version) for r in up.snapshots.read(up.table(config)).collect()}
        assert now == {r.key.id: (tuple(r.doc), r.from_source.version) for r in want.collect()}
    assert {r.status for r in up.snapshots.read("results").collect()} == {"OK", "FILTERED"}


def test_replayed_batch_writes_dead_letters_once(spark, tmp_path):
    state = {"1": (2, "")}
    up = Updater(Snapshots(spark, f"file://{tmp_path}/s"), CFG, lambda: store(spark, state))
    up.start_empty()
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.txt").write_text("UPDATE,t,1,0,1\n")
    for again in ("a", "b"):  # without the first query's checkpoint, its batch comes again
        up.run(changes.stream(spark, str(tmp_path / "feed"), "s"), f"{tmp_path}/check-{again}", f"{tmp_path}/dead").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 1


def test_json_targets_come_back(spark, tmp_path):
    d = store(spark, {"1": (1, 'a "b"'), "2": (2, "")})
    write_json(d.select("key", "doc"), f"file://{tmp_path}/out")
    back = read_json(spark, f"file://{tmp_path}/out", "struct<source:string>")
    assert sorted((r.key.id, r.doc.source) for r in back.collect()) == [("1", 'a "b"'), ("2", "")]


def test_snapshot_without_marker_is_not_seen(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/x")
    assert s.current() == 0
    s.commit(t=spark.range(3))
    spark.range(5).write.parquet(f"{tmp_path}/x/v=2/t")
    assert s.current() == 1 and s.read("t").count() == 3


def test_latest_and_private(spark):
    c = change(spark, [("UPDATE", "1", 3), ("DELETE", "1", 3), ("UPDATE", "1", 2), ("UPDATE", "2", 1)])
    assert {r.key.id: (r.action, r.version) for r in changes.latest(c).collect()} == {"1": ("DELETE", 3), "2": ("UPDATE", 1)}
    hidden = c.withColumn("key", key("_kibana", "t", F.col("key")["id"]))
    assert changes.public_only(hidden).count() == 0 and changes.queue_sizes(c).first().waiting == 4


def test_backoff(spark):
    d = backoff(spark.createDataFrame([(0,), (9,), (10,)], "retries int"), F.lit(5).cast("long"))
    alive, dead = split_dead(d)
    assert sorted((r.retries, r.due) for r in alive.collect()) == [(1, 10_005), (10, 100_005)]
    assert [r.retries for r in dead.collect()] == [11]


def test_fixture_files_and_run(spark, tmp_path):
    folder = tmp_path / "data" / "s" / "t"
    folder.mkdir(parents=True)
    (folder / "1.json").write_text('{"a": 1}')
    (folder / "2.json").write_text("{bad")
    (folder / "mapping.json").write_text("{}")
    d = json_folder(spark, f"file://{tmp_path}/data")
    assert {text(r.key): r.valid for r in valid_json(d).collect()} == {"s/t/1": True, "s/t/2": False}
    state = store(spark, {"1": (1, "2"), "2": (1, "")})
    expected = spark.createDataFrame([(("out", "t", "1"), '{"n":0,"source":"2"}'), (("out", "t", "9"), "{}")], "key struct<index:string,type:string,id:string>, source string")
    targets, checked = fixtures.run(spark, state, Registry([CFG]), expected)
    assert {r.key.id: r.result for r in checked.collect()} == {"1": "equal", "2": "unexpected", "9": "missing"}
    assert fixtures.tally(checked).first().failed == 2
    assert fixtures.affected_configs(Registry([CFG]), ["s"]) == ["out/t"]
    write_targets(targets["out/t"], f"file://{tmp_path}/written")
    assert spark.read.parquet(f"{tmp_path}/written").count() == 2


def test_store_creates_and_deletes_indexes(spark, tmp_path):
    d = store(spark, {"1": (1, "2"), "2": (1, "")})
    kept = DocumentStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(FileNotFoundError):
        kept.insert(d, "s", "t")
    kept.create("s")
    with pytest.raises(FileExistsError):
        kept.create("s")
    kept.insert(d, "s", "t")
    kept.insert(d.withColumn("key", key("s", "t", F.lit("3"))).limit(1), "s", "t")
    assert kept.types("s") == ["t"] and sorted(r.key.id for r in kept.read("s", "t").collect()) == ["1", "2", "3"]
    assert kept.delete("s") and not kept.delete("s") and kept.types("s") == []


def test_development_and_test_runs(spark, tmp_path):
    d = store(spark, {"1": (1, "2"), "2": (1, "")})
    kept, registry = DocumentStore(spark, f"file://{tmp_path}/store"), Registry([CFG])
    want = [(("out", "t", "1"), '{"n":0,"source":"2"}'), (("out", "t", "2"), '{"n":1,"who":["2"],"source":""}')]
    expected = spark.createDataFrame(want, "key struct<index:string,type:string,id:string>, source string")
    for _ in range(2):  # a second run starts from scratch as well
        assert fixtures.development_run(kept, d, registry, expected, f"file://{tmp_path}/results") == (2, 0)
    assert kept.read("out", "t").count() == 2
    back = read_json(spark, f"file://{tmp_path}/results/out/t", "struct<source:string,n:long>")
    assert sorted((r.key.id, r.doc.n) for r in back.collect()) == [("1", 0), ("2", 1)]
    wrong = expected.withColumn("source", F.replace("source", F.lit("0"), F.lit("5")))
    assert fixtures.test_run(kept, registry, expected) == (2, 0) and fixtures.test_run(kept, registry, wrong) == (1, 1)
    assert [fixtures.run_mode(*x) for x in ((True, True, True), (False, True, True), (True, False, True), (True, True, False))] == ["DEVELOPMENT", "TEST", None, None]


def test_overflow_comes_back_oldest_first(spark, tmp_path):
    spool = Overflow(spark, f"file://{tmp_path}/spool")
    assert spool.load("s") == (None, [])
    for ms in (1000, 99, 5):
        spool.save(change(spark, [("UPDATE", str(ms), 1)]), "s", ms)
    spool.save(change(spark, [("UPDATE", "x", 1)]).withColumn("key", key("s-overflow", "t", F.lit("x"))), "s-overflow", 1)
    seen = []
    while (got := spool.load("s", 2))[0] is not None:
        seen.append(sorted(r.key.id for r in got[0].collect()))
        spool.drop(got[1])
    assert seen == [["5", "99"], ["1000"]] and len(spool.chunks("s-overflow")) == 1


def test_feed_pauses_and_flushes(spark, tmp_path):
    state = {"1": (1, "2")}
    up = Updater(Snapshots(spark, f"file://{tmp_path}/s"), CFG, lambda: store(spark, state))
    up.start_empty()
    (tmp_path / "feed").mkdir()
    feed = Feed(up, lambda: changes.stream(spark, str(tmp_path / "feed"), "s"), f"{tmp_path}/check", f"{tmp_path}/dead", interval="200 milliseconds")
    feed.resume()
    assert feed.running and feed.resume() is feed.query
    feed.pause()
    assert not feed.running
    (tmp_path / "feed" / "a.txt").write_text("UPDATE,t,1,0,7\n")
    assert up.snapshots.current() == 1
    feed.resume().processAllAvailable()
    feed.pause()
    assert [r.key.id for r in up.snapshots.read("waiting").collect()] == ["7"]
    up.flush()
    assert up.snapshots.read("waiting").count() == 0 and set(rows(up.snapshots.read("targets"))) == {"1"}


def test_channels(spark, tmp_path):
    d = store(spark, {"1": (1, "2"), "2": (1, "")})
    edges = extract(d, REFS)
    channels = Channels(spark, f"file://{tmp_path}/channels")
    one = d.where("key.id = '1'").select("key")
    with pytest.raises(KeyError):
        channels.update("a", edges, one)
    channels.create("a", edges, one)
    channels.follow_all("b")
    lines = lambda n: sorted(r.value for r in spark.read.text(channels.at(n)).collect())
    assert lines("a") == ['{"ae":{"s/t/1--r->s/t/2":{"size":"1"}}}', '{"an":{"s/t/2":{"size":"1"}}}']
    channels.publish(spark.createDataFrame([('{"dn":{"s/t/9":{}}}',)], "command string"))
    assert lines("b") == ['{"dn":{"s/t/9":{}}}'] and len(lines("a")) == 2
    channels.update("a", edges, one)
    assert len(lines("a")) == 4
