"""Fixture runs: load, recompute everything, compare with what is expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Registry
from ..operators import graph
from ..operators.extract import extract
from ..operators.recompute import recompute, sources
from .documents import write_json
from .store import DocumentStore


def verify(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """key and result (equal, different, unexpected, missing) of documents with a JSON text column source, compared as values."""
    a = actual.select("key", F.parse_json("source").cast("string").alias("a"), F.lit(True).alias("x"))
    b = expected.select("key", F.parse_json("source").cast("string").alias("b"), F.lit(True).alias("y"))
    result = F.when(F.col("x").isNull(), "missing").when(F.col("y").isNull(), "unexpected").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("different")
    return a.join(b, "key", "full_outer").select("key", result.alias("result"))


def tally(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("result") == "equal").alias("passed"), F.count_if(F.col("result") != "equal").alias("failed"))


def affected_configs(registry: Registry, changed_indexes: list[str]) -> list[str]:
    """Targets whose source is one of the fixture indexes."""
    return [f"{c.target_index}/{c.target_type}" for c in registry.configs if c.source_index in changed_indexes]


def run(spark: SparkSession, documents: DataFrame, registry: Registry, expected: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Targets by name, and the comparison with expected (key, source) if given."""
    parts = [extract(sources(documents, c), c.extract) for c in registry.configs if c.extract]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    targets = {f"{c.target_index}/{c.target_type}": recompute(documents, edges, c, vertices=graph.vertices(documents, edges)) for c in registry.configs}
    if expected is None:
        return targets, None
    actual = None
    for t in targets.values():
        one = t.where("status = 'OK'").select("key", F.to_json("doc").alias("source"))
        actual = one if actual is None else actual.unionByName(one)
    return targets, verify(actual, expected)


def development_run(store: DocumentStore, documents: DataFrame, registry: Registry, expected: DataFrame, results: str) -> tuple[int, int]:
    """Everything from scratch: source and target indexes are deleted and created, documents put in, all targets recomputed, kept in the store,
    written as JSON to the folder results, and compared with expected (key, source). Numbers of passed and failed documents."""
    types = [tuple(r) for r in documents.select(F.col("key")["index"].alias("i"), F.col("key")["type"].alias("t")).distinct().collect()]
    for index in sorted({i for i, _ in types} | {c.target_index for c in registry.configs} | {c.source_index for c in registry.configs}):
        store.delete(index)
        store.create(index)
    for index, kind in types:
        store.insert(documents, index, kind)
    targets, _ = run(store.spark, stored(store, registry), registry)
    for name, made in targets.items():
        index, kind = name.split("/")
        store.insert(made.where("status = 'OK'").select("key", "doc", "from_source"), index, kind)
        write_json(store.read(index, kind).select("key", "doc"), f"{results}/{name}")
    return _tallied(verify(_written(store, registry), expected))


def test_run(store: DocumentStore, registry: Registry, expected: DataFrame) -> tuple[int, int]:
    """Recomputes what the store holds and compares; nothing is written."""
    return _tallied(run(store.spark, stored(store, registry), registry, expected)[1])


test_run.__test__ = False  # type: ignore[attr-defined]  it isn't a test of this repository


def stored(store: DocumentStore, registry: Registry) -> DataFrame:
    """All documents of the source indexes; types have the columns of all."""
    out = None
    for index in sorted({c.source_index for c in registry.configs}):
        for kind in store.types(index):
            rows = store.read(index, kind).select("key", "version", "doc.*")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("the source indexes hold no documents")
    return out.select("key", "version", F.struct(*[c for c in out.columns if c not in ("key", "version")]).alias("doc"))


def _written(store: DocumentStore, registry: Registry) -> DataFrame:
    out = None
    for c in registry.configs:
        rows = store.read(c.target_index, c.target_type).select("key", F.to_json("doc").alias("source"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _tallied(results: DataFrame) -> tuple[int, int]:
    row = tally(results).first()
    return row.passed, row.failed


def run_mode(development: bool, reload: bool, fixtures: bool) -> str | None:
    """DEVELOPMENT rebuilds the indexes at each change of a configuration, TEST only compares; None: no fixture runs."""
    if not (reload and fixtures):
        return None
    return "DEVELOPMENT" if development else "TEST"
