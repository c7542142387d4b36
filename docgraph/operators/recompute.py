"""Target documents: filter, walks, transformation, merge; and how each one came out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SourceConfig, Walk
from ..model import key
from . import reduce as red
from . import walk as walks
from .resolve import expired_roots, resolve

#: Outcomes: severity and HTTP code.
OUTCOMES = {
    "OK": ("INFO", 200), "NO_CONFIGURATION": ("INFO", 200), "FILTERED": ("INFO", 200), "EXPIRED": ("ERROR", 400), "SOURCE_MISSING": ("ERROR", 400),
    "NOT_AN_OBJECT": ("ERROR", 400), "INVALID_REQUEST": ("ERROR", 400), "NOT_IN_GRAPH": ("ERROR", 400), "FAILED": ("ERROR", 500),
}


def sources(documents: DataFrame, config: SourceConfig) -> DataFrame:
    k = F.col("key")
    found = documents.where(k["index"] == config.source_index)
    return found if config.source_type is None else found.where(k["type"] == config.source_type)


def truthy(c: Column, kind: str) -> Column:
    """JavaScript's idea of true: not null, false, 0, NaN or an empty string."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(F.length(c), F.lit(0)) > 0
    if kind in ("double", "float"):
        return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def reached(edges: DataFrame, roots: DataFrame, w: Walk) -> DataFrame:
    if w.depth is not None and w.depth <= 6:
        return walks.chain(edges, roots, w.direction, w.depth)
    return walks.reach(edges, roots, w.direction, w.depth)


def walk_values(documents: DataFrame, edges: DataFrame, roots: DataFrame, w: Walk, vertices: DataFrame | None = None, at: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """root with a column for each property of the walk, and the roots that met an expired document. at: what the walk reaches, if known."""
    at = reached(edges, roots, w) if at is None else at
    resolved = resolve(at, documents, vertices)
    out = roots.select(F.col("key").alias("root"))
    plain = {p.name: p.aggregate(F.col("doc")) for p in w.properties if p.aggregate}
    if plain:
        condition = F.col("exists") & (w.where(F.col("node"), F.col("doc")) if w.where else F.col("depth") > 0)
        out = red.aggregate(resolved, roots, plain, condition)
    for p in w.properties:
        if p.tree:
            shaped = walks.tree(at, edges, w.direction)
            out = out.join(red.by_tree(shaped, documents, p.tree, p.name), "root", "left")
    for p in w.properties:
        if p.empty is not None:
            out = out.withColumn(p.name, F.coalesce(p.name, F.lit(p.empty)))
    return out, expired_roots(resolved)


def recompute(documents: DataFrame, edges: DataFrame, config: SourceConfig, only: DataFrame | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """key (of the target), status, doc (transformed fields and properties; null unless OK) and from_source.

    only: keys to recompute. Filter and walks see the raw document. Properties overwrite fields of the same name.
    """
    source = sources(documents, config)
    if only is not None:
        source = source.join(only.select("key"), "key", "left_semi")
    passes = config.filter(F.col("doc")) if config.filter else F.lit(True)
    judged = source.withColumn("passes", F.coalesce(passes, F.lit(False)))
    shaped = config.transform(F.col("doc")) if config.transform else F.col("doc")
    made = judged.where("passes").withColumn("shaped", shaped)
    names, expired = [], None
    for w in config.walks:
        values, late = walk_values(documents, edges, made.select("key"), w, vertices)
        made = made.join(values.withColumnRenamed("root", "key"), "key", "left")
        names += [p.name for p in w.properties]
        if vertices is not None:
            expired = late if expired is None else expired.unionByName(late)
    fields = [f for f in made.schema["shaped"].dataType.fieldNames() if f not in names]
    doc = F.struct(*[F.col("shaped")[f].alias(f) for f in fields], *[F.col(n) for n in names])
    status = F.when(F.col("shaped").isNull(), "NOT_AN_OBJECT").otherwise("OK")
    if expired is not None:
        made = made.join(expired.select(F.col("root").alias("key"), F.lit(True).alias("late")).distinct(), "key", "left")
        status = F.when(F.col("late"), "EXPIRED").otherwise(status)
    target = key(F.lit(config.target_index), F.lit(config.target_type), F.col("key")["id"])
    ok = made.withColumn("status", status).select(target.alias("key"), "status", F.when(F.col("status") == "OK", doc).alias("doc"), F.struct("key", "version").alias("from_source"))
    dropped = judged.where("NOT passes").select(target.alias("key"), F.lit("FILTERED").alias("status"), F.lit(None).alias("doc"), F.struct("key", "version").alias("from_source"))
    return ok.unionByName(dropped.withColumn("doc", F.col("doc").cast(ok.schema["doc"].dataType)))


def outcomes(statuses: DataFrame, column: str = "status") -> DataFrame:
    """Adds severity and http_code."""
    s = F.coalesce(column, F.lit("FAILED"))
    severity = F.element_at(F.create_map(*[F.lit(x) for k, v in OUTCOMES.items() for x in (k, v[0])]), s)
    code = F.element_at(F.create_map(*[F.lit(x) for k, v in OUTCOMES.items() for x in (k, v[1])]), s)
    return statuses.withColumns({"severity": F.coalesce(severity, F.lit("ERROR")), "http_code": F.coalesce(code, F.lit(500))})


def rendered(results: DataFrame, message: Column | None = None) -> DataFrame:
    """Adds response: the JSON text that a caller gets, with status (ok or error), severity, code, outcome and message."""
    made = outcomes(results)
    fields = {"status": F.when(F.col("severity") == "ERROR", "error").otherwise("ok"), "severity": F.lower("severity"), "code": F.col("http_code"), "outcome": F.coalesce("status", F.lit("FAILED"))}
    return made.withColumn("response", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()], *([message.alias("message")] if message is not None else []))))


def request_outcome(results: DataFrame, request: str) -> DataFrame:
    """One row for each request: it fails if any of its results is an error; the worst code counts."""
    made = outcomes(results)
    return made.groupBy(request).agg(F.when(F.bool_or(F.col("severity") == "ERROR"), "ERROR").otherwise("INFO").alias("severity"), F.max("http_code").alias("http_code"), F.count("*").alias("results"))


def upsert(targets: DataFrame, new: DataFrame, prune: DataFrame | None = None) -> DataFrame:
    """Targets (key, doc, from_source) with the OK rows of new put over them. prune: keys to remove; by default nothing is ever removed."""
    fresh = new.where("status = 'OK'").select("key", "doc", "from_source")
    kept = targets.join(fresh.select("key"), "key", "left_anti")
    if prune is not None:
        kept = kept.join(prune.select("key"), "key", "left_anti")
    return kept.unionByName(fresh)
