"""Walks: reachability from many roots at once, and the exact traversal tree.

`reach` gives the set of reached vertices with the fewest steps to them. `chain` is for references of known length: joins
without rounds, all in one plan. `tree` gives the spanning tree of a traversal that visits the children of a
vertex together and then descends child by child.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import IN
from ..storage import checkpointed


def steps(edges: DataFrame, direction: str, distinct: bool = True) -> DataFrame:
    """node, to: one step of a walk. IN goes from heads to tails."""
    a, b = ("head", "tail") if direction == IN else ("tail", "head")
    made = edges.select(F.col(a).alias("node"), F.col(b).alias("to"))
    return made.distinct() if distinct else made


def reach(edges: DataFrame, roots: DataFrame, direction: str, max_depth: int | None = None) -> DataFrame:
    """root, node, depth of everything that the roots (key) reach, themselves included at depth 0.

    Each round extends only what the last one found; vertices that a root has seen are dropped, so cycles and
    diamonds end. Rounds are checkpoints in the shared folder. At most max_depth steps.
    """
    step = checkpointed(steps(edges, direction))
    frontier = checkpointed(roots.select(F.col("key").alias("root"), F.col("key").alias("node"), F.lit(0).alias("depth")).distinct())
    found = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(step, "node").select("root", F.col("to").alias("node")).distinct().join(found, ["root", "node"], "left_anti")
        frontier = checkpointed(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def reachable(edges: DataFrame, keys: DataFrame, direction: str, max_depth: int | None = None) -> DataFrame:
    """node: the set of what any of the keys reaches, themselves included. Unlike `reach` it doesn't tell roots apart, so a vertex stands once however many lead to it."""
    step = steps(edges, direction, distinct=False)
    found = frontier = checkpointed(keys.select(F.col("key").alias("node")).distinct())
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        frontier = checkpointed(frontier.join(step, "node").select(F.col("to").alias("node")).distinct().join(found, "node", "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def closure(edges: DataFrame, direction: str) -> DataFrame:
    """root, node, depth for all vertices with edges as roots, without depth 0: distances double each round, so long chains take few."""
    found = steps(edges, direction).where("node <> to").select(F.col("node").alias("root"), F.col("to").alias("node"), F.lit(1).alias("depth"))
    found = checkpointed(found)
    size = -1
    while (now := found.count()) != size:
        size = now
        far = found.select(F.col("root").alias("mid"), F.col("node").alias("to"), F.col("depth").alias("more"))
        longer = found.join(far, found["node"] == far["mid"]).select("root", F.col("to").alias("node"), (F.col("depth") + F.col("more")).alias("depth")).where("root <> node")
        found = checkpointed(found.unionByName(longer).groupBy("root", "node").agg(F.min("depth").alias("depth")))
    return found


def chain(edges: DataFrame, roots: DataFrame, direction: str, depth: int) -> DataFrame:
    """Like reach with max_depth, for small depths: unrolled joins that the optimizer sees as one plan."""
    step = steps(edges, direction, distinct=False)  # the last step removes repeats; edges differ but for labels and owners
    level = roots.select(F.col("key").alias("root"), F.col("key").alias("n0"))
    if direction == IN:
        # paths fan out: each level by itself, so that near vertices aren't repeated for far ones
        level = level.withColumnRenamed("n0", "node")
        found = level.withColumn("depth", F.lit(0))
        for d in range(1, depth + 1):
            level = level.join(step, "node").select("root", F.col("to").alias("node"))
            # paths that meet again go on as one; the last step's repeats go below
            level = level.distinct() if 1 < d < depth else level
            found = found.unionByName(level.withColumn("depth", F.lit(d)))
    else:
        # references mostly lead to one document: one row for each path, one join for each step
        for d in range(1, depth + 1):
            level = level.join(step.select(F.col("node").alias(f"n{d - 1}"), F.col("to").alias(f"n{d}")), f"n{d - 1}", "left")
        on_path = F.posexplode(F.array(*[F.col(f"n{d}") for d in range(depth + 1)])).alias("depth", "node")
        found = level.select("root", on_path).where("node IS NOT NULL").select("root", "node", "depth")
    return found.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def leaves(reached: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """Reached vertices without a further step."""
    inner = steps(edges, direction).select("node").distinct()
    return reached.join(inner, "node", "left_anti").select(reached.columns)


def tree(reached: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """root, node, parent, label, seq, depth: the traversal tree of each root over what it reaches.

    Children are ordered by label and key. A vertex that was seen is not visited again. One root's subgraph is worked on in one task.
    """
    a, b = ("head", "tail") if direction == IN else ("tail", "head")
    text = lambda c: F.to_json(F.struct(F.col(c)["index"], F.col(c)["type"], F.col(c)["id"]))
    inside = reached.select("root", "node").join(edges.select(F.col(a).alias("node"), F.col(b).alias("to"), "label").distinct(), "node", "left")
    rows = inside.select(text("root").alias("root"), text("node").alias("node"), F.when(F.col("to").isNotNull(), text("to")).alias("to"), "label", F.struct(F.col("label"), F.col("to")["index"], F.col("to")["type"], F.col("to")["id"]).alias("o"))
    rows = rows.select("root", "node", "to", "label", F.to_json("o").alias("o"))

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        root = pdf["root"].iloc[0]
        pdf = pdf[pdf["to"].notna()].sort_values("o", kind="stable")
        children: dict[str, list[tuple[str, str]]] = {}
        for node, to, label in zip(pdf["node"], pdf["to"], pdf["label"], strict=True):
            children.setdefault(node, []).append((to, label))
        seen, out, stack = {root}, [(root, root, None, None, 0, 0)], [(root, 0)]
        while stack:
            node, depth = stack.pop()
            now = []
            for to, label in children.get(node, ()):
                if to not in seen:
                    seen.add(to)
                    out.append((root, to, node, label, len(out), depth + 1))
                    now.append((to, depth + 1))
            stack += reversed(now)
        return pd.DataFrame(out, columns=["root", "node", "parent", "label", "seq", "depth"])

    made = rows.groupBy("root").applyInPandas(visit, "root string, node string, parent string, label string, seq int, depth int")
    back = lambda c: F.from_json(F.col(c), "struct<index:string,type:string,id:string>")
    return made.select(back("root").alias("root"), back("node").alias("node"), back("parent").alias("parent"), "label", "seq", "depth")


def flattened(trees: DataFrame) -> DataFrame:
    """The trees' rows in breadth-first order: adds position in the root's tree."""
    from pyspark.sql import Window

    return trees.withColumn("position", F.row_number().over(Window.partitionBy("root").orderBy("depth", "seq")) - 1)


def pretty(trees: DataFrame) -> DataFrame:
    """root, seq, line: each vertex indented by two spaces for each level."""
    return trees.select("root", "seq", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.concat_ws("/", "node.index", "node.type", "node.id")).alias("line"))


def first_visits(visits: DataFrame, of: list[str], order: str) -> DataFrame:
    """The first of all visits that agree in the columns of; order tells which is first, and no two agree in both."""
    rest = [c for c in visits.columns if c not in of]
    made = visits.groupBy(*of).agg(F.min_by(F.struct(*rest), order).alias("first"))
    return made.select(*[F.col(c) if c in of else F.col("first")[c].alias(c) for c in visits.columns])


def any_stop(*stops: Column) -> Column:
    """Stops where one of several conditions does; an unknown one doesn't."""
    return F.greatest(*[F.coalesce(s, F.lit(False)) for s in (*stops, F.lit(False), F.lit(False))])


def in_tree(trees: DataFrame, wanted: DataFrame) -> DataFrame:
    """root, node: those of the wanted pairs whose node stands in the root's tree (or reach)."""
    return wanted.select("root", "node").join(trees.select("root", "node"), ["root", "node"], "left_semi")


def map_tree(trees: DataFrame, documents: DataFrame, value: Column) -> DataFrame:
    """The trees, node by node in the same shape, with value: an expression over each node's document (doc), which is null if there is none."""
    store = documents.select(F.col("key").alias("node"), "doc")
    return trees.join(store, "node", "left").select(*trees.columns, value.alias("value"))
