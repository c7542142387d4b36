"""Incremental updates from a change stream.

Each micro-batch takes the newest change of every key, new ones and those whose wait is over, commits edges, finds what is affected before
and after, and recomputes only that, for every configuration. State is a versioned snapshot (committed, edges, waiting, results and the targets of each configuration);
a batch that fails leaves the last version in place. An update whose document isn't in the store yet waits with linear backoff and becomes a
dead letter after the last retry. An update that is older than the store's document is a dead letter at once: versions only grow, so it can't succeed later.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Registry, SourceConfig
from ..model import EDGES, key
from ..operators import dirty, graph
from ..operators.extract import extract
from ..operators.recompute import recompute, sources, upsert
from ..operators.resolve import get_versioned
from ..sources.changes import latest
from ..storage import Snapshots, checkpointed

BASE_DELAY_MS = 10_000
MAX_RETRIES = 10


def backoff(failed: DataFrame, now: Column, base_ms: int = BASE_DELAY_MS, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Adds retries + 1, due (now + retries * base) and dead (no retries left) to failed changes."""
    tries = F.col("retries") + 1
    return failed.withColumns({"retries": tries, "due": now + tries * base_ms, "dead": tries > max_retries})


def split_dead(retried: DataFrame) -> tuple[DataFrame, DataFrame]:
    return retried.where("NOT dead").drop("dead"), retried.where("dead").drop("dead", "due")


def accept(changes: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes to apply, stale ones (the store has another version), and those whose document is missing. Every newest change is in one of them."""
    judged = get_versioned(latest(changes), documents)
    good = (F.col("action") == "DELETE") | (F.col("status") == "OK")
    return judged.where(good), judged.where(~good & (F.col("status") == "EXPIRED")), judged.where(~good & (F.col("status") == "MISSING"))


CHANGE = ("action", "key", "version", "retries")


class Updater:
    """Applies changes of the sources of one configuration or of all in a registry. documents: a function that returns the store's current documents (key, version, doc)."""

    def __init__(
        self, snapshots: Snapshots, configs: SourceConfig | Registry, documents: Callable[[], DataFrame], max_depth: int | None = None, prune: bool = False,
        base_ms: int = BASE_DELAY_MS, max_retries: int = MAX_RETRIES, keep_versions: int | None = None,
    ):
        self.snapshots, self.documents, self.max_depth, self.prune = snapshots, documents, max_depth, prune
        self.configs = [configs] if isinstance(configs, SourceConfig) else configs.configs
        self.base_ms, self.max_retries, self.keep_versions = base_ms, max_retries, keep_versions

    def table(self, config: SourceConfig) -> str:
        """The name of a configuration's targets."""
        return "targets" if len(self.configs) == 1 else f"targets-{config.target_index}-{config.target_type}"

    def _extract(self, docs: DataFrame) -> DataFrame:
        """Edges by the rules of all configurations; an edge that several of them make stands once."""
        parts = [extract(sources(docs, c), c.extract) for c in self.configs if c.extract]
        made = docs.sparkSession.createDataFrame([], EDGES) if not parts else parts[0]
        for p in parts[1:]:
            made = made.unionByName(p)
        return made.dropDuplicates(["tail", "label", "head", "owner"]) if len(parts) > 1 else made

    def start_empty(self) -> None:
        """A first version from all documents."""
        docs = self.documents()
        edges = checkpointed(self._extract(docs))
        made = {c: recompute(docs, edges, c) for c in self.configs}
        waiting = docs.sparkSession.createDataFrame([], f"action string, key {docs.schema['key'].dataType.simpleString()}, version long, retries int, due long")
        targets = {self.table(c): m.where("status = 'OK'").select("key", "doc", "from_source") for c, m in made.items()}
        self.snapshots.commit(committed=docs.select("key", "version"), edges=edges, waiting=waiting, results=self._results(made), **targets)

    def _results(self, made: dict[SourceConfig, DataFrame]) -> DataFrame:
        rows = [m.select("key", "status", "from_source") for m in made.values()]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def apply(self, changes: DataFrame, now_ms: int = 0) -> DataFrame:
        """Commits a batch of changes (action, key, version, retries) and those that wait until now_ms at most; returns the dead letters."""
        docs = self.documents()
        waiting = self.snapshots.read("waiting")
        over = F.col("due") <= now_ms
        good, stale, missing = accept(checkpointed(changes.select(*CHANGE).unionByName(waiting.where(over).select(*CHANGE))), docs)
        good = checkpointed(good)
        retried, dead = split_dead(backoff(checkpointed(missing.select(*CHANGE)), F.lit(now_ms).cast("long"), self.base_ms, self.max_retries))
        waiting = waiting.where(~over).unionByName(retried.select(*CHANGE, "due"))
        committed, edges = self.snapshots.read("committed"), self.snapshots.read("edges")
        updates = good.where("action = 'UPDATE'")
        gone = good.where("action = 'DELETE'").select("key")
        new_edges = self._extract(docs.join(updates.select("key"), "key", "left_semi"))
        now, with_new, _ = graph.commit(committed, edges, updates.select("key", "version"), new_edges)
        now, after = graph.delete(now, with_new, gone)
        now, after = checkpointed(now), checkpointed(after)
        keys = dirty.around_commit(edges, after, good.select("key"), max_depth=self.max_depth)
        live = checkpointed(keys.join(now, "key", "left_semi"))
        store = docs.join(now, ["key", "version"], "left_semi")
        targets, made = {}, {}
        for config in self.configs:
            made[config] = checkpointed(recompute(store, after, config, only=live))
            lost = None
            if self.prune:
                lost = sources(gone, config).select(key(F.lit(config.target_index), F.lit(config.target_type), F.col("key")["id"]).alias("key"))
            targets[self.table(config)] = upsert(self.snapshots.read(self.table(config)), made[config], lost)
        letters = checkpointed(stale.select(*CHANGE).unionByName(dead.select(*CHANGE)))
        self.snapshots.commit(committed=now, edges=after, waiting=waiting, results=self._results(made), **targets)
        if self.keep_versions:
            self.snapshots.drop_old(self.keep_versions)
        return letters

    def flush(self) -> None:
        """Forgets the changes that wait."""
        names = ("committed", "edges", "results", *(self.table(c) for c in self.configs))
        self.snapshots.commit(waiting=self.snapshots.read("waiting").limit(0), **{n: self.snapshots.read(n) for n in names})

    def run(self, changes: DataFrame, checkpoint: str, dead_letters: str, interval: str | None = None) -> StreamingQuery:
        """Follows a streaming source of changes; dead letters go to the folder, one part for each micro-batch, which a replay of the batch replaces.

        interval: time between micro-batches of a query that goes on; without it the query ends once all changes are applied.
        """

        def batch(df: DataFrame, number: int) -> None:
            if not df.isEmpty():
                self.apply(df, int(time.time() * 1000)).write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")

        when = {"processingTime": interval} if interval else {"availableNow": True}
        return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**when).start()


class Feed:
    """An updater's query that can be paused: changes that come meanwhile stay in the source, and the checkpoint says where to go on."""

    def __init__(self, updater: Updater, changes: Callable[[], DataFrame], checkpoint: str, dead_letters: str, interval: str | None = None):
        self.updater, self.changes, self.checkpoint, self.dead_letters, self.interval = updater, changes, checkpoint, dead_letters, interval
        self.query: StreamingQuery | None = None

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def resume(self) -> StreamingQuery:
        if not self.running:
            self.query = self.updater.run(self.changes(), self.checkpoint, self.dead_letters, self.interval)
        return self.query  # type: ignore[return-value]

    def pause(self) -> None:
        """Stops after the micro-batch at hand; one that is cut short is done again."""
        if self.query is not None:
            self.query.stop()
            self.query = None
