"""Streams of graph deltas: each pair of successive snapshots as command lines in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import delta, graph
from ..sources.store import Folder
from ..storage import Snapshots


def write_deltas(snapshots: Snapshots, before: int, after: int, folder: str) -> None:
    """Appends the commands that lead from one version to another as JSON lines."""
    v = [graph.vertices(snapshots.read("committed", n), snapshots.read("edges", n)) for n in (before, after)]
    e = [snapshots.read("edges", n) for n in (before, after)]
    commands = delta.encoded(delta.nodes(*v).unionByName(delta.edges(*e)))
    commands.select("command").write.mode("append").text(folder)


class Channels(Folder):
    """Named channels of commands, each a growing folder of JSON lines that any number of readers can follow with readStream.text."""

    def create(self, name: str, edges: DataFrame | None = None, keys: DataFrame | None = None) -> None:
        """Opens a channel; one that is open stays. keys: vertices that are sent straight away, with their neighbours."""
        self.make(name)
        if keys is not None:
            self.update(name, edges, keys)

    def update(self, name: str, edges: DataFrame, keys: DataFrame) -> None:
        """Sends the neighbourhood of vertices to an open channel."""
        if not self.exists(name):
            raise KeyError(f"there is no channel {name}")
        made = delta.unfold(edges, keys).selectExpr("op", "name", "cast(map() as map<string,string>) AS props")
        self._send(name, delta.encoded(made))

    def follow_all(self, name: str) -> None:
        """Opens a channel that gets every published change of the graph."""
        self.make(name)
        self.make(name, "_all")

    def publish(self, commands: DataFrame) -> None:
        """Sends encoded commands to all channels that follow everything."""
        for name in self.names():
            if self.exists(name, "_all"):
                self._send(name, commands)

    def _send(self, name: str, commands: DataFrame) -> None:
        commands.select("command").write.mode("append").text(self.at(name))
