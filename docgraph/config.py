"""What a user configures: sources, extraction, filter, transformation, walks and properties."""

from __future__ import annotations

import runpy
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

from .model import IN, OUT


@dataclass(frozen=True)
class Property:
    """An attribute computed from a walk: either an aggregate over the reached documents or a function of the document tree.

    aggregate: from a column factory of the reached document (struct) to an aggregate Column.
    tree: from the tree as nested dicts to a JSON value. nested is accepted and has no effect.
    """

    name: str
    aggregate: Callable[[Column], Column] | None = None
    tree: Callable[[dict], object] | None = None
    nested: bool = False
    #: Value for documents whose walk reaches nothing that is aggregated.
    empty: object = None

    def __post_init__(self) -> None:
        if (self.aggregate is None) == (self.tree is None):
            raise ValueError(f"property {self.name}: give either aggregate or tree")


@dataclass(frozen=True)
class Walk:
    name: str
    direction: str
    properties: tuple[Property, ...]
    #: Number of steps, where the chain of references has a known length; None: as far as it goes.
    depth: int | None = None
    #: Which reached documents are aggregated (on key and doc); None: all but the root.
    where: Callable[[Column, Column], Column] | None = None

    def __post_init__(self) -> None:
        if self.direction not in (IN, OUT):
            raise ValueError(f"walk {self.name}: direction is IN or OUT, not {self.direction}")


@dataclass(frozen=True)
class SourceConfig:
    """How documents of one source become documents of one target."""

    target_index: str
    target_type: str
    source_index: str
    source_type: str | None
    extract: tuple = ()
    filter: Callable[[Column], Column] | None = None
    transform: Callable[[Column], Column] | None = None
    walks: tuple[Walk, ...] = ()

    def __post_init__(self) -> None:
        names = [p.name for w in self.walks for p in w.properties]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"{self.target_index}/{self.target_type}: property names must be unique: {twice}")


@dataclass
class Registry:
    """All configurations. A directory holds a folder for each target index with files <target type>.conf.py that define CONFIG."""

    configs: list[SourceConfig] = field(default_factory=list)

    @classmethod
    def load(cls, directory: str | Path) -> Registry:
        found = []
        for folder in sorted(p for p in Path(directory).iterdir() if p.is_dir() and p.name != "fixtures"):
            for file in sorted(folder.glob("*.conf.py")):
                settings = runpy.run_path(str(file))["CONFIG"]
                found.append(SourceConfig(target_index=folder.name, target_type=file.name.removesuffix(".conf.py"), **settings))
        return cls(found)

    def reload(self, directory: str | Path) -> Registry:
        """The configurations of the directory, or these if they can't be loaded."""
        try:
            return Registry.load(directory)
        except Exception:  # noqa: BLE001  whatever a configuration raises, the last good one stays
            return self

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.target_index, c.target_type, c.source_index, c.source_type) for c in self.configs]
        return spark.createDataFrame(rows, "target_index string, target_type string, source_index string, source_type string")

    def matching(self, index: str, kind: str | None) -> list[SourceConfig]:
        return [c for c in self.configs if c.source_index == index and (kind is None or c.source_type is None or c.source_type == kind)]
