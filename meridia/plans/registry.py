"""A registry of models. A model is a function of a build, which it asks for other models; what
it asks for is what it depends on, so that the graph is never written down twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.config import DEFAULTS, Params
from meridia.sources import readers, writers

Model = Callable[["Build"], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.models: dict[str, tuple[Model, bool]] = {}

    def model(self, stored: bool = False) -> Callable[[Model], Model]:
        """Register a function under its own name; ``stored`` models are written as tables."""

        def enter(f: Model) -> Model:
            if f.__name__ in self.models:
                raise ValueError(f"two models are called {f.__name__}")
            self.models[f.__name__] = f, stored
            return f

        return enter


class Build:
    """One run over given sources. Models are made once; cycles are errors."""

    def __init__(self, spark: SparkSession, registry: Registry, sources: dict[str, DataFrame], params: Params = DEFAULTS, folder: str | None = None):
        self.spark, self.registry, self.sources, self.params, self.folder = spark, registry, sources, params, folder
        self.made: dict[str, DataFrame] = {}
        self.counts: dict[str, int] = {}
        self.edges: dict[str, list[str]] = {}
        self.open: list[str] = []

    def source(self, name: str) -> DataFrame:
        return self.sources[name]

    def has(self, *names: str) -> bool:
        """Whether sources are there, for models that are built from what there is."""
        return all(n in self.sources for n in names)

    def __call__(self, name: str) -> DataFrame:
        if self.open:
            self.edges.setdefault(self.open[-1], []).append(name)
        if name in self.open:
            raise ValueError(" -> ".join([*self.open, name]))
        if name not in self.made:
            make, stored = self.registry.models[name]
            self.open.append(name)
            try:
                df = make(self)
            finally:
                self.open.pop()
            if stored and self.folder:
                path = f"{self.folder}/{name}"
                self.counts[name] = writers.table(df, path)
                df = self.spark.read.parquet(path)
            self.made[name] = df
            df.createOrReplaceTempView(name)
        return self.made[name]

    def feed(self, code: str, folder: str, *tables: str) -> None:
        """Enter the tables of a feed that exist as sources named code.table."""
        for t in tables or readers.SCHEMAS:
            if readers.exists(self.spark, f"{folder}/{t}.txt"):
                self.sources[f"{code}.{t}"] = readers.feed_table(self.spark, folder, t)
