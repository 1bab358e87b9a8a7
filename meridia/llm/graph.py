"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import reliable

#: Edges up to which one task finds the components (16 MB), rather than steps over all of them.
FEW_EDGES = 1_000_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, and of each the smallest node reachable."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (x, y, label[x], label[y]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map function over all edges: a row for each node."""
    held = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if held:
        node, root = labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) to rows (node, root): root is the smallest node reachable.

    Up to FEW_EDGES edges, as counted, are one task's work. Beyond, alternating large-star and
    small-star steps (Kiveris et al., 2014) until the edges are stars: nothing but a row count and
    a checksum comes to the driver, and minima are combined before each shuffle, so that a component
    of any size is no one task's work. Null ends and loops are left out; no edges give no rows.
    """
    edges = reliable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    if edges.count() <= FEW_EDGES:
        return edges.coalesce(1).mapInArrow(in_one_task, "node long, root long")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = reliable(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = reliable(small)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now.n:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
