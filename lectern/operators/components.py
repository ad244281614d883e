"""Union-find grouping: connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import keep

EDGE = "node long, root long"
#: Edges up to which one task holds the whole forest (16 bytes an edge in Arrow, some 300 in the forest).
ONE_TASK = 500_000


def find(parent: dict[int, int], x: int) -> int:
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x], x = root, up
    return root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges, the smaller node always the root."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((find(parent, int(x)) for x in nodes), np.int64, len(parent))
    differ = nodes != roots
    nodes, roots = nodes[differ], roots[differ]
    for i in range(0, len(nodes), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 50_000]), pa.array(roots[i : i + 50_000])], ["node", "root"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("node").alias("u"), F.col("root").alias("v")).union(e.select(F.col("root"), F.col("node")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("node"), F.col("m").alias("root"))
    return moved.union(least.select(F.col("u"), F.col("m"))).distinct()


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for each node of the edges (node, root) but the roots; a root is its group's least node.

    Each partition first contracts its own edges by union-find. If what is left has at most
    `one_task` edges (counted, not assumed) one task joins the forests, else large-star and
    small-star rounds run until nothing changes; both give the same rows. Edges with a null end and
    loops are dropped; repeated edges change nothing; an empty table gives an empty one.
    """
    edges = edges.toDF("node", "root").where("node <> root").select(F.col("node").cast("long"), F.col("root").cast("long"))
    forest = keep(edges.mapInArrow(_forest, EDGE), "forest")
    if forest.count() <= one_task:
        return forest.coalesce(1).mapInArrow(_forest, EDGE)
    last = None
    while True:
        forest = keep(_small_star(_large_star(forest)), "stars")
        now = forest.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == last:
            return forest
        last = now
