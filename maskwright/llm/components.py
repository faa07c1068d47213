"""Connected components of a distributed edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

#: Edge tables of up to this many rows, some tens of MB, are one task's work.
SMALL = 100_000
#: A node with more than this share of all edges is joined by broadcast: there are at most two such nodes for each share
#: of the edges.
HOT_SHARE = 1 / 512


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` (a, b), with ``m``, the smallest b of each a. The edges of a few very large stars stay where they are.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    bound = max(n * HOT_SHARE, 64)
    hot = least.where(F.col("degree") > bound).select("a", "m")  # n / bound rows at most, a thousand
    marked = edges.join(F.broadcast(hot), "a", "left")
    rest = marked.where("m IS NULL").drop("m").join(least.where(F.col("degree") <= bound).select("a", "m"), "a")
    return marked.where("m IS NOT NULL").unionByName(rest)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _with_least(both, 2 * n).withColumn("m", F.least("a", "m"))
    return least.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    moved = _with_least(edges, n).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(edges.groupBy("a").agg(F.min("b").alias("b")))


def _order(value: Any) -> Any:
    """A key that orders values as Spark does: structs by their fields, nulls first."""
    return tuple((v is not None, v) for v in value.values()) if isinstance(value, dict) else value


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a small table."""
    values: dict[Any, Any] = {}
    up: dict[Any, Any] = {}

    def root(x: Any) -> Any:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ends = []
            for value in pair:
                key = _order(value)
                values.setdefault(key, value)
                up.setdefault(key, key)
                ends.append(root(key))
            up[max(ends)] = min(ends)
    if values:
        nodes = [pa.array([values[x] for x in up], kind), pa.array([values[root(x)] for x in up], kind)]
        yield pa.RecordBatch.from_arrays(nodes, ["node", "component"])


def connected_components(edges: DataFrame, small: int = 0) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: values of one ordered type): the smallest node reachable from
    it.

    Loops, repeated edges and either direction are allowed, edges with a null are ignored, no edges give no rows. A
    table of up to ``small`` edges is one task's work. In a larger one a round moves each edge's far end to the smallest
    neighbour; as the edges only ever point to smaller nodes, the rounds end in stars, after a number that grows with
    the logarithm of the longest path. Each round is written to the shared folder, and the one before the last is
    removed; only its row count and checksum reach the driver.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, seen, old = materialize(now.distinct(), "edges"), None, None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark[0] <= small and seen is None:
            kind = now.schema["a"].dataType.simpleString()
            found = now.coalesce(1).mapInArrow(_in_one_task, f"node {kind}, component {kind}")
            return materialize(found, "components")
        if mark == seen or mark[0] == 0:
            break
        if old is not None:
            discard(old)
        seen, old = mark, now
        stars = materialize(_large_star(now, mark[0]).distinct(), "stars")
        now = materialize(_small_star(stars, mark[0]).distinct(), "edges")
        discard(stars)
    roots = now.select(F.col("b").alias("node")).distinct()
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(roots.select("node", F.col("node").alias("component")))
