"""Connected components of a table of links: union-find within each task, then alternating star steps between tasks.

Every step writes a table, so joins read both sides straight from an exchange and Spark can split a hub's rows; the
lineage stays short. Nothing is collected but a count and a checksum a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored


def local_union(edges: DataFrame) -> DataFrame:
    """Links (hi, lo) that connect the same nodes as edges (a, b), one at most for each node that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        pairs = [(x, root(x)) for x in parent if root(x) != x]
        columns = list(zip(*pairs, strict=True)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["hi", "lo"])

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "hi long, lo long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours to the least of them and itself."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if large:
        both = stored(both.unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))), "star-both")
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "star-least")
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return stored(out.where("hi <> lo").distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node it is connected with, for each node of edges (a, b) but the roots themselves."""
    now = stored(local_union(edges).distinct(), "links")
    state = _state(now)
    while state[0]:
        now = _star(_star(now, large=True), large=False)
        last, state = state, _state(now)
        if last == state:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
