"""Rows in one order over all tasks, with places and running totals that hold over all of them.

Rows are sorted by range, so a task has a run of them, and no group, however large, has to fit into one task. Each run is
numbered by itself as it streams by; what a group has in earlier runs is then added from a table of one row a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import stored

__all__ = ["in_order"]


def _numbered(group: list[str], sums: list[str], mask: int):
    """Adds to each batch of a sorted run: idx in the run, nth in the group, and totals of sums in the group so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, nth, totals = None, 0, 0, [0] * len(sums)
        for b in batches:
            if not b.num_rows:
                continue
            fresh = np.zeros(b.num_rows, bool)
            fresh[0] = last != [b.column(g)[0].as_py() for g in group]
            for g in group:
                fresh[1:] |= pc.not_equal(b.column(g)[1:], b.column(g)[:-1]).to_numpy(zero_copy_only=False)
            last = [b.column(g)[-1].as_py() for g in group]
            at = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(fresh, at, -1))
            place = np.where(start < 0, nth + at + 1, at - start + 1)
            out = [pa.array(seen + at), pa.array(place)]
            for k, name in enumerate(sums):
                x = b.column(name).to_numpy(zero_copy_only=False)
                c = np.cumsum(x)
                now = np.where(start < 0, totals[k] + c, c - np.where(start < 0, 0, (c - x)[start])) & mask
                totals[k] = int(now[-1])
                out.append(pa.array(now))
            seen, nth = seen + b.num_rows, int(place[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, "idx", "nth", *(f"all_{s}" for s in sums)])

    return run


def in_order(df: DataFrame, keys: list[str | Column], group: list[str], sums: tuple[str, ...] = (), bits: int = 63, label: str = "runs") -> DataFrame:
    """df and nth, the place from 1 of each row in its group by keys, and all_<x> for each of sums, the total of x up to the row.

    df is a written table. keys begin with the columns of group, none of them null. Rows with equal keys come in the order of
    the files, which also spreads them over runs, so they must be ties that do not matter. Totals are taken modulo 2 to the power bits; sums are columns of type long without nulls."""
    mask = (1 << bits) - 1
    columns, keys, df = df.columns, [*keys, "tie"], df.withColumn("tie", F.monotonically_increasing_id())
    wide = T.StructType([*df.schema.fields, T.StructField("run", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("idx", "nth", *(f"all_{s}" for s in sums)))])
    runs = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("run", F.spark_partition_id())
    runs = stored(runs.mapInArrow(_numbered(group, list(sums), mask), wide), label)
    counted = ["nth", *(f"all_{s}" for s in sums)]
    ends = runs.groupBy("run").agg(F.min_by(F.struct(*group), "idx").alias("first"), F.max_by(F.struct(F.struct(*group).alias("g"), *counted), "idx").alias("last"))
    # A group in several runs is the last of the first one and the whole of those between, so totals of last groups are enough.
    of_group = Window.partitionBy("last.g").orderBy("run")
    before = ends.select("run", "first", "last.g", *(F.sum(f"last.{c}").over(of_group).bitwiseAND(mask).alias(c) for c in counted))
    by_run = Window.orderBy("run")  # one row a run
    carried = before.select("run", "first", F.lag("g").over(by_run).alias("same"), *(F.lag(c).over(by_run).alias(f"before_{c}") for c in counted))
    carried = stored(carried.where("first = same").select(F.col("run").alias("run_"), *(F.col(f"first.{g}").alias(f"{g}_") for g in group), *(f"before_{c}" for c in counted)), f"{label}-carried")
    on = F.col("run") == F.col("run_")
    for g in group:
        on &= F.col(g) == F.col(f"{g}_")
    whole = [(F.col(c) + F.coalesce(f"before_{c}", F.lit(0))).bitwiseAND(mask).alias(c) for c in counted]
    return runs.join(carried, on, "left").select(*columns, *whole)
