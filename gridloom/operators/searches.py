"""Searches over the rows of one plan, many plans at once in a task, without a frame for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.session import spread

#: Plans whose rows are sent back at once.
_AT_ONCE = 500


def by_plan(tables: list[DataFrame], one: Callable[..., list[tuple]], kinds: str) -> DataFrame:
    """The rows that one(plan_id, rows of the first table, of the second, ..) gives for each plan that any of tables has, as kinds,
    Spark's text of a schema, tells.

    Rows come as tuples without plan_id, in no order. All rows of a plan move once, together."""
    columns = [[c for c in t.columns if c != "plan_id"] for t in tables]
    types = [t.select(F.struct(*cs).alias("t")).schema["t"].dataType for t, cs in zip(tables, columns, strict=True)]
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    rows = None
    for k, (t, cs) in enumerate(zip(tables, columns, strict=True)):
        parts = [F.struct(*cs).alias(f"t{k}") if n == k else F.lit(None).cast(kind).alias(f"t{n}") for n, kind in enumerate(types)]
        mine = t.select("plan_id", F.struct(F.lit(k).alias("kind"), *parts).alias("r"))
        rows = mine if rows is None else rows.unionByName(mine)
    plans = spread(rows, "plan_id").groupBy("plan_id").agg(F.collect_list("r").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _AT_ONCE):
                batch = whole.slice(first, _AT_ONCE)
                listed = batch.column("r")
                ends, each = listed.offsets.to_numpy(), listed.values
                kind, given = each.field("kind").to_numpy(), []
                for k, cs in enumerate(columns):
                    at = np.flatnonzero(kind[ends[0] : ends[-1]] == k) + ends[0]
                    some = each.field(f"t{k}").take(pa.array(at))
                    given.append((list(zip(*(some.field(c).to_pylist() for c in cs), strict=True)), np.searchsorted(at, ends).tolist()))
                made = []
                for n, plan in enumerate(batch.column("plan_id").to_pylist()):
                    made += one(plan, *(got[at[n] : at[n + 1]] for got, at in given))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return plans.mapInArrow(run, kinds)
