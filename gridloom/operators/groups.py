"""Connected components of links within plans: forests of each task's links, then star steps between tasks.

Defined results. Links of a node with itself, repeated ones and either direction of a link are the same; rows with a null are
no links. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import dropped, stored

_LINK = "plan_id long, hi long, lo long"


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the links that a task sees, as many as connect the same nodes, each with the least node it is connected with."""
    parent: dict[tuple[int, int], int] = {}

    def top(plan: int, node: int) -> int:
        path = []
        while (up := parent.get((plan, node), node)) != node:
            path.append(node)
            node = up
        for p in path:
            parent[plan, p] = node
        return node

    for rows in batches:
        for plan, a, b in zip(rows.plan_id.tolist(), rows.a.tolist(), rows.b.tolist(), strict=True):
            a, b = top(plan, a), top(plan, b)
            if a != b:
                parent[plan, max(a, b)] = min(a, b)
    rows = [(plan, node, top(plan, node)) for plan, node in list(parent)]
    yield pd.DataFrame(rows, columns=["plan_id", "hi", "lo"]).astype("int64")


def _stars(links: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One step that hangs the greater neighbours of every node on its least one, and one that does so with the lesser ones."""
    both = keep(links.unionByName(links.selectExpr("plan_id", "lo as hi", "hi as lo")))
    least = both.groupBy("plan_id", "hi").agg(F.least(F.min("lo"), F.first("hi")).alias("root"))
    large = keep(both.join(keep(least), ["plan_id", "hi"]).where("lo > hi").selectExpr("plan_id", "lo as hi", "root as lo").distinct())
    root = keep(large.groupBy("plan_id", "hi").agg(F.min("lo").alias("root")))
    small = large.join(root, ["plan_id", "hi"]).where("lo <> root").selectExpr("plan_id", "lo as hi", "root as lo")
    return keep(small.unionByName(root.selectExpr("plan_id", "hi", "root as lo")).distinct())


def connected(links: DataFrame) -> DataFrame:
    """For each node of links (plan_id, a, b) the least one that it is connected with: plan_id, node, root.

    Every step is a table in the shared folder, so joins read both sides from an exchange and Spark can split a hub's rows; the
    distance between nodes halves each round, and nothing is collected but a count and a checksum."""
    spark, old = links.sparkSession, []
    links = stored(links.select("plan_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).na.drop(), "links")
    nodes = links.selectExpr("plan_id", "a as node").unionByName(links.selectExpr("plan_id", "b as node")).distinct()
    now = stored(links.where("a <> b").mapInPandas(_forest, _LINK).distinct(), "forest", old)
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("plan_id", "hi", "lo").cast("decimal(38,0)"))).first())
    last, told = None, state(now)
    while told[0] and told != last:  # a round that changes nothing leaves every node at its root
        new: list[str] = []
        now = _stars(now, lambda df: stored(df, "stars", new))
        last, told = told, state(now)
        dropped(spark, [*old, *new[:-1]])
        old = new[-1:]
    return nodes.join(now.withColumnRenamed("hi", "node"), ["plan_id", "node"], "left").select("plan_id", "node", F.coalesce("lo", "node").alias("root"))
