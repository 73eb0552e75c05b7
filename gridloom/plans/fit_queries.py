"""Queries of the fit of zones to boxes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import fit, groups
from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query
from gridloom.plans.layout_queries import _NEEDS, ZONES
from gridloom.session import stored

#: How far a box may be from its zone, the phase of bars, and how close bars may be.
SNAP, FAR, QUANTUM, GAP = 300, 4000, 50, 60
#: Every second zone, so that others have to grow or to be made; rooms around all boxes.
_HALF = f"select * from ({ZONES}) as z where zone_id % 2 = 0"
_ROOMS = f"select plan_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from ({fx.BOXES12}) as r group by plan_id"
_CLASSES = f"select distinct plan_id, cls, cast(step as double) as step, cast(2 * step as double) as least, cast(1000.0 / step as double) as density from ({ZONES}) as k"


@dataclass
class Fit:
    """The tables of the fit, each written when first asked for."""

    boxes: DataFrame
    needs: DataFrame
    zones: DataFrame
    classes: DataFrame
    rooms: DataFrame
    keep: bool = False

    @classmethod
    def of(cls, spark, sf_dir, keep=False) -> Fit:
        return cls(*(fx.view(spark, sf_dir, q) for q in (fx.BOXES12, _NEEDS, _HALF, _CLASSES, _ROOMS)), keep)

    @cached_property
    def assigned(self) -> DataFrame:
        return stored(fit.assigned(self.boxes, self.needs, self.zones, self.classes, self.rooms, FAR if self.keep else SNAP, keep=self.keep), "fit")

    @cached_property
    def required(self) -> DataFrame:
        return stored(fit.required(self.assigned, self.boxes), "fit")

    @cached_property
    def served(self) -> DataFrame:
        """Zones that were there, and those that were made, at what they hold."""
        made = self.required.where("created").select("plan_id", "zone_id", "cls", *(F.col(f"q_{c}").alias(c) for c in fit.SIDES))
        own = self.zones.select("plan_id", "zone_id", "cls", *(F.col(c).cast("double").alias(c) for c in fit.SIDES))
        return stored(own.unionByName(made), "fit")

    @cached_property
    def pairs(self) -> DataFrame:
        return stored(fit.coincident(self.served, self.assigned), "fit")

    @cached_property
    def grouped(self) -> DataFrame:
        return stored(fit.edge_groups(self.served, self.pairs), "fit")

    @cached_property
    def structural(self) -> DataFrame:
        return stored(fit.structural(self.served, self.grouped, self.required, self.classes, self.rooms, QUANTUM), "fit")

    @cached_property
    def fits(self) -> DataFrame:
        """Zones with their class, structural sides, and what they have to hold."""
        at = fit.placed(self.grouped, self.structural).join(self.served.join(self.classes, ["plan_id", "cls"]), ["plan_id", "zone_id"])
        met = at.join(self.required.select("plan_id", "zone_id", "priority", *(f"q_{c}" for c in fit.SIDES)), ["plan_id", "zone_id"], "left")
        return stored(met.withColumns({f"q_{c}": F.coalesce(f"q_{c}", c) for c in fit.SIDES} | {"priority": F.coalesce("priority", F.lit(fit.UNUSED))}), "fit")

    @cached_property
    def candidates(self) -> DataFrame:
        return stored(fit.candidates(self.fits, self.rooms, QUANTUM), "fit")

    @cached_property
    def chosen(self) -> DataFrame:
        return stored(fit.chosen(self.fits, self.candidates, self.pairs, self.assigned, self.boxes, self.rooms, GAP), "fit")


@query()
def l09_assigned(spark, sf_dir):
    return Fit.of(spark, sf_dir).assigned


@query()
def l09_kept(spark, sf_dir):
    return Fit.of(spark, sf_dir, True).assigned


@query()
def l11_coincident(spark, sf_dir):
    return Fit.of(spark, sf_dir).pairs


@query()
def l11_edge_groups(spark, sf_dir):
    return Fit.of(spark, sf_dir).grouped


@query()
def l12_structural(spark, sf_dir):
    return Fit.of(spark, sf_dir).structural


@query()
def l14_candidates(spark, sf_dir):
    return Fit.of(spark, sf_dir).candidates


@query()
def l21_scores(spark, sf_dir):
    return Fit.of(spark, sf_dir).chosen.select("plan_id", "zone_id", F.posexplode_outer("score").alias("pos", "score"))


@query()
def l22_chosen(spark, sf_dir):
    return Fit.of(spark, sf_dir).chosen.select("plan_id", "zone_id", "x0", "x1", "problem")


@query()
def l25_mended(spark, sf_dir):
    return Fit.of(spark, sf_dir).chosen.select("plan_id", "zone_id", F.col("m0").alias("x0"), F.col("m1").alias("x1"), "problem")


#: Orders that share a part are linked; a chain over all lines of a bin of parts.
_LINKS = "select cast(l_suppkey % 7 as bigint) as plan_id, l_partkey as a, l_partkey + 1 + l_linenumber % 2 as b from lineitem where l_quantity > 40"


@query(
    f"with recursive l as (select distinct * from ({_LINKS})), e as (select * from l union select plan_id, b, a from l), n as (select distinct plan_id, a as node from e), "
    "walk as (select plan_id, a as node, least(a, b) as root from e union select w.plan_id, e.b, w.root from walk w join e on e.plan_id = w.plan_id and e.a = w.node) select plan_id, node, min(root) as root from walk group by plan_id, node"
)
def h08_connected(spark, sf_dir):
    return groups.connected(fx.view(spark, sf_dir, _LINKS))
