"""The chain from boxes to a priced cover model, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import candidates, classes, model, raster
from gridloom.plans import fixtures as fx
from gridloom.session import held, settled


#: How many boxes a task gets at most, about: some hundred times as many candidates are sorted at once.
EACH = 6000


@dataclass
class Cover:
    """Every table of the chain, made when first asked for. Boxes are dealt by plan, and all that is made of them stays where its
    plan is. Those tables that several others build on are kept; candidates and prices are checkpoints, so that no plan repeats
    the chain before them. Queries that read them once take listed and valued, the same rows as they are made."""

    boxes: DataFrame
    stock: DataFrame
    min_width: int = fx.MIN_WIDTH
    factor: int = fx.ANCHOR_FACTOR
    layers_most: int = fx.MAX_LAYERS

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, boxes: str = fx.BOXES12, **how) -> Cover:
        return cls(fx.dealt(spark, sf_dir, boxes, EACH), fx.view(spark, sf_dir, fx.STOCK), **how)

    @cached_property
    def raw(self) -> DataFrame:
        return held(raster.rasterised(self.boxes))

    @cached_property
    def loads(self) -> DataFrame:
        return raster.compacted(self.raw)

    @cached_property
    def x(self) -> DataFrame:
        return held(raster.compact_edges(self.boxes, self.raw, "x"))

    @cached_property
    def y(self) -> DataFrame:
        return held(raster.compact_edges(self.boxes, self.raw, "y"))

    def kept(self) -> Cover:
        """self with loads that Spark keeps, as it does edges, for queries that read them many times."""
        self.loads = held(self.loads)
        return self

    @cached_property
    def catalogue(self) -> tuple[DataFrame, DataFrame]:
        made = classes.build_classes(self.boxes.select("plan_id", "load").distinct(), self.stock, fx.BACK, self.layers_most)
        return made[0].persist(), made[1].persist()

    @cached_property
    def layers(self) -> DataFrame:
        return classes.class_layers(self.catalogue[0])

    @cached_property
    def holds(self) -> DataFrame:
        return classes.class_holds(self.catalogue[0], self.factor)

    @cached_property
    def cells(self) -> DataFrame:
        return held(classes.loads_to_classes(self.loads, self.catalogue[1]))

    @cached_property
    def rectangles(self) -> DataFrame:
        return candidates.all_rectangles(self.cells, self.x, self.y, self.holds, self.min_width)

    @cached_property
    def listed(self) -> DataFrame:
        return candidates.expanded(self.rectangles, self.layers)

    @cached_property
    def candidates(self) -> DataFrame:
        return settled(self.listed)

    @cached_property
    def valued(self) -> DataFrame:
        return model.metrics(self.listed, self.x, self.y, self.catalogue[0], self.holds)

    @cached_property
    def priced(self) -> DataFrame:
        return settled(model.metrics(self.candidates, self.x, self.y, self.catalogue[0], self.holds))

    @cached_property
    def rows(self) -> DataFrame:
        return held(model.cover_rows(self.cells, classes.thresholds(self.layers)))

    @cached_property
    def covers(self) -> DataFrame:
        return model.incidence(self.candidates, self.rows).persist()

    @cached_property
    def bounds(self) -> DataFrame:
        return model.upper_bounds(self.candidates, self.covers)
