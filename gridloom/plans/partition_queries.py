"""Queries of masks cut into disjoint rectangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import partition, raster
from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query
from gridloom.session import stored

_GRIDS = "select p_partkey as plan_id, cast(1 + p_size % 4 as int) as m, cast(p_partkey % 5 as double) / 5 as share, cast(0.5 as double) as low, cast(2 as double) as high, p_partkey * 31 as seed from part"
_ASKED = "select plan_id, cast(n as bigint) as n from (select p_partkey as plan_id, explode(array(p_size % 4, 6, 2, 2, -1, 3, 300)) as n from part) as a"


def _parts(spark, sf_dir, **how):
    grids = fx.view(spark, sf_dir, _GRIDS)
    return partition.partitions(raster.random_mask(grids), raster.random_sizes(grids), **how)


def _kept(spark, sf_dir, **how):
    """The same as a table, for what reads them twice."""
    return stored(_parts(spark, sf_dir, **how), "partitions")


def _shown(df):
    """Rectangles by their number alone: of equal areas any choice is right."""
    return df.withColumns({"area": F.round("area", 6), "rects": F.size("rects")})


@query()
def x21_partitions(spark, sf_dir):
    return _shown(_parts(spark, sf_dir))


@query()
def x22_solved(spark, sf_dir):
    return _shown(partition.solved(_kept(spark, sf_dir, physical=True), fx.view(spark, sf_dir, _ASKED)))


@query()
def x23_swept(spark, sf_dir):
    return partition.swept(_kept(spark, sf_dir), fx.view(spark, sf_dir, _ASKED))


@query()
def x24_least_number(spark, sf_dir):
    return _shown(partition.least_number(_parts(spark, sf_dir, zeros=False)))
