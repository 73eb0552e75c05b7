"""Input views derived from the driver's tables, as one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.session import spread, table


def _boxes(per_plan: int, columns: int, rows: int, unit: int, where: str = "") -> str:
    x, y = f"(p_partkey*37 % {columns})*{unit}", f"(p_partkey*53 % {rows})*{unit}"
    return (
        f"select cast(floor(p_partkey/{per_plan}) as bigint) as plan_id, p_partkey as poly_id, cast({x} as bigint) as x0, cast({y} as bigint) as y0, "
        f"cast({x} + (1 + p_partkey % 4)*{unit} as bigint) as x1, cast({y} + (1 + p_partkey % 3)*{unit} as bigint) as y1, cast((p_size % 5)*10 as bigint) as load from part{where}"
    )


BOXES60 = _boxes(60, 40, 32, 250)
BOXES12 = _boxes(12, 12, 10, 500)
DENSE12 = _boxes(12, 5, 4, 500)
#: The first 100 plans of ALL6, for SQL that enumerates tuples; queries read ALL6.
BOXES6 = _boxes(6, 6, 5, 500, " where p_partkey < 600")
ALL6 = _boxes(6, 6, 5, 500)
STOCK = "select stock_id, diameter, step from (values (0,18,300),(1,20,150),(2,20,100),(3,25,150),(4,25,100)) as t(stock_id, diameter, step)"
INCUMBENTS = (
    "select cast(l_orderkey % 50 as bigint) as plan_id, cast(l_linenumber as bigint) as n, case when l_linestatus = 'F' then 0 else 1 end as not_optimal, "
    "cast(round(l_extendedprice*100) as bigint) as cost_cents, l_orderkey as entry_id from lineitem"
)
SOLVER_EVENTS = (
    "select user_id as task_id, event_id, ts, case event_type when 'purchase' then 'incumbent' when 'view' then 'heartbeat' when 'click' then 'n_queued' "
    "when 'signup' then 'n_started' else 'n_error' end as type, cast(round(value*100) as bigint) as cost_cents from events"
)
JOBS = (
    "select o_orderkey as job_id, cast(o_custkey % 40 as bigint) as task_id, case o_orderstatus when 'O' then 'pending' when 'P' then 'claimed' else 'done' end as state, "
    "o_orderdate as created_at, case when o_orderkey % 7 = 0 then cast((date '1998-12-31' - cast(o_orderdate as date)) as bigint) else cast(o_orderkey % 180 as bigint) end as claim_age_s, case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 200 as bigint) end as lease_age_s from orders"
)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the texts above as a DataFrame."""
    for name in ("part", "lineitem", "events", "orders"):
        if f" from {name}" in sql:
            return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f" from {name}", " from {source}"), source=table(spark, sf_dir, name))
    return spark.sql(sql)


def dealt(spark: SparkSession, sf_dir: str, sql: str, each: int | None = None) -> DataFrame:
    """A view dealt by plan: what is made of it by plan is made where its plan is, in all tasks, and does not move again. each:
    how many rows a task gets at most, about."""
    return spread(view(spark, sf_dir, sql), "plan_id", each=each)


#: Parameters that the reference deals with by default.
BACK = (18, 300)
MAX_LAYERS, MIN_WIDTH, ANCHOR_FACTOR, STEEL = 2, 1000, 32, 7850
