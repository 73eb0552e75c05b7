"""Queries of jobs, events and incumbents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import state
from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query
from gridloom.streaming import incumbents

_EV, _JOBS, _INC = f"with e as ({fx.SOLVER_EVENTS})", f"with j as ({fx.JOBS})", f"with i as ({fx.INCUMBENTS})"


@query(
    f"{_EV}, b as (select *, min(cost_cents) over (partition by task_id order by event_id rows between unbounded preceding and 1 preceding) as before from e where type = 'incumbent') "
    "select task_id, event_id, cost_cents, row_number() over (partition by task_id order by event_id) as sequence from b where before is null or cost_cents < before"
)
def t02_running_best(spark, sf_dir):
    return state.running_best(fx.view(spark, sf_dir, fx.SOLVER_EVENTS))


@query(f"{_EV} select task_id, event_id, type from e qualify row_number() over (partition by task_id order by type = 'heartbeat', event_id desc) <= 16")
def t03_lossy_queue(spark, sf_dir):
    return state.lossy_queue(fx.view(spark, sf_dir, fx.SOLVER_EVENTS), 16)


@query(f"{_EV} select task_id, event_id, type, cost_cents from e qualify row_number() over (partition by task_id order by event_id desc) <= 50")
def t06_retained_events(spark, sf_dir):
    return state.retained(fx.view(spark, sf_dir, fx.SOLVER_EVENTS), 50).drop("ts")


@query(f"{_EV} select task_id, event_id, type, cost_cents from e where event_id > 100 order by event_id limit 250")
def t07_read_events(spark, sf_dir):
    return state.events_after(fx.view(spark, sf_dir, fx.SOLVER_EVENTS), 100, 250).drop("ts")


@query(f"{_EV} select task_id, arg_max(type, event_id) as type, max(event_id) as event_id from e group by task_id")
def t08_status_upsert(spark, sf_dir):
    return state.last_status(fx.view(spark, sf_dir, fx.SOLVER_EVENTS))


@query(
    f"{_INC}, r as (select plan_id, n, cost_cents, entry_id, case when entry_id % 5 > 0 and entry_id % 3 = 0 then 0 when entry_id % 5 > 0 then 1 else 2 end as tier, not_optimal, case when entry_id % 2 = 0 then 0 else 1 end as not_final from i) "
    "select plan_id, n, k.tier as tier, k.not_optimal as not_optimal, k.cost_cents as cost_cents, k.entry_id as entry_id from (select plan_id, n, min({'tier': tier, 'not_optimal': not_optimal, 'cost_cents': cost_cents, 'not_final': not_final, 'entry_id': entry_id}) as k from r group by plan_id, n)"
)
def t10_best_result(spark, sf_dir):
    i = fx.view(spark, sf_dir, fx.INCUMBENTS)
    return state.best_results(i.withColumns({"feasible": F.expr("entry_id % 5 > 0"), "processed": F.expr("entry_id % 3 = 0"), "optimal": F.expr("not_optimal = 0"), "final": F.expr("entry_id % 2 = 0")}))


@query(f"{_INC} select plan_id, n, k.o as not_optimal, k.c as cost_cents, k.e as entry_id from (select plan_id, n, min({{'o': not_optimal, 'c': cost_cents, 'e': entry_id}}) as k from i group by plan_id, n)")
def t11_merge(spark, sf_dir):
    return state.merged_incumbents(fx.view(spark, sf_dir, fx.INCUMBENTS))


@query(f"{_INC} select distinct plan_id, n + 2 as n from i where (plan_id, n + 2) not in (select plan_id, n from i)")
def t11_infeasible(spark, sf_dir):
    i = fx.view(spark, sf_dir, fx.INCUMBENTS)
    return state.infeasible_left(i.select("plan_id", (F.col("n") + 2).alias("n")), i.select("plan_id", "n"))


@query(f"{_JOBS} select job_id, task_id, 'cancelled' as state from j where job_id % 7 = 0 and state <> 'done'")
def t12_cancel(spark, sf_dir):
    jobs = fx.view(spark, sf_dir, fx.JOBS)
    return state.cancelled(jobs, jobs.where("job_id % 7 = 0").select("job_id"))


@query(f"{_JOBS} select task_id, job_id, row_number() over (partition by task_id order by created_at, job_id) as place from j where state = 'claimed' and (lease_age_s is null or lease_age_s >= 90) and claim_age_s >= 100")
def t16_stale(spark, sf_dir):
    return state.stale_jobs(fx.view(spark, sf_dir, fx.JOBS))


@query(f"{_JOBS}, s as (select task_id, job_id, row_number() over (partition by task_id order by created_at, job_id) as slot from j where state = 'claimed' and lease_age_s < 90) select * from s where slot <= 4")
def t17_slots(spark, sf_dir):
    return state.slots(fx.view(spark, sf_dir, fx.JOBS), 4)


@query(
    f"{_JOBS}, a as (select task_id, count(*) as active from j where state = 'claimed' group by task_id), p as (select task_id, job_id, row_number() over (partition by task_id order by job_id) as rank from j where state = 'pending') "
    "select p.task_id, p.job_id, p.rank from p left join a on a.task_id = p.task_id where rank <= 140 - coalesce(active, 0)"
)
def t19_refill(spark, sf_dir):
    return state.refilled(fx.view(spark, sf_dir, fx.JOBS), 140)


#: Tasks of some orders each, and the statuses of their numbers.
_TASKS = (
    "select distinct cast(floor(o_orderkey / 20) as bigint) as task_id, floor(o_orderkey / 20) % 11 = 0 as cancelled, case floor(o_orderkey / 20) % 13 when 0 then 'failed' when 1 then 'preparing' when 2 then 'queued_preparation' else 'ready' end as state, "
    "case floor(o_orderkey / 20) % 3 when 0 then true when 1 then false end as paused, floor(o_orderkey / 20) % 2 = 0 as exhausted from orders"
)
_STATUSES = "select cast(floor(o_orderkey / 20) as bigint) as task_id, case o_custkey % 37 when 0 then 'queued' when 1 then 'running' when 2 then 'incumbent' when 3 then 'error' when 4 then 'postprocess_infeasible' when 5 then null else 'completed' end as status from orders where o_orderkey % 40 > 1"


@query(
    f"with t as ({_TASKS}), s as ({_STATUSES}), b as (select task_id, count(*) filter (status in ('queued', 'running', 'incumbent')) as busy, count(*) filter (status in ('error', 'postprocess_infeasible')) as errors from s group by task_id) select task_id, case when cancelled then 'cancelled' when state <> 'ready' then state "
    "when busy > 0 then 'running' when paused then 'paused' when exhausted and errors > 0 then 'completed_with_errors' when exhausted then 'completed' else 'ready' end as state from t left join b using (task_id)"
)
def t20_state(spark, sf_dir):
    return state.task_states(fx.view(spark, sf_dir, _STATUSES), fx.view(spark, sf_dir, _TASKS))


@query(f"{_JOBS} select task_id, count(*) filter (state = 'pending') as pending, count(*) filter (state = 'claimed') as claimed, count(*) filter (state = 'done') as done from j group by task_id")
def t21_snapshot(spark, sf_dir):
    return state.snapshot(fx.view(spark, sf_dir, fx.JOBS))


@query(
    part="with recursive q as (select p_partkey as task_id, p_size as start, p_size + 20 + p_partkey % 80 as stop, 3 + p_partkey % 8 as step from part where p_partkey < 100), "
    "seeds as (select distinct task_id, start, n from (select task_id, start, step, stop, unnest(generate_series(start, stop)) as n from q) where n % step = 0 or n = stop), "
    "gaps as (select task_id, coalesce(lag(n) over (partition by task_id order by n), start - 1) as l, n as r from seeds), "
    "tree as (select task_id, l, r, 1 as depth from gaps union all select task_id, case when side = 0 then l else (l + r) // 2 end, case when side = 0 then (l + r) // 2 else r end, depth + 1 from tree cross join (values (0), (1)) as s(side) where r - l > 1), "
    "found as (select task_id, 0 as depth, n from seeds union all select task_id, depth, (l + r) // 2 from tree where r - l > 1) "
    "select task_id, row_number() over (partition by task_id order by depth, n) - 1 as pos, n from (select task_id, n, min(depth) as depth from found group by task_id, n)"
)
def t22_order(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return state.planned_order(parts.selectExpr("p_partkey as task_id", "cast(p_size as bigint) as start", "p_size + 20 + p_partkey % 80 as stop", "3 + p_partkey % 8 as step"))


@query("with s as (select o_orderkey as job_id, floor(o_totalprice / 1000) as t from orders) select job_id, round(greatest(1e-4, t - least(5.0, greatest(0.001, 0.05 * t))), 4) as soft from s")
def j15_soft_limit(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("job_id"), F.round(state.soft_limit(F.floor(F.col("o_totalprice") / 1000).cast("double")), 4).alias("soft"))


@query(
    f"{_INC}, b as (select plan_id, n, arg_min(cost_cents, not_optimal * 1000000000000 + cost_cents) as cost_cents from i where n in (1, 3, 6) group by plan_id, n), t as (select distinct plan_id, m as n from i cross join (select unnest(generate_series(1, 8)) as m)) "
    "select t.plan_id, t.n, max(b.n) as source_n, arg_max(b.cost_cents, b.n) as cost_cents from t left join b on b.plan_id = t.plan_id and b.n <= t.n group by t.plan_id, t.n"
)
def j11_warm_start(spark, sf_dir):
    i = fx.view(spark, sf_dir, fx.INCUMBENTS)
    targets = i.select("plan_id").distinct().withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    return state.warm_starts(targets, state.merged_incumbents(i.where("n in (1, 3, 6)")))


_FOUND = f"select plan_id, n, min(cost_cents) / 1e10 as cost, plan_id % 4 > 0 as feasible, plan_id % 4 = 1 as optimal, plan_id % 8 = 0 as infeasible from ({fx.INCUMBENTS}) as i where entry_id % 2 = 0 group by plan_id, n"
_KNOWN = f"select plan_id, n, case when plan_id % 3 > 0 then min(cost_cents) / 1e10 else max(cost_cents) / 1e10 end as cost from ({fx.INCUMBENTS}) as i where entry_id % 2 = 1 and n < 6 group by plan_id, n"


@query(
    f"with f as ({_FOUND}), k as ({_KNOWN}), m as (select f.*, k.cost as known, k.plan_id is not null as has, k.plan_id is not null and not infeasible and (not feasible or coalesce(k.cost < f.cost - 1e-9 * greatest(1, f.cost, k.cost), false)) as better from f left join k on k.plan_id = f.plan_id and k.n = f.n) "
    "select plan_id, n, case when better then known when feasible then cost end as cost, better as from_known, case when better then case when optimal then 'optimality_conflict' else 'cheaper' end end as reason, case when has and infeasible then 'contradiction' end as problem from m"
)
def j14_prefer_known(spark, sf_dir):
    double = lambda df: df.withColumn("cost", F.col("cost").cast("double"))
    return state.known_or_found(double(fx.view(spark, sf_dir, _FOUND)), double(fx.view(spark, sf_dir, _KNOWN)))


@query(
    "with r as (select o_orderkey as job_id, o_orderkey % 3 > 0 as feasible, o_orderkey % 6 = 1 as optimal, o_orderkey % 9 = 0 as infeasible, o_totalprice / 5000 as elapsed, 60.0 as time_limit from orders) "
    "select job_id, case when optimal and feasible then 'optimal' when infeasible and not feasible then 'infeasible' when elapsed >= 0.9 * time_limit - 0.05 then 'time_limit' when feasible then 'solver_stopped' else 'no_solution' end as status from r"
)
def x17_termination(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as job_id", "o_orderkey % 3 > 0 as feasible", "o_orderkey % 6 = 1 as optimal", "o_orderkey % 9 = 0 as infeasible", "o_totalprice / 5000 as elapsed", "60.0D as time_limit")
    return state.termination(rows).select("job_id", "status")


#: For Spark alone: times without a zone are taken as UTC, as DuckDB does, whatever the session's zone.
_TIMED = f"select task_id, event_id, type, cast(convert_timezone('UTC', current_timezone(), ts) as timestamp) as ts, cost_cents / 100.0d as cost from ({fx.SOLVER_EVENTS})"
_INTERVAL_HOURS = 48


@query(
    f"""with recursive e as (select task_id, event_id, ts, cost_cents / 100.0::double as cost, min(cost_cents) over (partition by task_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before, cost_cents from ({fx.SOLVER_EVENTS}) where type = 'incumbent'),
    i as (select task_id, event_id, ts, cost, row_number() over (partition by task_id order by ts, event_id) as sequence from e where before is null or cost_cents < before),
    r as (
      select task_id, sequence, ts as emitted_at from i where sequence = 1
      union all select r.task_id, greatest(n.sequence, (select max(m.sequence) from i m where m.task_id = r.task_id and m.ts <= r.emitted_at + interval {_INTERVAL_HOURS} hour)), greatest(n.ts, r.emitted_at + interval {_INTERVAL_HOURS} hour)
      from r join i n on n.task_id = r.task_id and n.sequence = r.sequence + 1)
    select i.task_id, i.event_id, i.cost, cast(i.sequence as int) as sequence, epoch_us(r.emitted_at) as emitted_us from r join i on i.task_id = r.task_id and i.sequence = r.sequence"""
)
def t02_emitted(spark, sf_dir):
    told = incumbents.emitted(fx.view(spark, sf_dir, _TIMED), _INTERVAL_HOURS * 3_600_000)
    return told.select("task_id", "event_id", "cost", "sequence", F.unix_micros("emitted_at").alias("emitted_us"))
