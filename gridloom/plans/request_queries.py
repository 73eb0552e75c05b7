"""Queries of requests, limits, commands and job queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import jobs, requests
from gridloom.plans import fixtures as fx
from gridloom.plans.catalog import query

#: A request of each kind, four of them bad.
REQUESTS = """select p_partkey as task_id, p_size, case p_partkey % 8 when 0 then cast(p_size as string) when 1 then concat('[', p_size, ',', p_partkey % 7, ',', p_size, ']')
 when 2 then concat('{"start":', p_size, ',"stop":', p_size + p_partkey % 55, '}') when 3 then concat('{"start":', p_size, ',"stop":', p_size + 20, ',"coarse_step":', 1 + p_partkey % 6, '}')
 when 4 then '[]' when 5 then concat('[', p_size, ',-1]') when 6 then '{"start":9,"stop":3}' else 'true' end as request from part"""
_STEP = "case when k = 3 then 1 + task_id % 6 when k = 2 then greatest(1, cast(round_even((task_id % 55 + 1) / 10.0, 0) as bigint)) end"
_R = f"with r as (select *, task_id % 8 as k from ({REQUESTS}))"
_PROBLEM = "case k when 4 then 'empty' when 5 then 'number' when 6 then 'range' when 7 then 'kind' end"
_MODE = "case when k = 0 then 'single' when k in (1, 4, 5) then 'list' when k in (2, 3, 6) then 'range' end"
_NS = "case k when 0 then cast(p_size as varchar) when 1 then concat(p_size, case when task_id % 7 <> p_size then ',' || task_id % 7 else '' end) end"


def _requests(spark, sf_dir):
    return requests.normalised(fx.view(spark, sf_dir, REQUESTS))


@query(f"{_R} select task_id, {_MODE} as mode, {_NS} as ns, case when k in (2, 3) then cast(p_size as bigint) end as start, case k when 2 then p_size + task_id % 55 when 3 then p_size + 20 end as stop, {_STEP} as step, {_PROBLEM} as problem from r")
def t23_requests(spark, sf_dir):
    return _requests(spark, sf_dir).select("task_id", "mode", F.array_join("ns", ",").alias("ns"), "start", "stop", "step", "problem")


@query(
    f"{_R}, c as (select *, case k when 0 then 1 when 1 then 3 when 2 then task_id % 55 + 1 when 3 then 21 end as n, case k when 0 then p_size when 1 then greatest(p_size, task_id % 7) when 2 then p_size + task_id % 55 when 3 then p_size + 20 end as high from r) "
    f"select task_id, coalesce({_PROBLEM}, case when n > 30 then 'count' when high > 60 then 'high' end) as problem from c"
)
def t25_request_limits(spark, sf_dir):
    return requests.within_limits(_requests(spark, sf_dir), 30, 60).select("task_id", "problem")


_SOLVER = "select o_orderkey as job_id, case when o_orderkey % 5 = 0 then null else o_orderkey % 6 end as threads, case when o_orderkey % 7 = 0 then null else cast(o_custkey % 400 as double) end as timeout, case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 500 as double) end as inner_limit from orders"


@query(f"with s as ({_SOLVER}) select job_id, case when coalesce(threads, 1) > 4 then 'threads' when coalesce(timeout, 120) > 300 then 'timeout' when inner_limit is not null and inner_limit > coalesce(timeout, 120) then 'inner' end as problem from s")
def t26_solver_limits(spark, sf_dir):
    s = fx.view(spark, sf_dir, _SOLVER)
    return s.select("job_id", requests.solver_problem(F.col("threads"), F.col("timeout"), F.col("inner_limit"), 4, 300.0).alias("problem"))


_COMMANDS = """select user_id % 200 as task_id, event_id as at, case event_id % 8 when 0 then concat('{"action":"add","n":', event_id % 90, '}') when 1 then concat('{"action":"cancel","n":[', event_id % 90, ',', event_id % 11, ']}')
 when 2 then '{"action":"pause_range"}' when 3 then '{"action":"resume_range"}' when 4 then '{"action":"cancel_task"}' when 5 then '{"action":"snapshot"}' when 6 then '{"action":"add"}' else '{"action":"stop","n":1}' end as command from events"""


@query(f"""with c as ({_COMMANDS}) select task_id, "at", ['add','cancel','pause_range','resume_range','cancel_task','snapshot','add','stop'][1 + "at" % 8] as action, case "at" % 8 when 0 then cast("at" % 90 as varchar) when 1 then concat("at" % 90, ',', "at" % 11) when 7 then '1' end as ns, case "at" % 8 when 6 then 'n' when 7 then 'action' end as problem from c""")
def h39_commands(spark, sf_dir):
    return requests.commands(fx.view(spark, sf_dir, _COMMANDS)).select("task_id", "at", "action", F.array_join("ns", ",").alias("ns"), "problem")


@query(f"""with c as ({_COMMANDS}) select task_id, arg_max("at" % 8 = 2, "at") as paused from c where "at" % 8 in (2, 3) group by task_id""")
def t33_paused(spark, sf_dir):
    return requests.paused(requests.commands(fx.view(spark, sf_dir, _COMMANDS)))


@query("select p_partkey as id, case when p_size > 40 then 413 when p_partkey % 4 >= 2 then 415 else 200 end as status from part")
def h38_uploads(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.get(F.array(F.lit("Plan.DXF"), F.lit("loads.json"), F.lit("dxf"), F.lit(None)), (F.col("p_partkey") % 4).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), requests.upload_status(name, F.col("p_size"), 40).alias("status"))


@query("select p_partkey as id, case p_partkey % 7 when 0 then 'x' when 1 then 'y' when 2 then 'y' when 3 then 'x' when 4 then 'x' end as axis from part")
def g16_axis(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = F.get(F.array(F.lit("X"), F.lit(" y"), F.lit("0"), F.lit("1"), F.lit("x"), F.lit("z"), F.lit(None)), (F.col("p_partkey") % 7).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), requests.axis_name(raw).alias("axis"))


#: A life of events for each order: an enqueue first, then what its lines say.
JOB_EVENTS = """select job_id, job_id % 10 as queue, seq, case when seq = 1 then 'enqueue' when l_partkey % 4 = 0 then 'claim' when l_partkey % 4 = 1 then 'heartbeat' when l_partkey % 4 = 2 then 'requeue' else 'ack' end as kind, cast(job_id * 7 % 1000 + seq * 10 as bigint) as at
 from (select l_orderkey as job_id, l_partkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as seq from lineitem) as s"""
_J = f"""with e as ({JOB_EVENTS}), c as (select *, max(case when kind <> 'heartbeat' then seq end) over (partition by job_id) as control from e),
s as (select job_id, queue, max(case when seq = control then kind end) as last, arg_max("at", seq) filter (kind in ('enqueue', 'requeue')) as entered, max("at") filter (kind in ('claim', 'heartbeat') and seq >= control) as renewed, arg_max("at", seq) filter (kind = 'ack') as acked from c group by job_id, queue),
q as (select queue, job_id, row_number() over (partition by queue order by entered, job_id) as position, last = 'requeue' as requeued from s where last in ('enqueue', 'requeue'))"""


def _states(spark, sf_dir):
    return jobs.job_states(fx.view(spark, sf_dir, JOB_EVENTS))


@query(f"{_J} select queue, job_id, position from q")
def t14_ready_queue(spark, sf_dir):
    return jobs.ready_queue(_states(spark, sf_dir)).drop("requeued")


@query(f"{_J} select queue, count(*) as outstanding from s where last <> 'ack' group by queue")
def t14_workload(spark, sf_dir):
    return jobs.workload(_states(spark, sf_dir))


@query(f"{_J} select queue, job_id, position as worker, cast(5090 as bigint) as lease_until from q where position <= 3")
def t15_claims(spark, sf_dir):
    return jobs.claims(jobs.ready_queue(_states(spark, sf_dir)), 3, 5000)


@query(f"{_J} select job_id, renewed + 90 as lease_until from s where last = 'claim'")
def h29_leases(spark, sf_dir):
    return _states(spark, sf_dir).where("state = 'claimed'").select("job_id", "lease_until")


@query(f"{_J} select job_id, acked as finished_at from s where last = 'ack'")
def h30_finished(spark, sf_dir):
    return _states(spark, sf_dir).where("state = 'done'").select("job_id", "finished_at")


@query(f"{_J} select queue, job_id, position from q where requeued")
def h31_requeued(spark, sf_dir):
    return jobs.ready_queue(_states(spark, sf_dir)).where("requeued").drop("requeued")


PLAN = "select task_id, n, cast(row_number() over (partition by task_id order by (n * 37) % 61, n) - 1 as bigint) as pos from (select distinct cast(l_orderkey % 40 as bigint) as task_id, cast(l_partkey % 60 as bigint) as n from lineitem) as p"
STATUSES = """select task_id, n, status from (select cast(o_custkey % 40 as bigint) as task_id, cast(o_orderkey % 80 as bigint) as n, case o_orderkey % 9 when 0 then 'queued' when 1 then 'running' when 2 then 'optimal' when 3 then 'feasible' when 4 then 'infeasible' when 5 then 'cancelled'
 when 6 then 'error' when 7 then 'incumbent' else 'postprocess_infeasible' end as status, row_number() over (partition by o_custkey % 40, o_orderkey % 80 order by o_orderkey desc) as r from orders) as s where r = 1"""
_P = f"with p as ({PLAN}), s as ({STATUSES})"


def _plan(spark, sf_dir):
    return fx.view(spark, sf_dir, PLAN), fx.view(spark, sf_dir, STATUSES)


@query(f"{_P} select distinct p.task_id, p.n, 'cancelled' as status from p left join s on s.task_id = p.task_id and s.n = p.n where p.task_id % 3 = 0 and coalesce(s.status, '') not in ('optimal', 'feasible', 'infeasible')")
def t13_cancel_task(spark, sf_dir):
    plan, statuses = _plan(spark, sf_dir)
    return jobs.cancelled_tasks(plan, statuses, plan.where("task_id % 3 = 0").select("task_id"))


@query(f"{_P} select p.task_id, p.n, p.task_id % 7 = 0 or coalesce(s.status = 'cancelled', false) as cancelled from p left join s on s.task_id = p.task_id and s.n = p.n")
def h28_is_cancelled(spark, sf_dir):
    plan, statuses = _plan(spark, sf_dir)
    tasks = plan.select("task_id").distinct().withColumn("cancelled", F.col("task_id") % 7 == 0)
    return jobs.number_cancelled(plan.select("task_id", "n"), tasks, statuses.where("status = 'cancelled'"))


_WANTED = "select cast(user_id % 40 as bigint) as task_id, event_id as k, cast((event_id * 7) % 91 - 1 as bigint) as n from events where event_id % 5 = 0"


@query(
    f"{_P}, w as ({_WANTED}), e as (select task_id, max(pos) as last, count(*) as size from p group by task_id), "
    "a as (select w.*, row_number() over (partition by w.task_id, w.n order by w.k) = 1 as fst, exists (select 1 from p where p.task_id = w.task_id and p.n = w.n) as planned, s.status in ('error', 'cancelled', 'postprocess_infeasible', 'feasible', 'incumbent') as retried from w left join s on s.task_id = w.task_id and s.n = w.n), "
    "b as (select *, not planned and fst as new, coalesce(retried, false) and (planned or not fst) as again, case when n < 0 then 'negative' when n > 70 + task_id % 20 then 'high' end as bad from a), "
    "t as (select task_id, count(*) filter (new) as news, arg_min(bad, k) filter (bad is not null) as bad from b group by task_id), "
    "v as (select t.task_id, case when coalesce(e.size, 0) + news > 75 then 'count' else t.bad end as problem, coalesce(e.last, -1) as last from t left join e using (task_id)) "
    "select v.task_id, v.last + row_number() over (partition by v.task_id order by b.k) as pos, b.n, b.again as retry, cast(null as varchar) as problem from b join v using (task_id) where v.problem is null and (b.new or b.again) "
    "union all select task_id, null, null, null, problem from v where problem is not null"
)
def t18_added(spark, sf_dir):
    plan, statuses = _plan(spark, sf_dir)
    wanted = fx.view(spark, sf_dir, _WANTED)
    limits = wanted.select("task_id").distinct().selectExpr("task_id", "70 + task_id % 20 as max_n", "75 as max_values")
    return jobs.added(plan, statuses, wanted, limits)


@query("select o_custkey as task_id, o_orderkey as arrival, o_custkey % 4 > 0 and row_number() over (partition by o_custkey order by o_orderkey) = 1 as created from orders")
def h32_created(spark, sf_dir):
    tasks = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("arrival"))
    return jobs.created(tasks, tasks.where("task_id % 4 = 0").select("task_id"))


@query("select user_id as task_id, event_type as key, arg_max(event_id * 3, event_id) as value, max(event_id) as updated_at from events group by user_id, event_type")
def h33_patched(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return jobs.patched(e.selectExpr("user_id as task_id", "event_type as key", "event_id * 3 as value", "event_id as at"))
