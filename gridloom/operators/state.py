"""Jobs, events and incumbents as tables: keyed minima, queues, windows of work and task states.

All steps are keyed by task or plan; minima and counts combine before they are shuffled, rankings stay inside a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import spread


def running_best(events: DataFrame) -> DataFrame:
    """Incumbent events that are cheaper than every one before them in their task, numbered."""
    order = Window.partitionBy("task_id").orderBy("event_id")
    rows = events.where("type = 'incumbent'").withColumn("before", F.min("cost_cents").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where("before is null or cost_cents < before")
    return rows.select("task_id", "event_id", "cost_cents", F.row_number().over(order).alias("sequence"))


def lossy_queue(events: DataFrame, room: int) -> DataFrame:
    """What a queue of bounded room holds at the end: heartbeats go first, then the oldest."""
    order = Window.partitionBy("task_id").orderBy((F.col("type") == "heartbeat").cast("int"), F.col("event_id").desc())
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= room).select("task_id", "event_id", "type")


def retained(events: DataFrame, most: int) -> DataFrame:
    """The newest events of each task."""
    order = Window.partitionBy("task_id").orderBy(F.col("event_id").desc())
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def events_after(events: DataFrame, after: int, count: int) -> DataFrame:
    """The next events by id, 1000 at most at once."""
    return events.where(F.col("event_id") > after).orderBy("event_id").limit(min(max(count, 1), 1000))


def last_status(events: DataFrame) -> DataFrame:
    """The last type written for each task."""
    return events.groupBy("task_id").agg(F.max_by("type", "event_id").alias("type"), F.max("event_id").alias("event_id"))


def rank_of(feasible: Column, processed: Column, optimal: Column, cost: Column, final: Column) -> Column:
    """Order of results: feasible and processed, feasible, others; then optimal, cheap, final."""
    tier = F.when(feasible & processed, 0).when(feasible, 1).otherwise(2)
    return F.struct(tier.alias("tier"), (~optimal).cast("int").alias("not_optimal"), cost.alias("cost"), (~final).cast("int").alias("not_final"))


def best_results(results: DataFrame) -> DataFrame:
    """For each plan and n the best result, the first of equals by arrival."""
    key = F.struct(rank_of(F.col("feasible"), F.col("processed"), F.col("optimal"), F.col("cost_cents"), F.col("final")).alias("r"), F.col("entry_id"), F.col("final"))
    best = results.groupBy("plan_id", "n").agg(F.min(key).alias("k"))
    return best.select("plan_id", "n", "k.r.tier", "k.r.not_optimal", F.col("k.r.cost").alias("cost_cents"), "k.entry_id")


def merged_incumbents(rows: DataFrame) -> DataFrame:
    """For each plan and n the entry that is optimal before it is cheap, the first of equals."""
    best = rows.groupBy("plan_id", "n").agg(F.min(F.struct("not_optimal", "cost_cents", "entry_id")).alias("k"))
    return best.select("plan_id", "n", "k.not_optimal", "k.cost_cents", "k.entry_id")


def infeasible_left(infeasible: DataFrame, solved: DataFrame) -> DataFrame:
    """Pairs (plan_id, n) told infeasible that no solution contradicts."""
    return infeasible.select("plan_id", "n").distinct().join(solved, ["plan_id", "n"], "left_anti")


def warm_starts(targets: DataFrame, best: DataFrame) -> DataFrame:
    """For each target (plan_id, n) the solution with the largest number of zones that is not above it."""
    b = best.select(F.col("plan_id").alias("p"), F.col("n").alias("source_n"), "cost_cents")
    met = targets.join(b, (F.col("plan_id") == F.col("p")) & (F.col("source_n") <= F.col("n")), "left")
    return met.groupBy("plan_id", "n").agg(F.max("source_n").alias("source_n"), F.max_by("cost_cents", "source_n").alias("cost_cents"))


def known_or_found(found: DataFrame, known: DataFrame) -> DataFrame:
    """The found result (plan_id, n, cost, feasible, optimal, infeasible) of each plan and n, or the known one (plan_id, n, cost)
    where nothing was found or the known one is cheaper by more than a billionth of the larger cost, or of 1: plan_id, n,
    cost, from_known, reason (null, optimality_conflict or cheaper), problem (`contradiction` where a proof that there is
    none meets a known one)."""
    k = known.select("plan_id", "n", F.col("cost").alias("known"), F.lit(True).alias("has"))
    rows, has = found.join(k, ["plan_id", "n"], "left"), F.coalesce("has", F.lit(False))
    slack = 1e-9 * F.greatest(F.lit(1.0), F.abs("cost"), F.abs("known"))
    cheaper = F.coalesce(F.col("known") < F.col("cost") - slack, F.lit(False))
    better = has & ~F.col("infeasible") & (~F.col("feasible") | cheaper)
    reason = F.when(better, F.when(F.col("optimal"), "optimality_conflict").otherwise("cheaper"))
    own = F.when(F.col("feasible"), F.col("cost"))
    problem = F.when(has & F.col("infeasible"), "contradiction")
    return rows.select("plan_id", "n", F.when(better, F.col("known")).otherwise(own).alias("cost"), better.alias("from_known"), reason.alias("reason"), problem.alias("problem"))


def soft_limit(seconds: Column) -> Column:
    """The solver's own limit below a hard one."""
    return F.greatest(F.lit(1e-4), seconds - F.least(F.lit(5.0), F.greatest(F.lit(0.001), 0.05 * seconds)))


def stale_jobs(jobs: DataFrame, lease: int = 90, grace: int = 10) -> DataFrame:
    """Claimed jobs whose lease is gone (no lease_age_s, or one above the lease) and whose claim is as old as lease and grace, in
    the order in which they go to the front."""
    gone = f"state = 'claimed' and (lease_age_s is null or lease_age_s >= {lease}) and claim_age_s >= {lease + grace}"
    return jobs.where(gone).select("task_id", "job_id", F.row_number().over(Window.partitionBy("task_id").orderBy("created_at", "job_id")).alias("place"))


def slots(jobs: DataFrame, limit: int, lease: int = 90) -> DataFrame:
    """Jobs that hold one of a task's slots: live leases, the youngest claims last."""
    live = jobs.where(f"state = 'claimed' and lease_age_s < {lease}")
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("created_at", "job_id"))
    return live.select("task_id", "job_id", rank.alias("slot")).where(F.col("slot") <= limit)


def refilled(jobs: DataFrame, window: int) -> DataFrame:
    """Pending jobs that a task queues now, so that active ones fill its window."""
    active = jobs.where("state = 'claimed'").groupBy("task_id").agg(F.count(F.lit(1)).alias("active"))
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("job_id"))
    rows = jobs.where("state = 'pending'").select("task_id", "job_id", rank.alias("rank")).join(active, "task_id", "left")
    return rows.where(F.col("rank") <= window - F.coalesce("active", F.lit(0))).select("task_id", "job_id", "rank")


def cancelled(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs of wanted (job_id) that are not done and so become cancelled."""
    return wanted.join(jobs, "job_id").where("state <> 'done'").select("job_id", "task_id", F.lit("cancelled").alias("state"))


def task_states(statuses: DataFrame, tasks: DataFrame) -> DataFrame:
    """The state of each task (task_id, state, cancelled, paused, exhausted) from what it is and its numbers' statuses
    (task_id, status): null flags are false, a task without numbers has none that is busy or failed."""
    has = lambda *names: F.bool_or(F.col("status").isin(*names))
    seen = statuses.groupBy("task_id").agg(has("queued", "running", "incumbent").alias("busy"), has("error", "postprocess_infeasible").alias("errors"))
    ended = F.when(F.col("errors"), "completed_with_errors").otherwise("completed")
    state = (
        F.when(F.col("cancelled"), "cancelled").when(F.col("state").isin("failed", "queued_preparation", "preparing"), F.col("state")).when(F.col("busy"), "running")
        .when(F.col("paused"), "paused").when(F.col("exhausted"), ended).otherwise("ready")
    )
    return tasks.join(seen, "task_id", "left").select("task_id", state.alias("state"))


def snapshot(jobs: DataFrame) -> DataFrame:
    """How many jobs of each state a task has."""
    count = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return jobs.groupBy("task_id").agg(count("pending"), count("claimed"), count("done"))


def termination(rows: DataFrame) -> DataFrame:
    """status of (feasible, optimal, infeasible, elapsed, time_limit): near the limit is 0.9 of it less 50 ms."""
    near = F.col("elapsed") >= 0.9 * F.col("time_limit") - 0.05
    status = F.when(F.col("optimal") & F.col("feasible"), "optimal").when(F.col("infeasible") & ~F.col("feasible"), "infeasible").when(near, "time_limit").when(F.col("feasible"), "solver_stopped").otherwise("no_solution")
    return rows.withColumn("status", status)


def planned_order(requests: DataFrame) -> DataFrame:
    """The order in which each request (task_id, start, stop, step) tries its numbers: multiples of step and the stop,
    then the middles of the gaps, breadth first: task_id, pos, n.

    Each number's depth is how often its gap is halved until it is the middle, so no table of gaps grows by rounds. Requests are
    dealt before they become numbers: a file of few requests is read by one task, and numbers would all be made there."""
    dealt = spread(requests.select("task_id", "start", "stop", "step"), "task_id", each=20_000)
    rows = dealt.select("task_id", "start", "stop", "step", F.explode(F.sequence("start", "stop")).alias("n"))
    low, high = F.expr("greatest(div(n - 1, step) * step, start - 1)"), F.expr("least(div(n + step - 1, step) * step, stop)")
    low = F.when(F.expr("div(n - 1, step) * step >= start"), low).otherwise(F.col("start") - 1)
    gap = F.struct(low.cast("long").alias("l"), high.cast("long").alias("r"), F.lit(0).alias("depth"))

    def halved(s, _):
        middle = F.floor((s["l"] + s["r"]) / 2)
        met = (s["r"] == F.col("n")) | (s["l"] == F.col("n"))
        down = F.when(F.col("n") <= middle, s["l"]).otherwise(middle)
        up = F.when(F.col("n") <= middle, middle).otherwise(s["r"])
        return F.when(met, s).otherwise(F.struct(down.alias("l"), up.alias("r"), (s["depth"] + 1).alias("depth")))

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.col("step") + 1)).cast("int") + 1)
    order = F.row_number().over(Window.partitionBy("task_id").orderBy("depth", "n")) - 1
    return rows.withColumn("depth", F.aggregate(halvings, gap, halved)["depth"]).select("task_id", order.cast("int").alias("pos"), "n")
