"""Job queues as folds over an append-only table of events, and task plans that requests change.

Events are (job_id, queue, seq, kind, at): enqueue, claim, heartbeat, requeue, ack. Nothing is updated in place; a state is what
the last events say. Work spreads by job, queue or task.

Defined results. Jobs that were never enqueued have no place in a queue. Equal times are ordered by job_id. Repeated events
change nothing but by their seq. Null keys form a key of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEASE = 90
#: States that end a number's work, and those that an explicit request tries again.
TERMINAL = ("optimal", "feasible", "infeasible")
RETRIED = ("error", "cancelled", "postprocess_infeasible", "feasible", "incumbent")


def job_states(events: DataFrame, lease: int = LEASE) -> DataFrame:
    """For each job: state (pending, claimed, done), entered (when it last joined its queue), requeued, lease_until, finished_at."""
    is_control = F.col("kind") != "heartbeat"
    rows = events.withColumn("control", F.max(F.when(is_control, F.col("seq"))).over(Window.partitionBy("job_id")))
    joined = F.col("kind").isin("enqueue", "requeue")
    got = rows.groupBy("job_id", "queue").agg(
        F.max_by(F.when(is_control, F.col("kind")), F.when(is_control, F.col("seq"))).alias("last"),
        F.max_by("at", F.when(joined, F.col("seq"))).alias("entered"),
        F.max(F.when(F.col("kind").isin("claim", "heartbeat") & (F.col("seq") >= F.col("control")), F.col("at"))).alias("renewed"),
        F.max_by("at", F.when(F.col("kind") == "ack", F.col("seq"))).alias("acked"),
    )
    state = F.when(F.col("last") == "claim", "claimed").when(F.col("last") == "ack", "done").otherwise("pending")
    return got.select("job_id", "queue", state.alias("state"), "entered", (F.col("last") == "requeue").alias("requeued"), F.when(state == "claimed", F.col("renewed") + lease).alias("lease_until"), F.when(state == "done", F.col("acked")).alias("finished_at"))


def ready_queue(states: DataFrame) -> DataFrame:
    """Pending jobs in the order in which they are claimed: queue, job_id, position, requeued. Who came back stands behind."""
    order = Window.partitionBy("queue").orderBy("entered", "job_id")
    return states.where("state = 'pending'").select("queue", "job_id", F.row_number().over(order).alias("position"), "requeued")


def workload(states: DataFrame) -> DataFrame:
    """Outstanding jobs of each queue: pending and claimed ones."""
    return states.where("state <> 'done'").groupBy("queue").agg(F.count(F.lit(1)).alias("outstanding"))


def claims(ready: DataFrame, workers: int, now: int, lease: int = LEASE) -> DataFrame:
    """The next jobs of each queue for so many idle workers: queue, job_id, worker, lease_until."""
    return ready.where(F.col("position") <= workers).select("queue", "job_id", F.col("position").alias("worker"), F.lit(now + lease).cast("long").alias("lease_until"))


def cancelled_tasks(plan: DataFrame, statuses: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every number of the tasks' plans that is not finished, as cancelled."""
    done = statuses.where(F.col("status").isin(*TERMINAL)).select("task_id", "n")
    return plan.select("task_id", "n").distinct().join(tasks.select("task_id").distinct(), "task_id", "left_semi").join(done, ["task_id", "n"], "left_anti").withColumn("status", F.lit("cancelled"))


def number_cancelled(numbers: DataFrame, tasks: DataFrame, members: DataFrame) -> DataFrame:
    """numbers (task_id, n) with whether their task (task_id, cancelled) or they themselves are cancelled."""
    own = members.select("task_id", "n").distinct().withColumn("own", F.lit(True))
    got = numbers.join(tasks.select("task_id", "cancelled"), "task_id", "left").join(own, ["task_id", "n"], "left")
    return got.select("task_id", "n", (F.coalesce("cancelled", F.lit(False)) | F.coalesce("own", F.lit(False))).alias("cancelled"))


def added(plan: DataFrame, statuses: DataFrame, wanted: DataFrame, limits: DataFrame) -> DataFrame:
    """What requests for numbers (task_id, k, n) append to plans (task_id, pos, n): task_id, pos, n, retry, problem.

    New numbers join at their first mention; those with a status that is tried again join at every mention. A task with a
    number below 0 or above its max_n, or that would hold more than max_values, gets one row that tells the problem."""
    planned = plan.select("task_id", "n").distinct().withColumn("planned", F.lit(True))
    ends = plan.groupBy("task_id").agg(F.max("pos").alias("last"), F.count(F.lit(1)).alias("size"))
    first = F.row_number().over(Window.partitionBy("task_id", "n").orderBy("k")) == 1
    rows = wanted.withColumn("first", first).join(planned, ["task_id", "n"], "left").join(statuses.select("task_id", "n", "status"), ["task_id", "n"], "left")
    again = F.coalesce(F.col("status").isin(*RETRIED), F.lit(False)) & (F.col("planned").isNotNull() | ~F.col("first"))
    new = F.col("planned").isNull() & F.col("first")
    rows = rows.withColumns({"again": again, "new": new}).join(ends, "task_id", "left").join(limits, "task_id", "left")
    per = Window.partitionBy("task_id")
    grown = F.coalesce("size", F.lit(0)) + F.sum(F.col("new").cast("int")).over(per)
    bad = F.when(F.col("n") < 0, "negative").when(F.col("n") > F.col("max_n"), "high")
    first_bad = F.min(F.when(bad.isNotNull(), F.struct("k", bad.alias("p")))).over(per)["p"]
    rows = rows.withColumn("problem", F.when(grown > F.col("max_values"), "count").otherwise(first_bad))
    good = rows.where("problem is null and (new or again)")
    pos = F.coalesce("last", F.lit(-1)) + F.row_number().over(per.orderBy("k"))
    out = good.select("task_id", pos.cast("long").alias("pos"), "n", "again", F.lit(None).cast("string").alias("problem"))
    told = rows.where("problem is not null").groupBy("task_id").agg(F.first("problem").alias("problem"))
    return out.unionByName(told, allowMissingColumns=True).withColumnRenamed("again", "retry")


def created(tasks: DataFrame, existing: DataFrame) -> DataFrame:
    """Which requests (task_id, arrival) make a task: the first of each id that is not there yet."""
    first = F.row_number().over(Window.partitionBy("task_id").orderBy("arrival")) == 1
    known = existing.select("task_id").distinct().withColumn("known", F.lit(True))
    rows = tasks.withColumn("first", first).join(known, "task_id", "left")
    return rows.select("task_id", "arrival", (F.col("first") & F.col("known").isNull()).alias("created"))


def patched(changes: DataFrame) -> DataFrame:
    """The last value of each key of each task: changes are (task_id, key, value, at)."""
    return changes.groupBy("task_id", "key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("updated_at"))
