"""Requests for numbers of zones, solver settings, commands and uploads: parsing and the limits they must keep.

Every check gives a row's first problem as a short text instead of an error, so one bad request never stops a job; `strict`
turns problems into an error where a caller wants one.

Defined results. A null request, or one that is no number, list or range, has the problem `kind`. Rows are independent:
repeated ones give repeated results, an empty table gives none, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = "struct<start: bigint, stop: bigint, coarse_step: bigint>"


def default_step(start: Column, stop: Column) -> Column:
    """A tenth of the range, rounded half to even, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.bround((stop - start + 1) / 10).cast("long"))


def normalised(requests: DataFrame) -> DataFrame:
    """Requests (task_id, request as JSON) as task_id, mode, asked (numbers as given), ns (distinct, in order), start, stop, step,
    problem. Numbers must be whole and not negative, lists not empty, ranges not turned round, steps at least 1."""
    text = F.trim("request")
    mode = F.when(text.rlike(r"^-?[0-9]+$"), "single").when(text.startswith("["), "list").when(text.startswith("{"), "range")
    rows = requests.select("task_id", mode.alias("mode"), F.when(mode == "single", F.array(text)).when(mode == "list", F.from_json(text, "array<string>")).alias("raw"), F.when(mode == "range", F.from_json(text, RANGE)).alias("r"))
    rows = rows.withColumn("asked", F.transform("raw", lambda x: x.try_cast("double")))
    odd = F.exists("asked", lambda x: x.isNull() | (x < 0) | (x != F.floor(x)))
    turned = F.col("r.start").isNull() | F.col("r.stop").isNull() | (F.col("r.start") < 0) | (F.col("r.stop") < F.col("r.start")) | F.coalesce(F.col("r.coarse_step") < 1, F.lit(False))
    problem = (
        F.when(F.col("mode").isNull(), "kind").when((F.col("mode") == "range") & turned, "range").when((F.col("mode") != "range") & F.col("asked").isNull(), "kind")
        .when((F.col("mode") != "range") & (F.size("asked") == 0), "empty").when((F.col("mode") != "range") & odd, "number")
    )
    rows = rows.withColumn("problem", problem)
    good = lambda c: F.when(F.col("problem").isNull(), c)
    step = F.coalesce("r.coarse_step", default_step(F.col("r.start"), F.col("r.stop")))
    return rows.select("task_id", "mode", good(F.transform("asked", lambda x: x.cast("long"))).alias("asked"), good(F.array_distinct(F.transform("asked", lambda x: x.cast("long")))).alias("ns"), good(F.col("r.start")).alias("start"), good(F.col("r.stop")).alias("stop"), good(F.when(F.col("r").isNotNull(), step)).alias("step"), "problem")


def within_limits(requests: DataFrame, max_values: int, max_n: int) -> DataFrame:
    """The rows of normalised() with the problem `count` (too many numbers asked) or `high` (a number above max_n)."""
    count = F.when(F.col("mode") == "range", F.col("stop") - F.col("start") + 1).otherwise(F.size("asked"))
    high = F.when(F.col("mode") == "range", F.col("stop")).otherwise(F.array_max("asked"))
    return requests.withColumn("problem", F.coalesce("problem", F.when(count > max_values, "count").when(high > max_n, "high")))


def solver_problem(threads: Column, timeout: Column, inner: Column, max_threads: int, max_timeout: float) -> Column:
    """What is wrong with solver settings: too many threads, too long a time, an inner limit above the outer. 1 thread and
    120 seconds where not given."""
    timeout = F.coalesce(timeout, F.lit(120.0))
    return F.when(F.coalesce(threads, F.lit(1)) > max_threads, "threads").when(timeout > max_timeout, "timeout").when(inner > timeout, "inner")


def strict(rows: DataFrame) -> DataFrame:
    """rows, or an error at the first row with a problem."""
    return rows.where(F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("bad request: "), "problem")).cast("boolean")).otherwise(True))


#: The commands of a task's channel.
ACTIONS = ("add", "cancel", "pause_range", "resume_range", "cancel_task", "snapshot")


def commands(raw: DataFrame) -> DataFrame:
    """Commands (task_id, at, command as JSON) as task_id, at, action, ns, problem: an unknown action, or add and cancel without n."""
    one = F.from_json("command", "struct<action: string, n: bigint>")
    many = F.from_json("command", "struct<action: string, n: array<bigint>>")
    rows = raw.select("task_id", "at", F.coalesce(one["action"], many["action"]).alias("action"), F.coalesce(many["n"], F.when(one["n"].isNotNull(), F.array(one["n"]))).alias("ns"))
    problem = F.when(F.coalesce(~F.col("action").isin(*ACTIONS), F.lit(True)), "action").when(F.col("action").isin("add", "cancel") & F.col("ns").isNull(), "n")
    return rows.withColumn("problem", problem)


def paused(cmds: DataFrame) -> DataFrame:
    """Whether each task is paused: its last pause or resume decides."""
    rows = cmds.where("problem is null and action in ('pause_range', 'resume_range')")
    return rows.groupBy("task_id").agg((F.max_by("action", "at") == "pause_range").alias("paused"))


def upload_status(name: Column, size: Column, most: int) -> Column:
    """HTTP status of an upload: 413 above the size limit, then 415 for a name that ends in neither .dxf nor .json."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(size > most, 413).when(~(low.endswith(".dxf") | low.endswith(".json")), 415).otherwise(200)


def axis_name(axis: Column) -> Column:
    """x or y in lower case; null for anything else. The numbers 0 and 1 stand for y and x."""
    low = F.lower(F.trim(axis.cast("string")))
    return F.when(low.isin("x", "y"), low).when(low == "0", "y").when(low == "1", "x")
