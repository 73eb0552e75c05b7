"""Rows of results: defaults for what a solver left out, rows for requests without a solution, and cached results to trust.

Defined results. A null is a value left out. Flags that are null count as false. Texts of reasons are English. Repeated rows stay
repeated, an empty table gives no rows, and columns not named here are carried through by the defaults and left out elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _ended(results: DataFrame) -> DataFrame:
    """results with termination_reason, time_limit_reached and has_incumbent."""
    how = F.when(_is("is_optimal"), "optimal").when(_is("infeasibility_proved"), "infeasible").when(_is("is_feasible"), "solver_stopped").otherwise("no_solution")
    ended = {"termination_reason": F.coalesce("termination_reason", how), "time_limit_reached": _is("time_limit_reached"), "has_incumbent": F.coalesce("has_incumbent", _is("is_feasible"))}
    return results.withColumns(ended)


def with_defaults(results: DataFrame) -> DataFrame:
    """results (is_feasible, is_optimal, infeasibility_proved, cache_hit, termination_reason, time_limit_reached, has_incumbent,
    incumbent_source, incumbent_is_solver_best) with what is null filled in."""
    source = F.coalesce("incumbent_source", F.when(_is("is_feasible") & ~_is("cache_hit"), "solver"))
    best = F.coalesce("incumbent_is_solver_best", F.coalesce(_is("is_feasible") & (F.col("incumbent_source") == "solver"), F.lit(False)))
    return _ended(results).withColumn("incumbent_source", source).withColumn("incumbent_is_solver_best", best)


def with_job_defaults(results: DataFrame, source: str) -> DataFrame:
    """The same for a job, whose column source says where its incumbents come from; also solver_incumbent_recovered."""
    solver = F.coalesce(_is("is_feasible") & (F.col(source) == "solver"), F.lit(False))
    filled = {"solver_incumbent_recovered": F.coalesce("solver_incumbent_recovered", solver), "incumbent_is_solver_best": F.coalesce("incumbent_is_solver_best", solver)}
    return _ended(results).withColumns({"incumbent_source": F.coalesce("incumbent_source", F.when(_is("is_feasible"), F.col(source))), **filled})


def unsolved(asked: DataFrame, status: Column, reason: Column, proved: Column, ended: Column | None = None, late: Column | None = None) -> DataFrame:
    """A result without rectangles for each row of asked (plan_id, n)."""
    none, no = lambda t: F.lit(None).cast(t), F.lit(False)
    proved = F.coalesce(proved, no)
    columns = {
        "total_cost": none("double"), "total_area": none("double"), "total_base_area": none("double"), "n_rectangles": none("long"), "n_requested": F.col("n").cast("long"), "status": status,
        "is_feasible": no, "is_optimal": no, "solver_proved_optimal": no, "infeasibility_proved": proved, "has_incumbent": no, "incumbent_source": none("string"), "reason": reason,
        "termination_reason": F.when(proved, "infeasible").otherwise("no_solution") if ended is None else ended, "time_limit_reached": no if late is None else late,
    }
    return asked.select("plan_id", *(c.alias(k) for k, c in columns.items()))


def timed_out(asked: DataFrame) -> DataFrame:
    """Results of jobs that were stopped at their hard limit before any solution was known."""
    return unsolved(asked, F.lit("HardTimeout"), F.lit("stopped at the hard time limit without an incumbent"), F.lit(False), F.lit("hard_timeout"), F.lit(True))


def known_infeasible(entries: DataFrame) -> DataFrame:
    """Results for numbers proved infeasible before, entries (plan_id, n, reason); an empty reason is none."""
    reason = F.coalesce(F.when(F.col("reason") != "", F.col("reason")), F.lit("proved infeasible before"))
    return unsolved(entries, F.lit("Infeasible"), reason, F.lit(True))


def cached_optimal(entries: DataFrame, checked: DataFrame) -> DataFrame:
    """Those entries (plan_id, n, optimal) that are optimal and still hold by checked (plan_id, n, ok)."""
    return entries.where("optimal").join(checked.where("ok"), ["plan_id", "n"], "left_semi")


def multiplicities(picks: DataFrame, rects: DataFrame) -> DataFrame:
    """How often each candidate was picked, with its rectangle: picks (plan_id, cand_id) of rects (plan_id, cand_id, x0, y0, x1, y1)."""
    return picks.groupBy("plan_id", "cand_id").agg(F.count(F.lit(1)).alias("copies")).join(rects.select("plan_id", "cand_id", "x0", "y0", "x1", "y1"), ["plan_id", "cand_id"])
