"""Stored solutions: compact entries from JSON, migration between versions, and results that replace each other.

Defined results. Entries whose indices are missing or hold anything but numbers, digits or truth values are none. A cost that is missing, not a number or not finite is null and
ranks last. Equal ranks keep the earlier result. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 3


def _kind(v: Column) -> Column:
    """text, flag or number, null for JSON's null and for what holds other values."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", "text").when(kind == "BOOLEAN", "flag").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")


def _number(v: Column) -> Column:
    """A JSON value as a number: true is 1, text is read; null if it is none."""
    text = F.trim(F.try_variant_get(v, "$", "string"))
    return F.when(_kind(v) == "flag", (text == "true").cast("double")).when(_kind(v).isNotNull(), text.try_cast("double"))


def _whole(v: Column) -> Column:
    """A JSON value as a whole number: fractions are cut off, text must be digits; null if it is none."""
    digits = F.trim(F.try_variant_get(v, "$", "string")).rlike(r"^[+-]?[0-9]+$")
    return F.when((_kind(v) != "text") | digits, _number(v)).try_cast("bigint")


def compact_entry(raw: Column) -> Column:
    """Of an entry as JSON: struct of indices in order, cost and optimal, which only entries of v 1 can be; null if it has no
    indices. A cost that is given, though null, is not replaced by a total_cost."""
    of = lambda *names: F.coalesce(*(F.try_variant_get(F.try_parse_json(raw), f"$.{n}", "variant") for n in names))
    indices = F.transform(F.try_variant_get(F.try_parse_json(raw), "$.indices", "array<variant>"), _whole)
    whole = indices.isNotNull() & ~F.exists(indices, lambda i: i.isNull())
    number = _number(of("cost", "total_cost"))
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    flag, v = of("optimal", "is_optimal"), of("v")
    true = F.when(_kind(flag) == "text", F.length(F.try_variant_get(flag, "$", "string")) > 0).otherwise(_number(flag) != 0)
    optimal = (_kind(v) != "text") & (_number(v) == 1) & true
    return F.when(whole, F.struct(F.array_sort(indices).alias("indices"), finite.alias("cost"), F.coalesce(optimal, F.lit(False)).alias("optimal")))


def _rank(optimal: Column, cost: Column, *rest: Column) -> Column:
    return F.struct((~optimal).alias("r"), F.coalesce(cost, F.lit(float("inf"))).alias("c"), *rest)


def best_entries(entries: DataFrame) -> DataFrame:
    """The best entry for each plan and number of entries (plan_id, n, pos, raw): plan_id, n, indices, cost, optimal."""
    rows = entries.select("plan_id", "n", "pos", compact_entry(F.col("raw")).alias("e")).where("e is not null")
    best = F.min_by("e", _rank(F.col("e.optimal"), F.col("e.cost"), F.col("pos")))
    return rows.groupBy("plan_id", "n").agg(best.alias("e")).select("plan_id", "n", "e.indices", "e.cost", "e.optimal")


def migrated(entries: DataFrame, plans: DataFrame, infeasible: DataFrame) -> DataFrame:
    """What stored data (plans: plan_id, version, problem_id, asked, the id of the problem at hand) still tell of each number:
    plan_id, n, status (solved, infeasible), cost, optimal, and problem, `problem_id` where the data are another problem's,
    alone in its row. Numbers proved infeasible have no solution; data of another version prove nothing."""
    here = F.col("problem_id").isNull() | (F.col("problem_id") == F.col("asked"))
    now = F.coalesce(F.col("version") == VERSION, F.lit(False))
    own = plans.where(here).select("plan_id", now.alias("now"))
    proved = infeasible.join(own.where("now"), "plan_id").select("plan_id", "n").distinct()
    none = lambda t: F.lit(None).cast(t)
    solved = best_entries(entries).join(own, "plan_id").join(proved, ["plan_id", "n"], "left_anti")
    out = solved.select("plan_id", "n", F.lit("solved").alias("status"), "cost", F.col("optimal"), none("string").alias("problem"))
    out = out.unionByName(proved.select("plan_id", "n", F.lit("infeasible").alias("status"), none("double").alias("cost"), none("boolean").alias("optimal"), none("string").alias("problem")))
    return out.unionByName(plans.where(~here).select("plan_id", none("long").alias("n"), none("string").alias("status"), none("double").alias("cost"), none("boolean").alias("optimal"), F.lit("problem_id").alias("problem")))


def registered(results: DataFrame) -> DataFrame:
    """What results (plan_id, n, seq, feasible, optimal, cost, proved) leave of each number: plan_id, n, status, seq, cost.

    An optimal result replaces one that is not, else only a cheaper one does. A proof that there is no solution deletes what was
    found, and a solution found later deletes the proof. Both steps combine before rows move."""
    last = results.groupBy("plan_id", "n").agg(F.max(F.when(F.col("proved"), F.col("seq"))).alias("proof"))
    after = results.where("feasible").join(last, ["plan_id", "n"]).where("proof is null or seq > proof")
    best = after.groupBy("plan_id", "n").agg(F.min_by(F.struct("seq", "cost", "optimal"), _rank(F.col("optimal"), F.col("cost"), F.col("seq"))).alias("b"))
    status = F.when(F.col("b.optimal"), "optimal").when(F.col("b").isNotNull(), "feasible").when(F.col("proof").isNotNull(), "infeasible")
    return last.join(best, ["plan_id", "n"], "left").select("plan_id", "n", status.alias("status"), F.col("b.seq").alias("seq"), F.col("b.cost").alias("cost")).where("status is not null")
