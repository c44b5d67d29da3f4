"""Statistics of executed plans, one row for each iteration (and mode, time or pattern)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import s_to_hms

#: Classes of leg durations: five minutes each, the last open.
CLASS_S, LAST_CLASS = 300, 12


def mode_share(trips: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Share of each main mode in the iteration's trips; 0 where a mode does not occur."""
    counts = trips.groupBy("iteration").agg(F.count("*").alias("_all"), *[F.count(F.when(F.col("main_mode") == m, 1)).alias(m) for m in modes])
    return counts.select("iteration", *[(F.col(m) / F.col("_all")).alias(m) for m in modes])


def person_km(legs: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Whole kilometres by leg mode."""
    return legs.groupBy("iteration").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("distance_m"))), F.lit(0.0)) / 1000).cast("long").alias(m) for m in modes])


def person_hours(legs: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Hours by leg mode, of travel and of waiting."""
    hours = lambda m, c: F.coalesce(F.sum(F.when(F.col("mode") == m, F.col(c))), F.lit(0)) / 3600
    travel = [hours(m, "travel_s").alias(f"{m}_travel") for m in modes]
    return legs.groupBy("iteration").agg(*travel, *[hours(m, "wait_s").alias(f"{m}_wait") for m in modes])


def travel_distance(legs: DataFrame, trips: DataFrame) -> DataFrame:
    """Mean distance of legs and of trips."""
    by_leg = legs.groupBy("iteration").agg(F.avg("distance_m").alias("avg_leg_distance"))
    return by_leg.join(trips.groupBy("iteration").agg(F.avg("distance_m").alias("avg_trip_distance")), "iteration", "full")


def leg_histogram(legs: DataFrame, bin_s: int = 300, n_bins: int | None = None) -> DataFrame:
    """(iteration, mode, bin, departures, arrivals, stuck, en_route); mode "all" stands for every mode.

    Bins without events are filled in up to the iteration's last one. With ``n_bins``, later times count in the last bin.
    en_route is departures less arrivals and stuck, accumulated.
    """
    facts = legs.select(
        "iteration",
        "mode",
        F.explode(F.array(F.struct(F.lit("departures").alias("what"), F.col("dep_s").alias("s")), F.struct(F.when(F.col("stuck"), F.lit("stuck")).otherwise("arrivals").alias("what"), F.col("arr_s").alias("s")))).alias("x"),
    )
    place = F.floor(F.col("x.s") / bin_s)
    facts = facts.select("iteration", "mode", F.col("x.what").alias("what"), (place if n_bins is None else F.least(place, F.lit(n_bins - 1))).cast("long").alias("bin")).where("bin is not null")
    what = ("departures", "arrivals", "stuck")
    per_mode = facts.groupBy("iteration", "mode", "bin").agg(*[F.count(F.when(F.col("what") == w, 1)).alias(w) for w in what])
    every = per_mode.groupBy("iteration", "bin").agg(*[F.sum(w).alias(w) for w in what]).select("iteration", F.lit("all").alias("mode"), "bin", *what)
    both = per_mode.unionByName(every)
    ends = both.groupBy("iteration").agg(F.max("bin").alias("last"), F.collect_set("mode").alias("modes"))
    grid = ends.select("iteration", F.explode("modes").alias("mode"), "last").select("iteration", "mode", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    full = grid.join(both, ["iteration", "mode", "bin"], "left").na.fill(0, list(what))
    order = Window.partitionBy("iteration", "mode").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.withColumn("en_route", F.sum(F.col("departures") - F.col("arrivals") - F.col("stuck")).over(order))


def leg_durations(legs: DataFrame) -> DataFrame:
    """(iteration, pattern, c0..c60): legs by ``from---to`` and five-minute class, the last from an hour on; in order of the pattern."""
    kind = F.least(F.floor(F.col("travel_s") / CLASS_S), F.lit(LAST_CLASS))
    classes = [F.count(F.when(kind == k, 1)).alias(f"c{5 * k}") for k in range(LAST_CLASS + 1)]
    return legs.groupBy("iteration", F.concat_ws("---", "from_type", "to_type").alias("pattern")).agg(*classes).orderBy("iteration", "pattern")


def avg_leg_duration(legs: DataFrame) -> DataFrame:
    """(iteration, avg_s, avg_hms)."""
    return legs.groupBy("iteration").agg(F.avg("travel_s").alias("avg_s")).withColumn("avg_hms", s_to_hms(F.col("avg_s")))


def best_plan(plans: DataFrame) -> DataFrame:
    """(person_id, plan_id, score): each person's plan of the highest score, the smallest plan_id among equals."""
    best = plans.groupBy("person_id").agg(F.max(F.struct(F.col("score"), (-F.col("plan_id")).alias("_minus"))).alias("b"))
    return best.select("person_id", (-F.col("b._minus")).alias("plan_id"), F.col("b.score").alias("score"))


def selected_plan(plans: DataFrame) -> DataFrame:
    """(person_id, plan_id, score): the plan that each person executes, by ``selected``; the smallest plan_id if several are marked. Others have no row."""
    chosen = plans.where("selected").groupBy("person_id").agg(F.min(F.struct("plan_id", "score")).alias("p"))
    return chosen.select("person_id", "p.plan_id", "p.score")


def score_stats(plans: DataFrame) -> DataFrame:
    """(iteration, avg_executed, avg_worst, avg_avg, avg_best): means over persons, with every plan kept in memory.

    ``plans``: person_id, plan_id, iteration in which it was made, score. A person takes part from the first plan on, and
    executes in an iteration the last plan made so far. A person's figures change only where a plan was made: these changes are summed by
    iteration, and running sums over the few iterations give all persons' totals, so there is no row for an iteration in which a person stays the same.
    Every iteration from the first plan to the last has a row; plans with a null iteration are left out.
    """
    ends = plans.agg(F.min("iteration").alias("lo"), F.max("iteration").alias("hi")).first()
    made = plans.where("iteration is not null").groupBy("person_id", "iteration").agg(F.sum("score").alias("s"), F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.max_by("score", "plan_id").alias("last"))
    order = Window.partitionBy("person_id").orderBy("iteration")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = ["executed", "worst", "avg", "best"]
    at = made.select("person_id", "iteration", F.col("last").alias("executed"), F.min("lo").over(so_far).alias("worst"), (F.sum("s").over(so_far) / F.sum("n").over(so_far)).alias("avg"), F.max("hi").over(so_far).alias("best"))
    first = F.row_number().over(order) == 1
    steps = at.select("iteration", first.cast("long").alias("persons"), *[(F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0.0))).alias(c) for c in names])
    changes = steps.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in ["persons", *names]])
    every = plans.sparkSession.range(ends["lo"] or 0, (ends["hi"] or 0) + 1 if ends["lo"] is not None else 0).select(F.col("id").cast(plans.schema["iteration"].dataType).alias("iteration"))
    # one row for each iteration: no more than a task can hold
    running = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(running)
    return every.join(changes, "iteration", "left").select("iteration", *[(total(c) / total("persons")).alias(f"avg_{c}") for c in names])


def link_volumes(entries: DataFrame) -> DataFrame:
    """(link_id, hour, volume) of link entries with a time in seconds; hours go past 23."""
    return entries.groupBy("link_id", F.floor(F.col("time_s") / 3600).cast("long").alias("hour")).agg(F.count("*").alias("volume"))


def daily_volumes(volumes: DataFrame, days: int = 1) -> DataFrame:
    """(link_id, daily_volume): an average day's volume."""
    return volumes.groupBy("link_id").agg((F.sum("volume") / days).alias("daily_volume"))
