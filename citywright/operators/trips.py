"""From plan elements to legs and trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAN = ["iteration", "person_id", "plan_idx"]
#: Activities of this ending only change the means of transport within a trip.
STAGE = " interaction"


def activities(plan_elements: DataFrame) -> DataFrame:
    """Activities of all plans, not only of selected ones."""
    return plan_elements.where(F.col("kind") == "activity")


def legs_from_elements(plan_elements: DataFrame) -> DataFrame:
    """One row for each leg with the activities before and after it; legs without an activity right before and after are left out.

    Elements of a plan are in the order of ``pos``. One shuffle by plan; other columns of the leg are kept.
    """
    order = Window.partitionBy(*PLAN).orderBy("pos")
    seen = plan_elements.select("*", F.lag("type").over(order).alias("from_type"), F.lead("type").over(order).alias("to_type"))
    legs = seen.where((F.col("kind") == "leg") & F.col("from_type").isNotNull() & F.col("to_type").isNotNull())
    return legs.withColumn("leg_no", F.row_number().over(order)).drop("kind", "type")


def is_stage(activity: Column) -> Column:
    return activity.endswith(STAGE)


def number_trips(legs: DataFrame) -> DataFrame:
    """``legs`` with ``trip_no``: a trip begins with each leg that starts at an activity which is not a stage."""
    order = Window.partitionBy(*PLAN).orderBy("leg_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return legs.withColumn("trip_no", F.sum(F.when(is_stage(F.col("from_type")), 0).otherwise(1)).over(order))


#: Rank of leg modes, for trips without a routing mode.
MODE_RANK = {"pt": 3, "car": 2, "walk": 1}


def main_mode(legs_of_trip_order: str = "leg_no") -> Column:
    """Main mode of a trip as an aggregate: the first leg's routing mode, else the leg mode of the highest rank."""
    rank = F.lit(0)
    for mode, value in MODE_RANK.items():
        rank = F.when(F.col("mode") == mode, value).otherwise(rank)
    return F.coalesce(F.min_by("routing_mode", legs_of_trip_order), F.max_by("mode", F.struct(rank, "mode")))


def trips_from_legs(legs: DataFrame) -> DataFrame:
    """One row for each trip: from and to, main mode, distance, number of legs. Uses the legs' partitioning by plan."""
    return (
        number_trips(legs)
        .groupBy(*PLAN, "trip_no")
        .agg(
            F.min_by("from_type", "leg_no").alias("from_type"),
            F.max_by("to_type", "leg_no").alias("to_type"),
            main_mode().alias("main_mode"),
            F.sum("distance_m").alias("distance_m"),
            F.count("*").alias("n_legs"),
        )
    )
