"""Comparisons of a result with an expected one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_errors
from ..storage import checkpointed


def compare_counts(volumes: DataFrame, counts: DataFrame) -> DataFrame:
    """Counted hours with the simulated volume (0 where there is none) and the errors; (link_id, hour) is the key."""
    both = counts.join(volumes, ["link_id", "hour"], "left").withColumn("sim_volume", F.coalesce("volume", F.lit(0)).cast("double"))
    errors = count_errors(F.col("sim_volume"), F.col("count_volume"))
    return both.select("link_id", "hour", "sim_volume", "count_volume", *[c.alias(n) for n, c in errors.items()])


def compare_scores(expected: DataFrame, actual: DataFrame, eps: float = 1e-10) -> DataFrame:
    """Expected persons whose score is missing or off by more than ``eps``: (person_id, expected, actual)."""
    both = expected.select("person_id", F.col("score").alias("expected")).join(actual.select("person_id", F.col("score").alias("actual")), "person_id", "left")
    return both.where(F.col("actual").isNull() | (F.abs(F.col("expected") - F.col("actual")) > eps))


#: So many differing time steps are broadcast; with more, rows are joined by step.
MOST_STEPS = 1_000_000


def _texts(events: DataFrame) -> DataFrame:
    """(time_s, event): each row as text, attributes in order of their names."""
    attributes = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs"))))
    return events.select("time_s", F.concat_ws(" ", "type", attributes).alias("event"))


def differing_steps(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(time_s) of the steps whose events are not the same on both sides, whatever their order.

    A step's digest is its number of rows and the sum of their 64-bit hashes, in two halves that cannot overflow. Digests are partial
    aggregates of one row for each step and task.
    """
    h = F.xxhash64("event")
    digest = lambda df: _texts(df).groupBy("time_s").agg(F.struct(F.count("*"), F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))).alias("d"))
    one, two = digest(expected).alias("a"), digest(actual).alias("b")
    both = one.join(two, F.col("a.time_s").eqNullSafe(F.col("b.time_s")), "full").where(~F.col("a.d").eqNullSafe(F.col("b.d")))
    return both.select(F.coalesce("a.time_s", "b.time_s").alias("time_s"))


def compare_events(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Events that one table has more often than the other at a time: (time_s, event, n_expected, n_actual).

    ``event`` is the row as text, attributes in order of their names. Time steps are compared by their digests first; only rows of steps that
    differ are counted one by one and shuffled for it. A null time is a time like others.
    """
    steps = checkpointed(differing_steps(expected, actual))
    steps = F.broadcast(steps) if steps.count() <= MOST_STEPS else steps

    def counted(df: DataFrame, name: str) -> DataFrame:
        rows = _texts(df)
        return rows.join(steps, rows["time_s"].eqNullSafe(steps["time_s"]), "left_semi").groupBy("time_s", "event").agg(F.count("*").alias(name))

    one, two = counted(expected, "n_expected").alias("a"), counted(actual, "n_actual").alias("b")
    both = one.join(two, F.col("a.time_s").eqNullSafe(F.col("b.time_s")) & (F.col("a.event") == F.col("b.event")), "full")
    out = both.select(F.coalesce("a.time_s", "b.time_s").alias("time_s"), F.coalesce("a.event", "b.event").alias("event"), F.coalesce("n_expected", F.lit(0)).alias("n_expected"), F.coalesce("n_actual", F.lit(0)).alias("n_actual"))
    return out.where("n_expected != n_actual")
