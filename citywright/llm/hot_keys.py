"""Joins in which no key's rows go to one task, however many rows have it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: A key with more rows than this is split, but never with fewer than one in ``MOST_HOT`` of all rows, so that no more keys than
#: ``MOST_HOT`` can be hot and their list can be broadcast at any size of the tables.
HOT_ROWS, MOST_HOT = 500, 100_000


def join_split(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` by ``key``; rows of a hot key are dealt to parts, and the table's rows of it are repeated for each.

    ``table`` should have few rows for each key. ``counts`` (key, n) says how many rows each key has, if that is known
    already, else ``rows`` should be a stored table; keys it lacks are not hot. ``how`` is "inner" or "left". Null keys match nothing.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    size = counts.agg(F.sum("n").alias("total"), F.max("n").alias("top")).first()
    most = max(HOT_ROWS, (size["total"] or 0) // MOST_HOT)
    if (size["top"] or 0) <= most:
        return rows.join(table, key, how)
    hot = stored(counts.where((F.col("n") > most) & F.col(key).isNotNull()).select(key, F.ceil(F.col("n") / most).cast("int").alias("hot_parts")), "hot-keys")
    parts = F.coalesce("hot_parts", F.lit(1))
    own = [F.col(c) for c in rows.columns if c != key]
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("hot_part", F.pmod(F.xxhash64(*own), parts).cast("int")).drop("hot_parts")
    repeated = table.join(F.broadcast(hot), key, "left").withColumn("hot_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot_parts")
    return dealt.join(repeated, [key, "hot_part"], how).drop("hot_part")
