"""Mixing sources to target weights: a subset of each source whose words come as near to its budget as they can."""

from __future__ import annotations

import math
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Weights of the sources by code point, repeated; the words wanted in all, in percent of those there are; and
#: how many times a document may be taken.
WEIGHTS = (5, 2, 1)
PERCENT = 150
MOST_TIMES = 2
SEED = 17
#: Lots that a (source, size) group is dealt to by the seeded hash, so that no task has to order a hot group.
LOTS = 1024
#: Levels of words for each unit of weight that are tried at once.
LEVELS = 64


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    # what is counted are the places where a word begins
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (distinct) with ``place``, 0 for the first by code point and null last.

    Sorted by ranges; only the number of sources in each range goes through the driver.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(counts):
        before[part] = at
        at += counts[part]
    if not before:
        return dealt.withColumn("place", F.lit(0).cast("long")).drop("_part")
    starts = spark.createDataFrame(sorted(before.items()), "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("_n", within).join(F.broadcast(starts), "_part").withColumn("place", F.col("_before") + F.col("_n") - 1).drop("_part", "_before", "_n")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most_times: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above ``most_times`` its size.

    What a full source cannot take is shared anew by weight among the others, until none is above. So all others get
    the same words for each unit of weight. That level is narrowed down by summing up the table for ``LEVELS`` of them at once, until no
    source fills up between two; the number of rounds does not grow with the sources, and only sums come to the driver.
    """
    placed = ranked(sizes)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = stored(placed.select("source", "source_size", pick.cast("double").alias("weight"), (most_times * F.col("source_size")).cast("double").alias("most")), "weights")
    table = table.withColumn("full_at", F.col("most") / F.col("weight"))
    row = table.agg(F.sum("source_size").alias("words"), F.sum("most").alias("most"), F.max("full_at").alias("last")).first()
    total = (row["words"] or 0) * percent / 100
    if total >= (row["most"] or 0):
        return table.select("source", "source_size", F.col("most").alias("target"))
    low, high = 0.0, row["last"]
    while True:
        between = [low + (high - low) * k / LEVELS for k in range(1, LEVELS)]
        sums = [F.sum(F.least(F.col("weight") * g, F.col("most"))).alias(f"at{k}") for k, g in enumerate(between)]
        row = table.agg(F.count(F.when((F.col("full_at") > low) & (F.col("full_at") < high), 1)).alias("open"), *sums).first()
        under = sum(row[f"at{k}"] <= total for k in range(len(between)))
        bounds = [low, *between, high]
        if row["open"] == 0 or bounds[under + 1] - bounds[under] >= high - low:
            break
        low, high = bounds[under], bounds[under + 1]
    full = F.col("full_at") <= low
    row = table.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("filled"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
    level = max(total - row["filled"], 0.0) / row["free"]
    return table.select("source", "source_size", F.least(F.col("weight") * F.lit(float(level)), F.col("most")).alias("target"))


def _nearest(lengths: list[int], more: list[int], less: list[int], lack: float, room: int) -> tuple[list[int], float]:
    """Changes of each length, at most ``more`` and at least -``less``, whose words come nearest to ``lack`` while sums stay within ``room``.

    Bit room + s of a big integer tells whether sum s can be made; each length's copies go in binary parts. It stops at
    the first set of lengths that makes the nearest whole number of words. Of the integers before n parts, about sqrt(n) at even
    distances are kept; those between are made again, stretch by stretch, to trace the parts back.
    """
    goal = round(lack)
    mask = (1 << (2 * room + 1)) - 1

    def with_part(reach: int, k: int, c: int) -> int:
        words = abs(c) * lengths[k]
        return (reach | (reach << words if c > 0 else reach >> words)) & mask

    reach, parts = 1 << room, []
    saved, stretch = [reach], 1
    for k, n in enumerate(lengths):
        for left, sign in ((min(more[k], room // n), 1), (min(less[k], room // n), -1)):
            size = 1
            while left > 0 and not reach >> (room + goal) & 1:
                c = min(size, left)
                parts.append((k, sign * c))
                reach = with_part(reach, *parts[-1])
                if len(parts) % stretch == 0:
                    saved.append(reach)
                    if len(saved) > 2 * stretch:
                        saved, stretch = saved[::2], 2 * stretch
                left, size = left - c, size * 2
    below = reach & ((1 << (room + goal + 1)) - 1)
    above = reach >> (room + goal)
    options = ([below.bit_length() - 1 - room] if below else []) + ([goal + (above & -above).bit_length() - 1] if above else [])
    at = min(options, key=lambda x: (abs(x - lack), x))
    change, off, bit = [0] * len(lengths), abs(at - lack), room + at
    for number in reversed(range(len(saved))):
        some = parts[number * stretch : (number + 1) * stretch]
        before = list(accumulate(some[:-1], lambda reach, part: with_part(reach, *part), initial=saved[number]))
        for (k, c), can in zip(reversed(some), reversed(before[: len(some)]), strict=True):
            if not can >> bit & 1:
                change[k] += c
                bit -= c * lengths[k]
    return change, off


def fit(lengths: list[int], counts: list[int], budget: float) -> list[int]:
    """How many documents of each length to take so that their words come as near to ``budget`` as any choice can.

    The bulk is taken in proportion, floor(count * budget / all words) of each length, and then from the longest length down
    while a document fits. The rest is an exact bounded knapsack that may add documents and give taken ones back, over
    sums within a room of some longest documents. If no choice there is as near as the lengths' common divisor
    allows, the room grows, up to longest * (2 * longest + 1): of two choices with equal words, one differs from the bulk
    by no more documents than that has longest ones, since else some of the changes would cancel out.
    """
    every = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if every == 0 or budget <= 0:
        return [0] * len(lengths)
    if budget >= every:
        return list(counts)
    goal = int(budget)
    take = [min(c, int(c * goal // every)) for c in counts]
    lack = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted((k for k in range(len(lengths)) if lengths[k] > 0), key=lambda k: -lengths[k])
    longest = lengths[order[0]]
    for k in order:
        more = min(counts[k] - take[k], int(max(0, lack) // lengths[k]))
        take[k] += more
        lack -= more * lengths[k]
    unit = math.gcd(*(lengths[k] for k in order))
    made = budget - lack
    # no sum can be nearer than the nearest multiple of the divisor
    best = abs(round(budget / unit) * unit - budget)
    most = min(longest * (2 * longest + 1), every)
    room = min(2 * longest, most)
    while True:
        change, off = _nearest([lengths[k] for k in order], [counts[k] - take[k] for k in order], [take[k] for k in order], budget - made, room)
        if off <= best + 1e-9 or room >= most:
            break
        room = min(4 * room, most)
    for k, c in zip(order, change, strict=True):
        take[k] += c
    return take


def _fits(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size", kind="stable")
    lengths, counts = group["size"].tolist(), group["n"].tolist()
    words = sum(n * c for n, c in zip(lengths, counts, strict=True))
    target = float(group["target"].iloc[0])
    times = int(target // words) if words else 0
    more = fit(lengths, counts, target - times * words)
    return pd.DataFrame({"source": group["source"], "size": lengths, "times": times, "n_more": more}).assign(n=counts)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, more: list[Column] | None = None) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("mark"), *(more or []))


def _planned(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most_times: int = MOST_TIMES) -> tuple[DataFrame, DataFrame]:
    """(source, size, times, n_more, n) and (source, source_size, target)."""
    histogram = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    wanted = stored(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, percent, most_times), "targets")

    # a group is one source's distinct sizes, as many as its longest document has words at most
    counted = histogram.join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("source", "size", "n", "target")
    plan = stored(counted.groupBy("source").applyInPandas(_fits, "source string, size long, times long, n_more long, n long"), "plan")
    return plan, wanted


def _copies(sized: DataFrame, plan: DataFrame, seed: int, more: list[str] | None = None) -> DataFrame:
    """``sized`` with copies; of a size that is taken in part, the first documents by the seeded hash get one more."""
    # ranks by the seeded hash: first among the lots of a group, then within the one lot that is taken in part
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    dealt = sized.withColumn("_order", order).withColumn("_lot", F.pmod("_order", F.lit(LOTS)))
    lots = dealt.groupBy("source", "size", "_lot").agg(F.count("*").alias("_in"))
    earlier = F.coalesce(F.sum("_in").over(Window.partitionBy("source", "size").orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = lots.withColumn("_before", earlier).join(plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "times", "n_more"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    cut = cut.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_lot").alias("_l"), "times", F.greatest(F.lit(0), F.least("_in", F.col("n_more") - F.col("_before"))).alias("_take"))
    placed = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "size", "_lot").orderBy("_order", "doc_id", "mark")))
    joined = placed.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_lot") == F.col("_l")))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("times") + F.when(F.col("_rank") <= F.col("_take"), 1).otherwise(0)).cast("long")
    return joined.select("doc_id", "source", "size", copies.alias("copies"), *(more or []))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most_times: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row for each row of ``docs``.

    size is the text's number of words (null: 0); copies is how often the mix takes the document and taken =
    copies * size. Every document of a source is taken floor(target / source_size) times, and some once more: documents
    are counted by exact size, a knapsack over those counts picks how many of each size come nearest to the
    remaining budget, and the first so many by a seeded hash of the id are taken, by a hash of the text among equal ids. Reruns agree.

    A null source is a source of its own, last in order. Texts without words have size 0 and are never taken.
    Repeated rows are documents of their own. Other columns are ignored.
    """
    sized = stored(_sized(docs, id_col, text_col, source_col), "sizes")
    plan, wanted = _planned(sized, weights, percent, most_times)
    copied = _copies(sized, plan, seed)
    own = wanted.withColumnRenamed("source", "_s")
    out = copied.join(own, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``copies``, how often each is taken.

    A column of ``docs`` named copies is replaced. Decisions are those of ``mix``.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    plan, _ = _planned(stored(sized, "sizes"), **options)
    carried = _sized(docs, id_col, text_col, source_col, [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "copies"]).alias("_row")])
    return _copies(carried, plan, seed, ["_row"]).where("copies > 0").select("_row.*", "copies")
