"""Iterative proportional fitting of census marginals into joint distributions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed

#: Stop rule: rounds, greatest relative error that counts as fitted, and least change between rounds.
MOST_ROUNDS, FITTED, STALLED = 500, 1e-5, 1e-8
#: Cells of one section that the vectorised helper takes, and cells of a batch of sections; beyond, use ``ipf_long``.
MOST_CELLS, BATCH_CELLS = 2_000_000, 8_000_000
#: Slices of a layer, over all sections, whose factors are broadcast.
MOST_SLICES = 200_000
#: A column whose sketch counts fewer values than this share of the rows is no key.
CLEARLY_FEWER = 0.9


@dataclass(frozen=True)
class Spec:
    """Dimensions, each an ordered list of category columns, and combinations of categories that cannot occur."""

    dims: Sequence[Sequence[str]]
    impossible: Sequence[tuple[str, ...]] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        flat = [c for d in self.dims for c in d]
        if len(self.dims) < 2 or not all(self.dims):
            raise ValueError("two dimensions at least are needed, and none may be empty")
        if len(set(flat)) < len(flat):
            raise ValueError("a column can be in one dimension only")

    @property
    def columns(self) -> list[str]:
        return [c for d in self.dims for c in d]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(d) for d in self.dims)

    def valid_impossible(self, axes: Sequence[int] | None = None) -> set[tuple[int, ...]]:
        """Places of the impossible combinations on ``axes`` (all by default); one that names an unknown category there is left out."""
        axes = range(len(self.dims)) if axes is None else axes
        places = [{c: k for k, c in enumerate(d)} for d in self.dims]
        return {tuple(places[a][combo[a]] for a in axes) for combo in self.impossible if all(combo[a] in places[a] for a in axes)}

    def projected(self, axes: Sequence[int], rule: str = "any") -> set[tuple[int, ...]]:
        """Impossible places of a projection: those that some ("any") or every ("all") category of the missing dimensions makes so."""
        if rule == "any":
            return self.valid_impossible(axes)
        full = self.valid_impossible()
        rest = [a for a in range(len(self.dims)) if a not in axes]
        need = int(np.prod([self.shape[a] for a in rest]))
        seen: dict[tuple[int, ...], int] = {}
        for cell in full:
            key = tuple(cell[a] for a in axes)
            seen[key] = seen.get(key, 0) + 1
        return {k for k, n in seen.items() if n == need}


def add_impossible(current: DataFrame, new: DataFrame) -> DataFrame:
    """Combinations of both tables, each once."""
    return current.unionByName(new).distinct()


def remove_impossible(current: DataFrame, gone: DataFrame) -> DataFrame:
    """Combinations of ``current`` that are not in ``gone``."""
    return current.join(gone, current.columns, "left_anti")


def expand_impossible(spark, selections: Sequence[Sequence[str]]) -> DataFrame:
    """All combinations of one category from each dimension's selection, as columns d1..dN."""
    tables = [spark.createDataFrame([(c,) for c in s], f"d{k} string") for k, s in enumerate(selections, 1)]
    return reduce(lambda a, b: a.crossJoin(b), tables)


def all_cells(spark, spec: Spec) -> DataFrame:
    """(cell_no, d1..dN, possible): every cell in row-major order, from the dimension tables. As many rows as the specification has cells."""
    tables = [spark.createDataFrame(list(enumerate(d)), f"_p{k} int, d{k} string") for k, d in enumerate(spec.dims, 1)]
    cells = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables)
    number = F.lit(0).cast("long")
    for k, size in enumerate(spec.shape, 1):
        number = number * size + F.col(f"_p{k}")
    names = [f"d{k}" for k in range(1, len(spec.dims) + 1)]
    return seed(cells.select(number.alias("cell_no"), *names), spec)


def seed(cells: DataFrame, spec: Spec) -> DataFrame:
    """``cells`` (d1..dN) with ``weight``: 0 for impossible combinations, 1 for all others."""
    names = [f"d{k}" for k in range(1, len(spec.dims) + 1)]
    if not spec.impossible:
        return cells.withColumn("weight", F.lit(1.0))
    gone = cells.sparkSession.createDataFrame(sorted(set(map(tuple, spec.impossible))), ", ".join(f"{n} string" for n in names)).withColumn("_gone", F.lit(True))
    return cells.join(F.broadcast(gone), names, "left").withColumn("weight", F.when(F.col("_gone"), 0.0).otherwise(1.0)).drop("_gone")


def seed_projection(cells: DataFrame, spec: Spec, axes: Sequence[int], rule: str = "any") -> DataFrame:
    """``cells`` of a projection (its own d columns) with ``weight``: 0 where impossible combinations reach it by ``Spec.projected``, else 1."""
    names = [f"d{a + 1}" for a in axes]
    gone = [tuple(spec.dims[a][k] for a, k in zip(axes, place, strict=True)) for place in sorted(spec.projected(axes, rule))]
    if not gone:
        return cells.withColumn("weight", F.lit(1.0))
    table = cells.sparkSession.createDataFrame(gone, ", ".join(f"{n} string" for n in names)).withColumn("_gone", F.lit(True))
    return cells.join(F.broadcast(table), names, "left").withColumn("weight", F.when(F.col("_gone"), 0.0).otherwise(1.0)).drop("_gone")


def marginals(df: DataFrame, spec: Spec) -> DataFrame:
    """``df`` with m1..mN, each dimension's values as an array in column order."""
    return df.select("*", *[F.array(*[F.col(f"`{c}`").cast("double") for c in d]).alias(f"m{k}") for k, d in enumerate(spec.dims, 1)])


def total_marginals(df: DataFrame, spec: Spec) -> DataFrame:
    """One row with the total of every category column; nulls are skipped, no rows give zeros."""
    return df.agg(*[F.coalesce(F.sum(F.col(f"`{c}`").cast("double")), F.lit(0.0)).alias(c) for c in spec.columns])


def check_totals(df: DataFrame, spec: Spec, by: str | None = None, tol: float = 0.0) -> DataFrame:
    """([by,] total1..totalN, equal): each dimension's total over all rows, or for each value of ``by``, and whether they agree."""
    sums = [reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in d]) for d in spec.dims]
    totals = [F.coalesce(F.sum(s), F.lit(0.0)).alias(f"total{k}") for k, s in enumerate(sums, 1)]
    out = df.groupBy(by).agg(*totals) if by else df.agg(*totals)
    names = [F.col(f"total{k}") for k in range(1, len(sums) + 1)]
    return out.withColumn("equal", F.greatest(*names) - F.least(*names) <= tol)


def unique_columns(df: DataFrame, count_null: bool = True, count_all: bool = False) -> DataFrame:
    """(column, n_distinct, is_unique): which columns could be keys. A null counts as a value if ``count_null``.

    With ``count_all``, the distinct values of every column are counted, and an empty table has a row for each column. Otherwise
    sketches of all columns in one scan rule out those with clearly fewer values than rows (``CLEARLY_FEWER``, six standard errors of a sketch):
    their n_distinct is null, and their values are not shuffled. Of the others every value is counted. An empty table has no rows.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    nulls = lambda c: F.when(F.count(F.col(f"`{c}`")) < F.count("*"), 1).otherwise(0) if count_null else F.lit(0)
    if count_all:
        # a task shuffles each of a column's values once, so that a column with few values is few rows
        counted = df.agg(F.count("*").alias("rows"), *[(F.count_distinct(F.col(f"`{c}`")) + nulls(c)).alias(f"n{k}") for k, c in enumerate(df.columns)])
        return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("n_distinct"), (F.col(f"n{k}") == F.col("rows")).alias("is_unique")) for k, c in enumerate(df.columns)])))
    seen = df.agg(F.count("*").alias("rows"), *[(F.hll_sketch_estimate(F.hll_sketch_agg(text(c))) + nulls(c)).alias(f"e{k}") for k, c in enumerate(df.columns)]).first()
    left = [c for k, c in enumerate(df.columns) if seen["rows"] and seen[f"e{k}"] >= CLEARLY_FEWER * seen["rows"]]
    out = [c for c in df.columns if c not in left and seen["rows"]]
    ruled_out = df.sparkSession.createDataFrame([(c, None, False) for c in out], "column string, n_distinct long, is_unique boolean")
    if not left:
        return ruled_out
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in left])).alias("x")).select("x.*")
    values = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    counts = values.groupBy("column").agg(F.count("*" if count_null else "value").alias("n_distinct"), F.sum("n").alias("_rows"))
    return counts.select("column", "n_distinct", (F.col("n_distinct") == F.col("_rows")).alias("is_unique")).unionByName(ruled_out)


def type_count(joint: DataFrame) -> DataFrame:
    """(n_types): how many individual types a joint table describes."""
    return joint.agg(F.count("*").alias("n_types"))


def fit_batch(weights: np.ndarray, targets: list[np.ndarray], layers: list[tuple[int, ...]], rounds: int = MOST_ROUNDS, fitted: float = FITTED, stalled: float = STALLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit a batch of tensors (batch, n1..nN) to targets on the given axes; (tensors, rounds run, last error).

    A round scales the slices of each layer in turn to their targets, a slice that sums to 0 staying as it is. A tensor is done
    when its greatest relative error is small enough or no longer changes; others in the batch go on without changing it.
    """
    out = weights.astype(np.float64).copy()
    n = out.ndim - 1
    live = np.arange(len(out))
    ran, error = np.zeros(len(out), dtype=np.int64), np.full(len(out), np.inf)
    others = [tuple(a + 1 for a in range(n) if a not in layer) for layer in layers]
    for _ in range(rounds):
        if not len(live):
            break
        part = out[live]
        for axes, goal in zip(others, targets, strict=True):
            goal = np.expand_dims(goal[live], axes)
            have = part.sum(axis=axes, keepdims=True)
            part *= np.divide(goal, have, out=np.ones_like(have), where=have != 0)
        worst = np.zeros(len(live))
        for axes, goal in zip(others, targets, strict=True):
            goal, have = goal[live], part.sum(axis=axes)
            with np.errstate(divide="ignore", invalid="ignore"):
                off = np.abs(have / goal - 1)
            worst = np.maximum(worst, np.where(np.isnan(off), 0, off).reshape(len(live), -1).max(axis=1))
        out[live] = part
        ran[live] += 1
        going = (worst > fitted) & ~(np.abs(worst - error[live]) <= stalled)
        error[live] = worst
        live = live[going]
    return out, ran, error


def _cleared(shape: tuple[int, ...], batch: int, places: set[tuple[int, ...]]) -> np.ndarray:
    ones = np.ones((batch, *shape))
    for place in places:
        ones[(slice(None), *place)] = 0
    return ones


def fit_sections(values: list[np.ndarray], spec: Spec, projection: str = "any", rounds: int = MOST_ROUNDS, fitted: float = FITTED, stalled: float = STALLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joint tensors of a batch of sections from their 1-D marginals, one array (batch, categories) for each dimension.

    Two dimensions are fitted to their marginals. More are fitted to the joints of all dimensions but one, each of which is
    fitted to 1-D marginals first.
    """
    n, batch = len(spec.dims), len(values[0])
    layers, targets = [(k,) for k in range(n)], values
    if n > 2:
        layers = list(combinations(range(n), n - 1))
        targets = []
        for axes in layers:
            start = _cleared(tuple(spec.shape[a] for a in axes), batch, spec.projected(axes, projection))
            targets.append(fit_batch(start, [values[a] for a in axes], [(k,) for k in range(n - 1)], rounds, fitted, stalled)[0])
    return fit_batch(_cleared(spec.shape, batch, spec.valid_impossible()), targets, layers, rounds, fitted, stalled)


def ipf(df: DataFrame, spec: Spec, section: str | None = None, nulls: str = "error", projection: str = "any", rounds: int = MOST_ROUNDS, fitted: float = FITTED, stalled: float = STALLED, drop_zero: bool = False) -> DataFrame:
    """([section,] d1..dN, cell_no, value): the fitted joint distribution, in row-major order of the categories.

    With ``section`` every row is fitted by itself, batch by batch where it lies, without a shuffle; without it the column
    totals are fitted. ``nulls``: "error" rejects a section with a null, "zero" counts it as 0. Zero cells are kept unless ``drop_zero``.
    """
    fitted_rows = _fitted_rows(df, spec, section, nulls, projection, rounds, fitted, stalled)
    spread = fitted_rows.select("section", F.posexplode("cells").alias("cell_no", "value"))
    out = cells_long(spread, spec)
    out = out.where("value != 0") if drop_zero else out
    return out if section else out.drop("section")


def _fitted_rows(df: DataFrame, spec: Spec, section: str | None, nulls: str, projection: str, rounds: int, fitted: float, stalled: float) -> DataFrame:
    """(section, cells, rounds, error): one row for each fitted tensor."""
    cells = int(np.prod(spec.shape))
    if cells > MOST_CELLS:
        raise ValueError(f"{cells} cells for each section are too many for one task; use ipf_long")
    source = df.select(F.col(f"`{section}`").cast("string").alias("section"), *[F.col(f"`{c}`").cast("double") for c in spec.columns]) if section else total_marginals(df, spec).select(F.lit(None).cast("string").alias("section"), "*")
    columns, step = spec.columns, max(1, BATCH_CELLS // cells)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if nulls == "error" and frame[columns].isna().any(axis=None):
                raise ValueError("a section has a null; pass nulls='zero' to count it as 0")
            for a in range(0, len(frame), step):
                part = frame.iloc[a : a + step]
                values = [part[list(d)].fillna(0.0).to_numpy(dtype=np.float64) for d in spec.dims]
                joint, ran, error = fit_sections(values, spec, projection, rounds, fitted, stalled)
                yield pd.DataFrame({"section": part["section"].to_numpy(), "cells": list(joint.reshape(len(part), -1)), "rounds": ran, "error": error})

    return source.mapInPandas(run, "section string, cells array<double>, rounds long, error double")


def cells_long(spread: DataFrame, spec: Spec) -> DataFrame:
    """(section, cell_no, value) with the categories' names d1..dN in place of positions."""
    names, below = [], 1
    for k in range(len(spec.dims), 0, -1):
        at = F.floor(F.col("cell_no") / below) % spec.shape[k - 1]
        names.append(F.element_at(F.array(*[F.lit(c) for c in spec.dims[k - 1]]), (at + 1).cast("int")).alias(f"d{k}"))
        below *= spec.shape[k - 1]
    return spread.select("section", *reversed(names), F.col("cell_no").cast("long").alias("cell_no"), "value")


def order_cells(joint: DataFrame) -> DataFrame:
    """Rows of a section by cell number inside each partition; no global sort."""
    return joint.sortWithinPartitions(*[c for c in ("section", "cell_no") if c in joint.columns])


def ipf_long(cells: DataFrame, layers: list[list[str]], targets: list[DataFrame], rounds: int = MOST_ROUNDS, by: str | None = "section", fitted: float = FITTED, stalled: float = STALLED) -> DataFrame:
    """``cells`` ([by,] keys, weight) with ``value``, ``rounds`` and ``error``, for tensors too large for one task.

    ``targets``: for each layer a table ([by,] its keys, target); a slice without a target has 0. Cells lie anywhere and are never written or
    changed: a fitted value is the weight times a factor for each layer's slice, so a round reads the cells once for each layer and once more
    for each but the last, to sum them by slice, and keeps only the tables of slices with their factors, as logarithms, since factors of a fit
    without end grow beyond all bounds. Up to ``MOST_SLICES`` slices a layer they stay with the driver and are broadcast, so that cells are not
    shuffled; larger ones are written to the shared folder. Sums are partial aggregates. Each section ends by the stop rule of ``fit_batch``. Cells should be a stored table, as they are read in every round.
    """
    key, last = [by] if by else [], len(layers) - 1
    few = [t.count() <= MOST_SLICES for t in targets]
    hinted = lambda table, short: F.broadcast(table) if short else table
    # tables of slices that are small enough to be broadcast are so small that the driver may hold them between rounds
    kept = lambda df: cells.sparkSession.createDataFrame(df.toArrow(), df.schema) if all(few) else checkpointed(df)
    with_section = lambda df, table: df.join(hinted(table, few[0]), by) if by else df.join(F.broadcast(table))
    inf = float("inf")
    tables: dict[int, DataFrame] = {}

    def valued() -> DataFrame:
        df, power = cells, F.lit(0.0)
        for k, table in tables.items():
            df = df.join(hinted(table.select(*key, *layers[k], F.col("log").alias(f"_log{k}")), few[k]), key + layers[k], "left")
            power = power + F.coalesce(f"_log{k}", F.lit(0.0))
        return df.withColumn("value", F.col("weight").cast("double") * F.exp(power)).drop(*[f"_log{k}" for k in tables])

    def summed(k: int) -> DataFrame:
        """(keys, goal, log, have) of the layer's slices at the present factors."""
        known = tables[k].select(*key, *layers[k], "goal", "log") if k in tables else targets[k].select(*key, *layers[k], F.col("target").alias("goal"), F.lit(0.0).alias("log"))
        sums = valued().groupBy(*key, *layers[k]).agg(F.sum("value").alias("have"))
        return sums.join(hinted(known, few[k]), key + layers[k], "left").select(*key, *layers[k], F.coalesce("goal", F.lit(0.0)).alias("goal"), F.coalesce("log", F.lit(0.0)).alias("log"), "have")

    sums = [kept(summed(0))]
    marks = (sums[0].select(by).distinct() if by else cells.sparkSession.range(1)).withColumns({"error": F.lit(inf), "rounds": F.lit(0), "live": F.lit(True)})
    for _ in range(rounds):
        for k in range(last + 1):
            have = sums[0] if k == 0 else summed(k)
            step = F.when(F.col("goal") == 0, -inf).otherwise(F.log(F.col("goal") / F.col("have")))
            moved = with_section(have, marks.select(*key, "live")).withColumn("log", F.when(F.col("live") & (F.col("have") != 0), F.col("log") + step).otherwise(F.col("log"))).drop("live")
            # the first layer's follow from sums that are written already
            tables[k] = moved if k == 0 < last else kept(moved)
        sums = [kept(summed(k)) for k in range(max(1, last))]
        goal, now = F.col("goal"), F.col("have")
        off = F.when(goal != 0, F.abs(now / goal - 1)).otherwise(F.when(now == 0, 0.0).otherwise(inf))
        # the last layer meets its goals, but for slices that are empty
        parts = [t.select(*key, off.alias("now")) for t in sums[:last]] + [tables[last].select(*key, F.when((now == 0) & (goal != 0), inf).otherwise(0.0).alias("now"))]
        worst = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.max("now").alias("now"))
        ended = (F.col("now") <= fitted) | ((F.col("now") < inf) & (F.col("error") < inf) & (F.abs(F.col("now") - F.col("error")) <= stalled))
        marks = with_section(marks, worst).select(*key, F.when(F.col("live"), F.col("now")).otherwise(F.col("error")).alias("error"), (F.col("rounds") + F.col("live").cast("int")).alias("rounds"), (F.col("live") & ~ended).alias("live"))
        marks = kept(marks)
        if marks.where("live").isEmpty():
            break
    return with_section(valued(), marks.select(*key, "rounds", "error"))


def independent_joint(df: DataFrame, spec: Spec, section: str) -> DataFrame:
    """The closed form where nothing is impossible: the product of the marginals over the total to the power N - 1."""
    columns = marginals(df, spec)
    total = F.aggregate("m1", F.lit(0.0), lambda a, x: a + x)
    out = columns.select(F.col(f"`{section}`").cast("string").alias("section"), total.alias("_total"), *[f"m{k}" for k in range(1, len(spec.dims) + 1)])
    number = F.lit(0)
    for k, size in enumerate(spec.shape, 1):
        out = out.select("*", F.posexplode(f"m{k}").alias(f"_p{k}", f"_v{k}"))
        number = number * size + F.col(f"_p{k}")
    value = reduce(lambda a, b: a * b, [F.col(f"_v{k}") for k in range(1, len(spec.dims) + 1)])
    power = F.pow("_total", F.lit(len(spec.dims) - 1.0))
    return cells_long(out.select("section", number.alias("cell_no"), F.when(power != 0, value / power).otherwise(0.0).alias("value")), spec)


def blocked_categories(rows: np.ndarray, cols: np.ndarray, allowed: np.ndarray) -> tuple[float, np.ndarray]:
    """(what of ``rows`` no table can place, the rows that cause it): the least set whose sum exceeds most that of all columns it can go to.

    A greatest flow from rows to columns along ``allowed`` cells: greedy first, then along shortest augmenting paths. What it
    cannot place is the least cut's excess, and the rows that can still be reached from unplaced ones are the cut's least set.
    """
    left, room, flow = rows.astype(np.float64), cols.astype(np.float64), np.zeros(allowed.shape)
    least = 1e-12 * max(left.sum(), room.sum(), 1.0)
    for i, j in zip(*np.nonzero(allowed), strict=True):
        moved = min(left[i], room[j])
        flow[i, j], left[i], room[j] = moved, left[i] - moved, room[j] - moved
    while True:
        reached = left > least
        from_row, from_col = np.full(len(cols), -1), np.full(len(rows), -1)
        fresh, end = np.flatnonzero(reached), -1
        while len(fresh) and end < 0:
            news = np.flatnonzero(allowed[fresh].any(axis=0) & (from_row < 0))
            if not len(news):
                break
            from_row[news] = fresh[allowed[np.ix_(fresh, news)].argmax(axis=0)]
            open_ = news[room[news] > least]
            if len(open_):
                end = int(open_[0])
                break
            back = flow[:, news] > least
            fresh = np.flatnonzero(back.any(axis=1) & ~reached)
            from_col[fresh] = news[back[fresh].argmax(axis=1)]
            reached[fresh] = True
        if end < 0:
            return float(left[left > least].sum()), reached
        path, j = [], end
        while True:
            i = int(from_row[j])
            path.append((i, j))
            if from_col[i] < 0:
                break
            j = int(from_col[i])
            path.append((i, j))
        moved = min(left[path[-1][0]], room[end], *[flow[c] for c in path[1::2]])
        for k, c in enumerate(path):
            flow[c] += moved if k % 2 == 0 else -moved
        left[path[-1][0]] -= moved
        room[end] -= moved


def feasibility(wants: Sequence[np.ndarray], support: np.ndarray, max_error: float, fitted: float = FITTED) -> tuple[bool | None, list[tuple[int, int]]]:
    """(whether no table has these 1-D sums, the categories that show it, as (dimension, place)).

    ``support`` is true for the cells that can occur. For two dimensions the answer is exact. For more, each pair of dimensions must have
    a table, which is necessary; a fit that meets the sums (``max_error``), or no cell ruled out, is sufficient; else it is None.
    """
    totals, n = [float(np.sum(w)) for w in wants], len(wants)
    small = 1e-9 * max(*totals, 1.0)
    bad: set[tuple[int, int]] = set()
    shown = max(totals) - min(totals) > small
    live = support & reduce(np.logical_and, [(np.asarray(w) != 0).reshape([-1 if a == k else 1 for a in range(n)]) for k, w in enumerate(wants)])
    for k, other in combinations(range(n), 2):
        allowed = live.any(axis=tuple(a for a in range(n) if a not in (k, other)))
        for one, two, cells in ((k, other, allowed), (other, k, allowed.T)):
            excess, rows = blocked_categories(np.asarray(wants[one]), np.asarray(wants[two]), cells)
            if excess > small:
                shown = True
                bad |= {(one, int(p)) for p in np.flatnonzero(rows)}
    if shown:
        return True, sorted(bad)
    return (False if n == 2 or support.all() or max_error <= fitted else None), []


def ipf_report(df: DataFrame, spec: Spec, section: str, nulls: str = "error", projection: str = "any", rounds: int = MOST_ROUNDS, fitted: float = FITTED, stalled: float = STALLED) -> DataFrame:
    """(section, rounds, last_error, max_error, converged, infeasible, blocked) of each section's fit.

    last_error is that of the last step's own targets when it stopped, after so many rounds; max_error is the greatest relative
    distance of the cells' sums from the 1-D targets. A section converged if the former is small enough. ``infeasible`` says whether no table
    of possible cells has the section's 1-D targets as its sums, which a greatest flow decides for two dimensions; for more it is null where
    neither the fit nor a pair of dimensions settles it. ``blocked`` names the categories, in the order of the dimensions, whose targets
    are together greater than those of all categories they can occur with.
    """
    from_cells = _fitted_rows(df, spec, section, nulls, projection, rounds, fitted, stalled)
    shape = spec.shape
    support = _cleared(shape, 1, spec.valid_impossible())[0] != 0
    # one fit serves for the tensor's sums and for the figures of the fit
    wanted = F.array(*[F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in d]) for d in spec.dims])
    both = from_cells.join(df.select(F.col(f"`{section}`").cast("string").alias("section"), wanted.alias("wanted")), "section")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            worst, stuck, names = [], [], []
            for cells, wants in zip(frame["cells"], frame["wanted"], strict=True):
                tensor, wants = np.asarray(cells).reshape(shape), [np.asarray(w) for w in wants]
                off = 0.0
                for k, want in enumerate(wants):
                    have = tensor.sum(axis=tuple(a for a in range(len(shape)) if a != k))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        apart = np.abs(have / want - 1)
                    off = max(off, float(np.where(np.isnan(apart), 0, apart).max()))
                none, bad = feasibility(wants, support, off, fitted)
                worst.append(off)
                stuck.append(none)
                names.append([spec.dims[k][p] for k, p in bad])
            yield pd.DataFrame({"section": frame["section"], "rounds": frame["rounds"], "last_error": frame["error"], "max_error": worst, "infeasible": pd.Series(stuck, dtype="boolean", index=frame.index), "blocked": names})

    figures = both.mapInPandas(run, "section string, rounds long, last_error double, max_error double, infeasible boolean, blocked array<string>")
    return figures.select("section", "rounds", "last_error", "max_error", (F.col("last_error") <= fitted).alias("converged"), "infeasible", "blocked")


def possible_places(spec: Spec) -> list[tuple[int, ...]]:
    """Places of all cells that can occur, for small specifications and tests."""
    gone = spec.valid_impossible()
    return [p for p in product(*map(range, spec.shape)) if p not in gone]
