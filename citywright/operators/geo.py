"""Coordinates of plans, network extents and zones."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import in_bounds, web_mercator
from ..storage import checkpointed


def reproject_plans(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with x and y in EPSG:3857 and ``ok``; a coordinate that cannot be projected stays as it was."""
    px, py = web_mercator(F.col(x), F.col(y))
    seen = points.select("*", px.alias("_px"), py.alias("_py"))
    ok = F.col("_px").isNotNull()
    return seen.withColumns({"ok": ok, x: F.when(ok, F.col("_px")).otherwise(F.col(x)), y: F.when(ok, F.col("_py")).otherwise(F.col(y))}).drop("_px", "_py")


def extent(nodes: DataFrame) -> DataFrame:
    """One row (minx, maxx, miny, maxy, corners); nulls if there are no nodes."""
    box = nodes.agg(F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"))
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return box.withColumn("corners", F.array(corner("minx", "miny"), corner("minx", "maxy"), corner("maxx", "maxy"), corner("maxx", "miny")))


def check_boundaries(acts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Activities (lon, lat in x, y) with projected px, py and ``inside`` the network's extent; null where there is no coordinate."""
    box = extent(nodes).drop("corners")
    px, py = web_mercator(F.col("x"), F.col("y"))
    # the box is one aggregated row
    joined = acts.select("*", px.alias("px"), py.alias("py")).join(F.broadcast(box))
    return joined.withColumn("inside", in_bounds(F.col("px"), F.col("py"), {c: F.col(c) for c in box.columns})).drop(*box.columns)


#: The index of zones is broadcast up to this number of edges of rings; with more, points and index are shuffled by cell.
MOST_EDGES = 1_000_000
#: The index's grid has one cell for so many edges, and no fewer cells than this.
EDGES_A_CELL, LEAST_CELLS = 8, 1024


@dataclass(frozen=True)
class Grid:
    """A grid over all zones: its lower left corner, its other corner, and the width and height of a cell."""

    x0: float
    y0: float
    x1: float
    y1: float
    width: float
    height: float

    def column(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.width)

    def row(self, y: Column) -> Column:
        return F.floor((y - self.y0) / self.height)

    def covers(self, x: Column, y: Column) -> Column:
        return x.between(self.x0, self.x1) & y.between(self.y0, self.y1)


def zone_edges(zones: DataFrame) -> DataFrame:
    """(zone, poly, ax, ay, bx, by, cx, cy): every edge a-b of ``zones`` (zone, polygons), and the end c of the edge after it.

    Points without a coordinate are left out of their ring, a ring that is open is closed, and one of fewer than three corners has no edges.
    """
    rings = zones.select("zone", F.posexplode("polygons").alias("poly", "rings")).select("zone", "poly", F.explode("rings").alias("ring"))
    whole = rings.withColumn("ring", F.filter("ring", lambda p: F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())).where("size(ring) > 2")
    first, last, n = F.get("ring", F.lit(0)), F.element_at("ring", -1), F.size("ring")
    closed = whole.withColumn("ring", F.when((first[0] == last[0]) & (first[1] == last[1]), F.col("ring")).otherwise(F.concat("ring", F.array(first)))).where("size(ring) > 3")
    three = F.arrays_zip(F.slice("ring", 1, n - 1).alias("a"), F.slice("ring", 2, n - 1).alias("b"), F.concat(F.slice("ring", 3, n - 2), F.slice("ring", 2, 1)).alias("c"))
    edges = closed.select("zone", "poly", F.explode(three).alias("e"))
    return edges.select("zone", "poly", *[F.col(f"e.{p}")[k].cast("double").alias(p + axis) for p in "abc" for k, axis in enumerate("xy")])


def zone_grid(edges: DataFrame) -> tuple[Grid | None, int]:
    """(grid, number of edges): cells are wide where edges are long across, and high where they are long upwards; None without edges."""
    up, across = F.abs(F.col("by") - F.col("ay")), F.abs(F.col("bx") - F.col("ax"))
    r = edges.agg(F.count("*").alias("n"), F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"), F.sum(across).alias("across"), F.sum(up).alias("up")).first()
    if not r["n"]:
        return None, 0
    wide, high = r["x1"] - r["x0"] or 1.0, r["y1"] - r["y0"] or 1.0
    cells = max(LEAST_CELLS, r["n"] // EDGES_A_CELL)
    # an edge meets about columns * across / wide + rows * up / high cells: both kinds should cost alike
    ratio = math.sqrt(max(r["up"] / high, 1e-9) / max(r["across"] / wide, 1e-9))
    columns = min(max(1.0, math.sqrt(cells) * ratio), float(cells))
    return Grid(r["x0"], r["y0"], r["x1"], r["y1"], wide / math.ceil(columns), high / math.ceil(cells / columns)), r["n"]


def _columns_met(grid: Grid, row: Column, a: str, b: str) -> tuple[Column, Column]:
    """First and last column of cells that the edge ``a``-``b`` meets in a row of cells, or comes very near to."""
    ax, ay, bx, by = (F.col(c) for c in (f"{a}x", f"{a}y", f"{b}x", f"{b}y"))
    # a little more than the row, so that rounding cannot hide a cell
    low, high = F.lit(grid.y0) + (row - 1e-6) * grid.height, F.lit(grid.y0) + (row + 1 + 1e-6) * grid.height
    at = lambda y: F.when(ay == by, ax).otherwise((bx - ax) * (y - ay) / F.when(ay != by, by - ay) + ax)
    one, two = at(F.greatest(F.least(ay, by), low)), F.when(ay == by, bx).otherwise(at(F.least(F.greatest(ay, by), high)))
    slack = F.lit(1e-6 * grid.width) + 1e-12 * F.abs(bx - ax)
    return grid.column(F.greatest(F.least(one, two) - slack, F.least(ax, bx) - slack)), grid.column(F.least(F.greatest(one, two) + slack, F.greatest(ax, bx) + slack))


def zone_index(edges: DataFrame, grid: Grid) -> DataFrame:
    """(cx, cy, near): for each cell of the grid that a polygon touches, (zone, poly, odd, levels, edges) of each such polygon, by zone.

    A ray from a point to the right is odd times in a polygon's rings if the point is inside. Of the edges that the ray can meet, a cell keeps only
    those that cross the cell (``edges``: ax, ay, bx, by of each in turn). Those further right are met if they span the point's height, so two
    figures stand for all of them: whether an odd number goes over the cell's top (``odd``), and the heights inside the cell's row
    at which this changes (``levels``), which are those of vertices of which only one edge lies further right.
    A cell inside of a polygon has ``odd`` and nothing else.
    """
    rows = edges.select("*", grid.row(F.col("ay")).alias("ra"), grid.row(F.col("by")).alias("rb"))
    spans = rows.select("zone", "poly", "ax", "ay", "bx", "by", F.greatest("ra", "rb").alias("top"), F.explode(F.sequence(F.least("ra", "rb"), F.greatest("ra", "rb"))).alias("cy"))
    first, last = _columns_met(grid, F.col("cy"), "a", "b")
    spans = spans.select("*", first.alias("first"), last.alias("last"))
    none, kind = F.lit(None), "double"
    crossing = spans.select("zone", "poly", F.explode(F.sequence("first", "last")).alias("cx"), "cy", F.lit(False).alias("odd"), none.cast(kind).alias("level"), F.array("ax", "ay", "bx", "by").alias("edge"))
    # columns left of an odd number of edges over the row's top: between each second and third of the places where edges begin, in order
    begins = spans.where("top > cy").groupBy("zone", "poly", "cy", "first").agg(F.count("*").alias("n")).where("n % 2 = 1")
    places = begins.groupBy("zone", "poly", "cy").agg(F.sort_array(F.collect_list("first")).alias("at"))
    pairs = places.select("zone", "poly", "cy", "at", F.explode(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2))).alias("k"))
    inside = pairs.select("zone", "poly", F.explode(F.sequence(F.get("at", F.col("k")), F.get("at", F.col("k") + 1) - 1)).alias("cx"), "cy", F.lit(True).alias("odd"), none.cast(kind).alias("level"), none.cast("array<double>").alias("edge"))
    before, after = _columns_met(grid, F.col("rb"), "a", "b")[0], _columns_met(grid, F.col("rb"), "b", "c")[0]
    turns = rows.select("zone", "poly", F.col("by").alias("level"), F.col("rb").alias("cy"), before.alias("p"), after.alias("q")).where("p != q")
    levels = turns.select("zone", "poly", F.explode(F.sequence(F.least("p", "q"), F.greatest("p", "q") - 1)).alias("cx"), "cy", F.lit(False).alias("odd"), "level", none.cast("array<double>").alias("edge"))
    # one shuffle by cell serves both steps
    facts = crossing.unionByName(inside).unionByName(levels).repartition("cx", "cy")
    by_polygon = facts.groupBy("cx", "cy", "zone", "poly").agg(F.max("odd").alias("odd"), F.collect_list("level").alias("levels"), F.flatten(F.collect_list("edge")).alias("edges"))
    return by_polygon.groupBy("cx", "cy").agg(F.sort_array(F.collect_list(F.struct("zone", "poly", "odd", "levels", "edges"))).alias("near"))


def _inside(near: Column, x: Column, y: Column) -> Column:
    """Whether the point is inside of this polygon of the cell's index."""
    edges = near["edges"]
    value = lambda k, j: F.get(edges, 4 * k + j)

    def meets(k: Column) -> Column:
        ax, ay, bx, by = (value(k, j) for j in range(4))
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay) + ax)

    numbers = F.when(F.size(edges) > 0, F.sequence(F.lit(0), (F.size(edges) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    crossed = F.aggregate(numbers, near["odd"], lambda odd, k: odd != F.coalesce(meets(k), F.lit(False)))
    return F.aggregate(near["levels"], crossed, lambda odd, level: odd != (level > y))


def assign_zone(points: DataFrame, zones: DataFrame) -> DataFrame:
    """``points`` (x, y) with ``zone``, null outside of all; of overlapping zones, the first by name. A column zone is replaced.

    ``zones``: zone, polygons (MultiPolygon coordinates; rings as in ``zone_edges``). Every point meets one row of ``zone_index``, with the few edges that
    cross its cell, and gets what ``point_in_polygons`` says. Up to ``MOST_EDGES`` edges the index is broadcast and points stay
    where they are; a larger one is joined by cell.
    """
    names = [c for c in points.columns if c != "zone"]
    edges = checkpointed(zone_edges(zones))
    grid, size = zone_grid(edges)
    if grid is None:
        return points.select(*names, F.lit(None).cast(zones.schema["zone"].dataType).alias("zone"))
    at = lambda cell, c: F.when(grid.covers(F.col("x"), F.col("y")), cell(F.col(c)))
    held = points.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    held = held.select("*", at(grid.column, "x").alias("cx"), at(grid.row, "y").alias("cy"))
    index = zone_index(edges, grid)
    found = F.filter("near", lambda z: _inside(z, F.col("x"), F.col("y")))
    placed = held.join(F.broadcast(index) if size <= MOST_EDGES else index, ["cx", "cy"], "left")
    return placed.select(*[F.col(f"row.`{c}`") for c in names], F.get(found, F.lit(0))["zone"].alias("zone"))


def activity_windows(acts: DataFrame, params: DataFrame) -> DataFrame:
    """Activities (type, start_s, end_s) against their type's times: wait_s, performed_s, late_s, short_s.

    Waiting is before opening, performing inside opening and closing, late is after the latest start, short what performing lacks to the
    typical duration. A missing bound is no bound. ``params`` has a row for each activity type of the configuration.
    """
    joined = acts.join(F.broadcast(params.withColumnRenamed("activity_type", "type")), "type", "left")
    start = F.greatest("start_s", F.coalesce("opening_s", "start_s"))
    end = F.least("end_s", F.coalesce("closing_s", "end_s"))
    performed = F.greatest(F.lit(0), end - start)
    return joined.select(
        *acts.columns,
        F.greatest(F.lit(0), F.least("end_s", F.coalesce("opening_s", "start_s")) - F.col("start_s")).alias("wait_s"),
        performed.alias("performed_s"),
        F.greatest(F.lit(0), F.col("start_s") - F.coalesce("latest_start_s", "start_s")).alias("late_s"),
        F.greatest(F.lit(0), F.coalesce("typical_s", F.lit(0)) - performed).alias("short_s"),
    )
