"""Column functions: map projection, times of day, labels, count errors, points in rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857 metres of WGS84 degrees; null where a coordinate is null or the latitude is not below 90."""
    ok = lon.isNotNull() & lat.isNotNull() & (F.abs(lat) < 90)
    y = EARTH_RADIUS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return F.when(ok, EARTH_RADIUS * F.radians(lon)), F.when(ok, y)


def in_bounds(x: Column, y: Column, box: dict[str, Column]) -> Column:
    """Whether a point lies in ``box`` (minx, maxx, miny, maxy), borders included; null if a value is."""
    return x.between(box["minx"], box["maxx"]) & y.between(box["miny"], box["maxy"])


def hms_to_s(text: Column) -> Column:
    """Seconds of ``HH:MM:SS`` or ``HH:MM``, hours over 24 allowed; null for empty, ``undefined`` and anything else."""
    part = lambda k: F.regexp_extract(text, r"^(\d+):([0-5]\d)(?::([0-5]\d))?$", k)
    seconds = F.when(part(3) == "", 0).otherwise(F.expr("0") + part(3).try_cast("int"))
    return F.when(text.rlike(r"^\d+:[0-5]\d(:[0-5]\d)?$"), part(1).try_cast("int") * 3600 + part(2).try_cast("int") * 60 + seconds).cast("int")


def s_to_hms(seconds: Column) -> Column:
    """``HH:MM:SS`` of seconds, fractions cut off."""
    whole = F.floor(seconds)
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60))


def label(columns: list[str], separator: str = " | ") -> Column:
    """The columns' values joined for reading."""
    return F.concat_ws(separator, *columns)


def count_errors(simulated: Column, observed: Column) -> dict[str, Column]:
    """Relative error in percent, normalised relative error, and GEH.

    The first is null where nothing was observed; the others are 0 where both are 0.
    """
    both = simulated + observed
    most = F.greatest(simulated, observed)
    return {
        "relative_error": F.when(observed != 0, 100 * (simulated - observed) / observed),
        "normalized_error": F.when(most == 0, 0.0).otherwise(F.abs(simulated - observed) / most),
        "geh": F.when(both == 0, 0.0).otherwise(F.sqrt(2 * (simulated - observed) * (simulated - observed) / both)),
    }


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point and a closed ring, ``array<array<double>>`` of x and y."""

    def crosses(k: Column) -> Column:
        a, b = F.get(ring, k), F.get(ring, k + 1)
        ax, ay, bx, by = F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1))
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay) + ax)

    edges = F.sequence(F.lit(0), F.size(ring) - 2)
    odd = F.aggregate(edges, F.lit(False), lambda acc, k: acc != F.coalesce(crosses(k), F.lit(False)))
    return F.when(x.isNotNull() & y.isNotNull(), (F.size(ring) > 3) & odd)


def point_in_polygons(x: Column, y: Column, polygons: Column) -> Column:
    """A point in any polygon of a MultiPolygon; the rings of one polygon exclude each other, so holes are out."""
    inside = lambda rings: F.aggregate(rings, F.lit(False), lambda acc, r: acc != F.coalesce(point_in_ring(x, y, r), F.lit(False)))
    return F.when(x.isNotNull() & y.isNotNull(), F.exists(polygons, inside))
