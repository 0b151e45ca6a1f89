"""Distances, rings and cells as columns (MATH-*, GEO-1, GEO-3, GEO-5, FLT-1). Metres, degrees, WGS 84.

Neither the antimeridian nor the poles are supported. A point on an edge follows the half-open rule of ray casting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.text import let, text

EARTH = 6_371_000
LON_M, LAT_M = 111_320, 110_540
#: Least and greatest latitude, least and greatest longitude of the registry's country.
COUNTRY = (35.0, 43.0, 25.0, 45.0)


def in_bounds(lat, lon, box: tuple[float, float, float, float] = COUNTRY) -> Column:
    """Finite and inside the box; null coordinates are not."""
    lat, lon = text(lat), text(lon)
    inside = lat.between(box[0], box[1]) & lon.between(box[2], box[3]) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(inside, F.lit(False))


def in_viewport(lat, lon, south: float, north: float, west: float, east: float, box=COUNTRY) -> Column:
    """Inside the viewport after clamping it to the country."""
    return text(lat).between(max(south, box[0]), min(north, box[1])) & text(lon).between(max(west, box[2]), min(east, box[3]))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(text(lat1)), F.radians(text(lat2))
    dlat, dlon = p2 - p1, F.radians(text(lon2)) - F.radians(text(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def cosine_m(lat1, lon1, lat2, lon2) -> Column:
    """Law of cosines, as used for the 200 m check."""
    p1, p2 = F.radians(text(lat1)), F.radians(text(lat2))
    c = F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(F.radians(text(lon2)) - F.radians(text(lon1)))
    return EARTH * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def segment_distance_m(lon, lat, x1, y1, x2, y2) -> Column:
    """Distance of a point to a segment on the plane that touches the earth at the point."""
    return segment_distance_at(LON_M * F.cos(F.radians(text(lat))), lon, lat, x1, y1, x2, y2)


def segment_distance_at(kx: Column, lon, lat, x1, y1, x2, y2) -> Column:
    """The same where a degree of longitude has ``kx`` metres; it grows with ``kx``."""
    ax, ay = (text(x1) - text(lon)) * kx, (text(y1) - text(lat)) * LAT_M
    bx, by = (text(x2) - text(lon)) * kx, (text(y2) - text(lat)) * LAT_M
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size)))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def crosses(lon, lat, x1, y1, x2, y2) -> Column:
    """Whether the ray east of the point crosses the edge."""
    lon, lat, x1, y1, x2, y2 = map(text, (lon, lat, x1, y1, x2, y2))
    spans = (y1 > lat) != (y2 > lat)
    return spans & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)


def _edges(ring: Column) -> Column:
    """array<struct<x1, y1, x2, y2>> of a ring of [x, y] points."""
    return let(ring, _ring_edges)


def _ring_edges(ring: Column) -> Column:
    n = F.size(ring)
    at = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        at,
        lambda i: F.struct(
            F.get(F.get(ring, i), F.lit(0)).alias("x1"), F.get(F.get(ring, i), F.lit(1)).alias("y1"),
            F.get(F.get(ring, i + 1), F.lit(0)).alias("x2"), F.get(F.get(ring, i + 1), F.lit(1)).alias("y2"),
        ),
    )


def in_rings_even_odd(lon, lat, rings) -> Column:
    """Inside by the even-odd rule over all rings (closed arrays of [x, y])."""
    edges = F.flatten(F.transform(text(rings), _edges))

    def odd(p: Column) -> Column:
        return F.size(F.filter(p["edges"], lambda e: crosses(p["lon"], p["lat"], e["x1"], e["y1"], e["x2"], e["y2"]))) % 2 == 1

    return let(F.struct(text(lon).alias("lon"), text(lat).alias("lat"), edges.alias("edges")), odd)


def ring_area(ring) -> Column:
    """Signed area in square degrees."""
    return _edges_area(_edges(text(ring)))


def _edges_area(edges: Column) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def ring_centroid(ring) -> Column:
    """struct<lon, lat>; null for a ring without area."""

    def moment(edges: Column, k: str) -> Column:
        return F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e[k + "1"] + e[k + "2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"]))

    def centre(p: Column) -> Column:
        return F.when(p["a"] != 0, F.struct((moment(p["edges"], "x") / (6 * p["a"])).alias("lon"), (moment(p["edges"], "y") / (6 * p["a"])).alias("lat")))

    return let(_edges(text(ring)), lambda edges: let(F.struct(edges.alias("edges"), _edges_area(edges).alias("a")), centre))


def bbox(polys) -> Column:
    """struct<west, south, east, north> of nested coordinates."""

    def edges(points: Column) -> Column:
        xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
        return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))

    return let(F.flatten(F.flatten(text(polys))), edges)


def cell(lat, lon, size: float) -> Column:
    return F.concat_ws(":", F.floor(text(lon) / size).cast("string"), F.floor(text(lat) / size).cast("string"))


def tile_key(lat, lon) -> Column:
    """Boundary tile of a quarter degree, as column-row."""
    return F.concat_ws("-", F.floor(text(lon) / 0.25).cast("string"), F.floor(text(lat) / 0.25).cast("string"))


def lat_step(metres: float) -> float:
    """Degrees of latitude that are at least so many metres."""
    return metres / 110_000


def lon_step(metres: float, most_lat: float = COUNTRY[1]) -> float:
    """Degrees of longitude that are at least so many metres up to a latitude."""
    return metres / (110_000 * math.cos(math.radians(most_lat)))
