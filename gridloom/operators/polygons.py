"""Polygons: cleaning, surface points, pair relations, cluster shapes (FLT-16, GEO-2, GEO-4, SPJ-13..15, SPJ-22, GRF-2..7).

A polygon column is array<parts<rings<[lon, lat]>>>. Per-pair and per-polygon geometry that expressions can't say runs in
Arrow-batched pandas functions on rows that joins have already narrowed down.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.geo import LAT_M, LON_M, bbox, haversine_m, ring_area
from gridloom.functions.names import has_evidence, name_relationship, parse_name
from gridloom.functions.session import checkpoint_root, dealt, saved
from gridloom.functions.text import let, name_key, text
from gridloom.operators.cover import box_pairs, with_box
from gridloom.operators.graph import star_components



def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


NUMBER, FLAG = T.DoubleType(), T.BooleanType()
TOUCH_M = 0.5
#: By how much rounding may make a bound of a distance exceed it.
MARGIN_M = 0.01
#: Shapes that a task keeps while it goes through pairs; those of one shape come one after the other.
SHAPES_HELD = 256
#: Edges measured against points at a time.
EDGES_HELD = 200_000


def clean_geometry(polys) -> Column:
    """Rings at six digits without repeated points; null if any ring is open, has a coordinate that isn't finite, under
    three different points, or no area. A bad hole rejects the whole, it is never filled."""

    def number(p: Column, k: int) -> Column:
        return F.round(F.get(p, F.lit(k)), 6)

    def tidy(ring: Column) -> Column:
        return let(F.transform(ring, lambda p: F.array(number(p, 0), number(p, 1))), lambda pts: F.filter(pts, lambda p, i: (i == 0) | (p != F.get(pts, i - 1))))

    def sound(ring: Column) -> Column:
        raw = F.forall(ring, lambda p: F.coalesce((F.size(p) >= 2) & ~F.isnan(F.get(p, F.lit(0))) & ~F.isnan(F.get(p, F.lit(1))) & (F.abs(F.get(p, F.lit(0))) <= 180) & (F.abs(F.get(p, F.lit(1))) <= 90), F.lit(False)))
        whole = lambda t: (F.get(t, F.lit(0)) == F.element_at(t, -1)) & (F.size(F.array_distinct(t)) >= 3) & (F.abs(ring_area(t)) > 0)
        return F.coalesce(raw & (F.size(ring) >= 4) & let(tidy(ring), whole), F.lit(False))

    def cleaned(polys: Column) -> Column:
        good = (F.size(polys) > 0) & F.forall(polys, lambda poly: (F.size(poly) > 0) & F.forall(poly, sound))
        return F.when(good, F.transform(polys, lambda poly: F.transform(poly, tidy)))

    return let(text(polys), cleaned)


def _parts(polys) -> list[list[np.ndarray]]:
    return [[np.array([list(p) for p in ring], float) for ring in part] for part in polys]


def _area(ring: np.ndarray) -> float:
    """Signed, from the first point: products of whole coordinates would lose half the digits of a small ring."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


def inside(points: np.ndarray, parts) -> np.ndarray:
    """Which points lie in the polygon: odd crossings over the rings of a part."""
    hit = np.zeros(len(points), bool)
    px, py = points[:, :1], points[:, 1:]
    for part in parts:
        odd = np.zeros(len(points), int)
        for ring in part:
            x1, y1, x2, y2 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
            spans = (y1 > py) != (y2 > py)
            with np.errstate(divide="ignore", invalid="ignore"):
                odd += (spans & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)).sum(axis=1)
        hit |= odd % 2 == 1
    return hit


def surface_point(polys) -> tuple[float, float] | None:
    """A point inside the largest part: its centroid, else its box's centre, else the middle of the widest inner span
    among evenly spaced scan lines."""
    parts = _parts(polys)
    if not parts:
        return None
    part = max(parts, key=lambda p: abs(_area(p[0])))
    ring = part[0]
    a = _area(ring)
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    cross = x[:-1] * y[1:] - x[1:] * y[:-1]
    tries = []
    if a:
        tries.append((ring[0, 0] + float(((x[:-1] + x[1:]) * cross).sum() / (6 * a)), ring[0, 1] + float(((y[:-1] + y[1:]) * cross).sum() / (6 * a))))
    tries.append(((ring[:, 0].min() + ring[:, 0].max()) / 2, (ring[:, 1].min() + ring[:, 1].max()) / 2))
    for t in tries:
        if inside(np.array([t]), [part])[0]:
            return t
    low, high = ring[:, 1].min(), ring[:, 1].max()
    best = None
    for k in range(1, 80):
        lat = low + (high - low) * k / 80
        cuts = []
        for r in part:
            x1, y1, x2, y2 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
            s = (y1 > lat) != (y2 > lat)
            cuts.extend(((x2 - x1)[s] * (lat - y1[s]) / (y2 - y1)[s] + x1[s]).tolist())
        cuts.sort()
        for west, east in zip(cuts[::2], cuts[1::2]):
            if best is None or east - west > best[0]:
                best = east - west, ((west + east) / 2, lat)
    return best[1] if best else None


# Polygons go to Python as JSON text: rings nest too deep for nulls to pass through Arrow safely.


@F.pandas_udf(_struct(lon=NUMBER, lat=NUMBER))
def _surface(polys: pd.Series) -> pd.DataFrame:
    found = [surface_point(json.loads(p)) if p is not None else None for p in polys]
    return pd.DataFrame([f or (None, None) for f in found], columns=["lon", "lat"])


def point_on_surface(polys) -> Column:
    """polys -> struct<lon, lat>; null fields where there is none."""
    return _surface(F.to_json(text(polys)))


def _point_gap(points: np.ndarray, segments: np.ndarray) -> float:
    a, d = segments[:, :2], segments[:, 2:] - segments[:, :2]
    size = np.maximum((d * d).sum(axis=1), 1e-12)
    least = np.inf
    for at in range(0, len(points), 512):
        v = points[at : at + 512, None, :] - a[None]
        t = np.clip((v * d[None]).sum(axis=2) / size, 0, 1)
        least = min(least, float(np.sqrt(((v - t[..., None] * d[None]) ** 2).sum(axis=2).min())))
    return least


def _cross(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether any two segments properly cross."""

    def side(a, b, c):
        return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])

    for at in range(0, len(p), 256):
        a, b = p[at : at + 256, None, :2], p[at : at + 256, None, 2:]
        c, d = q[None, :, :2], q[None, :, 2:]
        split = side(a, b, c) * side(a, b, d) < 0
        if split.any() and (split & (side(c, d, a) * side(c, d, b) < 0)).any():
            return True
    return False


class _Shape:
    """A polygon's rings, edges and box; its sample points are found when first asked for."""

    def __init__(self, polys, samples: int = 30):
        self.parts, self.samples, self._mine, self._some = _parts(polys), samples, None, None
        self.edges = np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for part in self.parts for r in part])
        self.low, self.high = self.edges[:, :2].min(axis=0), self.edges[:, :2].max(axis=0)

    def _sampled(self, rows: slice) -> np.ndarray:
        ring = np.concatenate([p[0] for p in self.parts])
        (west, south), (east, north) = ring.min(axis=0), ring.max(axis=0)
        step = (np.arange(self.samples) + 0.5) / self.samples
        grid = np.stack(np.meshgrid(west + (east - west) * step, (south + (north - south) * step)[rows]), axis=-1).reshape(-1, 2)
        return grid[inside(grid, self.parts)]

    def mine(self) -> np.ndarray:
        if self._mine is None:
            self._mine = self._sampled(slice(None))
        return self._mine

    def some_in(self, other: _Shape) -> bool:
        """Whether one of the middle row's sample points lies in the other; if not, others may."""
        if self._some is None:
            self._some = self._sampled(slice(self.samples // 2, self.samples // 2 + 1))
        return bool(len(self._some)) and bool(inside(self._some, other.parts).any())

    def corner_in(self, other: _Shape) -> bool:
        corners = self.edges[:, :2]
        near = corners[((corners >= other.low) & (corners <= other.high)).all(axis=1)]
        return bool(len(near)) and bool(inside(near, other.parts).any())

    def share(self, other: _Shape) -> float:
        """Of the sample points, how many lie in the other; only those in its box can."""
        mine = self.mine()
        near = mine[((mine >= other.low) & (mine <= other.high)).all(axis=1)]
        return float(inside(near, other.parts).sum() / len(mine)) if len(near) else 0.0


def relation_of(a, b, samples: int = 30) -> dict:
    """Relation of two polygons: crossing or sampled overlap means intersects; gap in metres; shares of sampled points of
    each that lie in the other; within at 98 %."""
    return _related(_Shape(a, samples), _Shape(b, samples))


def _related(a: _Shape, b: _Shape) -> dict:
    k = np.array([LON_M * np.cos(np.radians(a.parts[0][0][0, 1])), LAT_M] * 2)
    sa, sb = a.edges * k, b.edges * k
    fa = fb = 0.0
    crossing = False
    if (a.low <= b.high).all() and (b.low <= a.high).all():  # else they have nothing in common
        fa, fb, crossing = a.share(b), b.share(a), _cross(sa, sb)
    meets = crossing or fa > 0 or fb > 0
    gap = 0.0 if meets else min(_point_gap(sa[:, :2], sb), _point_gap(sb[:, :2], sa))
    return {
        "intersects": meets, "crossing": crossing, "touches": not meets and gap <= TOUCH_M, "boundary_gap_m": round(gap, 3),
        "overlap_fraction_a": fa, "overlap_fraction_b": fb, "a_within_b": fa >= 0.98, "b_within_a": fb >= 0.98,
    }


def _gap(a: _Shape, b: _Shape) -> float:
    """``boundary_gap_m`` of ``_related`` alone: shapes that cross need no sample points, nor do shapes whose boundaries are
    apart if neither has a corner in the other, and one sample point in the other is enough."""
    k = np.array([LON_M * np.cos(np.radians(a.parts[0][0][0, 1])), LAT_M] * 2)
    sa, sb = a.edges * k, b.edges * k
    if not ((a.low <= b.high).all() and (b.low <= a.high).all()):  # nothing in common
        return round(min(_point_gap(sa[:, :2], sb), _point_gap(sb[:, :2], sa)), 3)
    if _cross(sa, sb):
        return 0.0
    held = a.corner_in(b) or b.corner_in(a)
    if held and (a.some_in(b) or b.some_in(a)):
        return 0.0
    gap = round(min(_point_gap(sa[:, :2], sb), _point_gap(sb[:, :2], sa)), 3)
    return 0.0 if (held or gap == 0) and (a.share(b) > 0 or b.share(a) > 0) else gap


RELATION = _struct(
    intersects=FLAG, crossing=FLAG, touches=FLAG, boundary_gap_m=NUMBER, overlap_fraction_a=NUMBER, overlap_fraction_b=NUMBER, a_within_b=FLAG, b_within_a=FLAG
)


@F.pandas_udf(RELATION)
def _relation(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    none = (None,) * len(RELATION.names)
    shape = lru_cache(SHAPES_HELD)(lambda p: _Shape(json.loads(p)))
    return pd.DataFrame([tuple(_related(shape(x), shape(y)).values()) if x is not None and y is not None else none for x, y in zip(a, b)], columns=RELATION.names)


# else a filter on what it tells would be evaluated below the projection, and everything measured twice
_relation = _relation.asNondeterministic()


def polygon_relation(a, b) -> Column:
    """struct of ``relation_of`` for two polygon columns; null fields if either is null."""
    return _relation(F.to_json(text(a)), F.to_json(text(b)))


@F.pandas_udf(NUMBER)
def _polygon_gap(a: pd.Series, b: pd.Series) -> pd.Series:
    shape = lru_cache(SHAPES_HELD)(lambda p: _Shape(json.loads(p)))
    return pd.Series([_gap(shape(x), shape(y)) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


_polygon_gap = _polygon_gap.asNondeterministic()  # as _relation


def polygon_gap_m(a, b) -> Column:
    """``boundary_gap_m`` of ``polygon_relation`` alone."""
    return _polygon_gap(F.to_json(text(a)), F.to_json(text(b)))


def near_pairs(records: DataFrame, metres: float, by: list[str] | None = None) -> DataFrame:
    """Pairs (a, b: structs of the records, a.id < b.id) whose boxes come within a distance; records without ``polys`` count
    as their points. Only ids and boxes are moved to find them. Pairs are dealt to all cores, whatever their bytes: what is
    measured on them costs time, not space."""
    pairs = box_pairs(with_box(records), metres, by=by)
    row = F.struct(*records.columns)
    side = lambda name: records.select(F.col("id").alias(f"_{name}"), row.alias(name))
    met = pairs.toDF("_a", "_b").join(side("a"), "_a").join(side("b"), "_b")
    return dealt(met, F.col("_a"), F.pmod(F.xxhash64("_b"), F.lit(16))).sortWithinPartitions("_a").select("a", "b")


def pair_evidence(records: DataFrame, gap_m: float = 1000) -> DataFrame:
    """(a, b, relation fields, same_name_key, name_evidence, same_district) of records (id, name, district, latitude,
    longitude, polys) whose boundaries are within ``gap_m``, however far apart their points are. ``same_district`` is null
    where a district is unknown."""
    parsed = records.where("polys is not null").select("id", "latitude", "longitude", "district", "polys", parse_name("name").alias("parsed"))
    pairs = near_pairs(saved(parsed, "evidence-parsed"), gap_m).withColumn("r", polygon_relation("a.polys", "b.polys")).where(F.col("r.boundary_gap_m") <= gap_m)
    evidence = has_evidence(name_relationship(F.col("a.parsed"), F.col("b.parsed")))
    same_key = F.col("a.parsed.key") == F.col("b.parsed.key")
    district = F.nullif("a.district", F.lit("")) == F.nullif("b.district", F.lit(""))
    # named apart first: an alias a or b would hide the structs
    told = pairs.select(F.col("a.id").alias("_a"), F.col("b.id").alias("_b"), "r.*", same_key.alias("same_name_key"), evidence.alias("name_evidence"), district.alias("same_district"))
    return told.withColumnsRenamed({"_a": "a", "_b": "b"})


def effective_distance(point_m: Column, source_polys: Column, park_polys: Column, gap: Column, to_source: Column, to_park: Column, adjacent_m: float = 15) -> Column:
    """struct<distance_m, relation>: polygon gap, point to polygon, or point distance, whatever the two sides have."""
    d = F.when(source_polys.isNotNull() & park_polys.isNotNull(), gap).when(source_polys.isNotNull(), to_source).when(park_polys.isNotNull(), to_park).otherwise(point_m)
    flat = source_polys.isNull() & park_polys.isNull()
    relation = F.when(flat, "POINT_DISTANCE").when(d == 0, "OVERLAP").when(d <= adjacent_m, "ADJACENT").otherwise("GAP")
    return F.struct(d.alias("distance_m"), relation.alias("relation"))


def _first_lat(polys: Column) -> Column:
    return F.get(F.get(F.get(F.get(polys, F.lit(0)), F.lit(0)), F.lit(0)), F.lit(1))


def shape_facts(polys: str = "polys") -> list[Column]:
    """What ``least_gap_m`` needs to know of polygons besides their box: columns ``shaped`` and ``first_lat``."""
    return [F.col(polys).isNotNull().alias("shaped"), _first_lat(F.col(polys)).alias("first_lat")]


def least_gap_m(a: str, b: str, point_m: Column, facts: bool = False) -> Column:
    """No more than the distance of ``effective_distance`` for two structs with a ``box``, from the boxes alone and on the
    same plane. Null or NaN where a box is. ``facts``: the structs have ``shape_facts`` instead of polygons."""
    at = lambda side, name: F.col(f"{side}.{name}")
    shaped = lambda side: at(side, "shaped") if facts else at(side, "polys").isNotNull()
    of_a, of_b = shaped(a), shaped(b)
    first = at(a, "first_lat") if facts else _first_lat(at(a, "polys"))
    lat = F.when(of_a & of_b, first).when(of_a, at(b, "latitude")).otherwise(at(a, "latitude"))
    apart = lambda low, high: F.greatest(F.lit(0.0), at(a, f"box.{low}") - at(b, f"box.{high}"), at(b, f"box.{low}") - at(a, f"box.{high}"))
    planar = F.hypot(apart("west", "east") * F.cos(F.radians(lat)) * LON_M, apart("south", "north") * LAT_M)
    return F.when(of_a | of_b, planar).otherwise(point_m)


@F.pandas_udf(NUMBER)
def _point_polygon(lon: pd.Series, lat: pd.Series, polys: pd.Series) -> pd.Series:
    x, y = lon.to_numpy(float), lat.to_numpy(float)
    out = np.full(len(polys), np.nan)
    rows: list[int] = []  # of the parts that wait to be measured
    counts: list[int] = []
    low: list[list[float]] = []
    high: list[list[float]] = []
    for i, p in enumerate(polys):
        for part in json.loads(p) if p is not None else ():
            before = len(low)
            for ring in part:
                low.extend(ring[:-1])
                high.extend(ring[1:])
            if len(low) > before:
                rows.append(i)
                counts.append(len(low) - before)
        if len(low) >= EDGES_HELD:
            _measure(x, y, rows, counts, low, high, out)
            for waiting in (rows, counts, low, high):
                waiting.clear()
    if rows:
        _measure(x, y, rows, counts, low, high, out)
    return pd.Series(out)


def _measure(x: np.ndarray, y: np.ndarray, rows: list[int], counts: list[int], low: list, high: list, out: np.ndarray) -> None:
    """Sets the metres from points to polygons, whose parts' edges follow each other: 0 if some part holds the point."""
    at = np.repeat(rows, counts)
    starts = np.cumsum(counts) - counts
    a, b, px, py = np.array(low, float), np.array(high, float), x[at], y[at]
    spans = (a[:, 1] > py) != (b[:, 1] > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        odd = np.add.reduceat((spans & (px < (b[:, 0] - a[:, 0]) * (py - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])).astype(int), starts) % 2 == 1
    k = LON_M * np.cos(np.radians(py))
    dx, dy = b[:, 0] * k - a[:, 0] * k, b[:, 1] * LAT_M - a[:, 1] * LAT_M
    vx, vy = px * k - a[:, 0] * k, py * LAT_M - a[:, 1] * LAT_M
    t = np.clip((vx * dx + vy * dy) / np.maximum(dx * dx + dy * dy, 1e-12), 0, 1)
    gap = np.where(odd, 0.0, np.minimum.reduceat(np.sqrt((vx - t * dx) ** 2 + (vy - t * dy) ** 2), starts))
    np.fmin.at(out, np.array(rows), gap)


_point_polygon = _point_polygon.asNondeterministic()  # as _relation


def point_polygon_m(lon, lat, polys) -> Column:
    """Metres from a point to a polygon, 0 inside; null without a polygon."""
    return _point_polygon(text(lon), text(lat), F.to_json(text(polys)))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points, counterclockwise from the leftmost."""
    rows = sorted(set(map(tuple, points.tolist())))
    if len(rows) < 3:
        return np.array(rows, float).reshape(-1, 2)

    def chain(rows: list) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(rows) + chain(rows[::-1]))


def extent(corners: np.ndarray) -> float:
    """The greatest distance between corners of a convex hull: calipers go around it once."""
    n = len(corners)
    if n < 2:
        return 0.0
    if n == 2:
        return float(np.hypot(*(corners[0] - corners[1])))
    p, far, k = corners.tolist(), 0.0, 1
    twice = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    for i in range(n):
        a, b = p[i], p[(i + 1) % n]
        while twice(a, b, p[(k + 1) % n]) > twice(a, b, p[k]):
            k = (k + 1) % n
        for q in (p[k], p[(k + 1) % n]):
            far = max(far, np.hypot(a[0] - q[0], a[1] - q[1]), np.hypot(b[0] - q[0], b[1] - q[1]))
    return float(far)


@F.pandas_udf(_struct(area=NUMBER, lat=NUMBER, x=T.ArrayType(NUMBER), y=T.ArrayType(NUMBER)))
def _outlines(polys: pd.Series) -> pd.DataFrame:
    """Area in square degrees, latitude of the first point, and the hull of the outer rings."""
    rows = []
    for parts in map(_parts, map(json.loads, polys)):
        corners = hull(np.concatenate([part[0][:-1] for part in parts]))
        rows.append((sum((1 if i == 0 else -1) * abs(_area(r)) for part in parts for i, r in enumerate(part)), parts[0][0][0, 1], corners[:, 0].tolist(), corners[:, 1].tolist()))
    return pd.DataFrame(rows, columns=["area", "lat", "x", "y"])


def _merged_hulls(outlines: DataFrame, key: str, most: int = 20_000) -> DataFrame:
    """(key, x, y): the hull of each key's hulls. Tasks merge what they read before it is dealt by key, and hold at most some
    ``most`` points besides hulls."""
    kind = dict(outlines.dtypes)[key]

    def rows_of(found: dict) -> pa.RecordBatch:
        columns = [pa.array(list(found)), *(pa.array([h[:, k].tolist() for h in found.values()], pa.list_(pa.float64())) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, [key, "x", "y"])

    def run(batches):
        held: dict = {}
        waiting: dict[object, list] = {}
        points = 0

        def settle() -> None:
            for k, more in waiting.items():
                held[k] = hull(np.concatenate([*([held[k]] if k in held else []), *more]))
            waiting.clear()

        for batch in batches:
            for k, x, y in zip(*(batch.column(c).to_pylist() for c in (key, "x", "y"))):
                waiting.setdefault(k, []).append(np.column_stack([x, y]))
                points += len(x)
                if points >= most:
                    settle()
                    points = sum(map(len, held.values()))
                    if points >= most // 2:  # of several keys: hand on all but the last
                        own = held.pop(k)
                        if held:
                            yield rows_of(held)
                        held, points = {k: own}, 0
        settle()
        if held:
            yield rows_of(held)

    schema = f"{key} {kind}, x array<double>, y array<double>"
    some = outlines.select(key, "x", "y").mapInArrow(run, schema)
    return dealt(some, key).sortWithinPartitions(key).mapInArrow(run, schema)


@F.pandas_udf(NUMBER)
def _extents(x: pd.Series, y: pd.Series, lat: pd.Series) -> pd.Series:
    return pd.Series([extent(hull(np.column_stack([a, b])) * [LON_M * np.cos(np.radians(at)), LAT_M]) for a, b, at in zip(x, y, lat)], dtype="float64")


def shape_metrics(records: DataFrame, key: str = "component", linear_below: float = 0.01, path_width_m: float = 8) -> DataFrame:
    """(component, area_m2, max_extent_m, compactness, mean_width_m, linear, path_like) of clusters of polygons, on the plane
    at the first point of the member with the least id. Only hulls are merged: stretching the plane keeps them hulls, and the
    farthest points of a set are corners of its hull."""
    shapes = dealt(records.where("polys is not null").select(key, "id", "polys"), key, "id")
    outlines = shapes.select(key, "id", _outlines(F.to_json("polys")).alias("o")).select(key, "id", "o.*")
    outlines = saved(outlines, "outlines")
    sums = outlines.groupBy(key).agg(F.sum("area").alias("area"), F.min_by("lat", "id").alias("lat"))
    # a key's two hulls at most: a merge that handed on is followed by one of the rest
    hulls = _merged_hulls(outlines, key).groupBy(key).agg(F.flatten(F.collect_list("x")).alias("x"), F.flatten(F.collect_list("y")).alias("y"))
    shaped = sums.join(hulls, key).select(
        key, (F.col("area") * F.cos(F.radians("lat")) * LON_M * LAT_M).alias("area_m2"), _extents("x", "y", "lat").alias("max_extent_m")
    )
    long = F.col("max_extent_m")
    shaped = shaped.withColumn("compactness", F.when(long > 0, F.col("area_m2") / (long * long)).otherwise(1.0)).withColumn("mean_width_m", F.when(long > 0, F.col("area_m2") / long).otherwise(0.0))
    linear = F.col("compactness") < linear_below
    return shaped.withColumn("linear", linear).withColumn("path_like", linear & (F.col("mean_width_m") < path_width_m))


def attach_polygons(parks: DataFrame, polygons: DataFrame) -> DataFrame:
    """Parks with the polygon of their numeric OSM id; one that contains the park's point is preferred."""
    digits = lambda c: F.regexp_extract(c, r"(\d+)$", 1)
    pairs = parks.withColumn("_n", digits("osm_id")).join(polygons.select(digits("osm_id").alias("_n"), "polys", F.col("osm_id").alias("_pid")), "_n", "left")
    hit = F.coalesce(point_polygon_m("longitude", "latitude", "polys") == 0, F.lit(False))
    ranked = pairs.withColumn("_in", hit).withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_in"), "_pid")))
    return ranked.where("_r = 1").drop("_n", "_pid", "_in", "_r")


def classify_edges(pairs: DataFrame, strict: DataFrame, link_m: float = 20, strict_link_m: float = 5, gray_m: float = 40, overlap: float = 0.5) -> DataFrame:
    """Pairs with ``edge``: link, gray, conflict or null. ``strict``: ids with generic or district-only names."""
    s = strict.select("id").distinct().withColumn("_s", F.lit(True))
    marked = pairs.join(s.select(F.col("id").alias("a"), F.col("_s").alias("_sa")), "a", "left").join(s.select(F.col("id").alias("b"), F.col("_s").alias("_sb")), "b", "left")
    limit = F.when(F.col("_sa").isNotNull() | F.col("_sb").isNotNull(), strict_link_m).otherwise(link_m)
    near = F.col("intersects") | F.col("touches") | (F.col("boundary_gap_m") <= limit)
    edge = (
        F.when(~F.col("same_district"), None)
        .when(~F.col("name_evidence"), F.when(F.greatest("overlap_fraction_a", "overlap_fraction_b") >= overlap, "conflict"))
        .when(near, "link").when(F.col("boundary_gap_m") <= gray_m, "gray")
    )
    return marked.withColumn("edge", edge).drop("_sa", "_sb")


def connected_components(vertices: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, component) for every vertex; component is the least id of it. The id column may have any name."""
    found = star_components(edges.select("a", "b")).toDF("__node", "__component")
    return vertices.select(id_col).join(found, F.col(id_col) == F.col("__node"), "left").select(id_col, F.coalesce("__component", id_col).alias("component"))


def component_groups(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, group_id, group_class): components joined by gray edges; a group of several, or one with a conflict, is
    ambiguous."""
    of_a, of_b = components.select(F.col("id").alias("a"), F.col("component").alias("ca")), components.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    lifted = edges.where("edge in ('gray', 'conflict')").join(of_a, "a").join(of_b, "b")
    gray = lifted.where("edge = 'gray'").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    groups = connected_components(sizes, gray, "component").toDF("component", "group_id")
    conflicts = lifted.where("edge = 'conflict'").select(F.explode(F.array("ca", "cb")).alias("component")).distinct().withColumn("_c", F.lit(True))
    rows = groups.join(sizes, "component").join(conflicts, "component", "left")
    facts = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("components"), F.bool_or(F.col("_c").isNotNull()).alias("conflict"))
    klass = F.when((F.col("components") > 1) | F.col("conflict"), "AMBIGUOUS_CLUSTER").when(F.col("size") >= 2, "ONE_PHYSICAL_PARK_CONFIDENT").otherwise("STANDALONE_PHYSICAL_PARK")
    return rows.join(facts, "group_id").select("component", "group_id", "size", klass.alias("group_class"))


def name_clusters(records: DataFrame, gap_m: float = 25) -> DataFrame:
    """(id, component) of same-name polygons within a gap."""
    keyed = with_box(records.where("polys is not null").select("id", "latitude", "longitude", "polys", name_key("name").alias("key")).where("key <> ''"))
    pairs = near_pairs(saved(keyed, "keyed"), gap_m, ["key"])
    pairs = pairs.where(F.coalesce(least_gap_m("a", "b", F.lit(0.0)) <= gap_m + MARGIN_M, F.lit(True))).where(polygon_gap_m("a.polys", "b.polys") <= gap_m)
    return connected_components(records, pairs.select(F.col("a.id").alias("_a"), F.col("b.id").alias("_b")).toDF("a", "b"))


def source_clusters(records: DataFrame, fragment_gap_m: float = 30, ambiguous_gap_m: float = 150, same_point_m: float = 2, reach_m: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Clusters of one source's records (id, name, latitude, longitude, polys or null) for review: ((id, component), (a, b,
    why)). Two records overlap if their polygons meet, or, where one has no polygon, if their points are ``same_point_m`` apart
    at most. Overlapping records are one if their names agree or either name is generic or a placeholder, else ambiguous;
    records of agreeing names are one within ``fragment_gap_m`` and ambiguous within ``ambiguous_gap_m``. Generic names never
    agree. ``reach_m``: leaves out pairs whose points lie farther apart, whatever their polygons do."""
    parsed = with_box(dealt(records.select("id", "name", "latitude", "longitude", "polys"), "id").select("id", "latitude", "longitude", "polys", parse_name("name").alias("parsed")))
    pairs = near_pairs(saved(parsed, "source-parsed"), max(ambiguous_gap_m, same_point_m))
    points = haversine_m("a.latitude", "a.longitude", "b.latitude", "b.longitude")
    if reach_m is not None:
        near = (F.abs(F.col("a.latitude") - F.col("b.latitude")) <= 0.004) & (F.abs(F.col("a.longitude") - F.col("b.longitude")) <= 0.006)
        pairs = pairs.where(near & (points <= reach_m))
    measured = pairs.withColumn("d", points)
    both = F.col("a.polys").isNotNull() & F.col("b.polys").isNotNull()
    agree = has_evidence(name_relationship(F.col("a.parsed"), F.col("b.parsed")))
    weak = F.col("a.parsed.generic") | F.col("b.parsed.generic") | F.col("a.parsed.placeholder") | F.col("b.parsed.placeholder")
    # only pairs that may get a reason are measured: others' names do not agree, and their boxes or points lie apart
    may_overlap = F.when(both, F.coalesce(least_gap_m("a", "b", F.col("d")) <= MARGIN_M, F.lit(True))).otherwise(F.col("d") <= same_point_m)
    measured = measured.where(may_overlap | agree)
    only_a, only_b = F.when(F.col("b.polys").isNull(), F.col("a.polys")), F.when(F.col("a.polys").isNull(), F.col("b.polys"))
    # told side by side, one Python worker a task measures all three
    distances = {"gap": polygon_gap_m("a.polys", F.when(both, F.col("b.polys"))), "to_a": point_polygon_m("b.longitude", "b.latitude", only_a), "to_b": point_polygon_m("a.longitude", "a.latitude", only_b)}
    measured = measured.withColumns(distances)
    gap = F.when(both, F.col("gap")).otherwise(F.coalesce("to_a", "to_b", "d"))
    overlap = F.when(both, F.col("gap") == 0).otherwise(F.col("d") <= same_point_m)
    judged = measured.select(F.col("a.id").alias("_a"), F.col("b.id").alias("_b"), gap.alias("gap_m"), overlap.alias("overlap"), agree.alias("agree"), weak.alias("weak")).withColumnsRenamed({"_a": "a", "_b": "b"})
    why = (
        F.when(F.col("overlap"), F.when(F.col("agree") | F.col("weak"), "one").otherwise("overlap_with_other_name"))
        .when(F.col("agree") & (F.col("gap_m") <= fragment_gap_m), "one")
        .when(F.col("agree") & (F.col("gap_m") <= ambiguous_gap_m), "namesake_nearby")
    )
    told = saved(judged.withColumn("why", why).where("why is not null").select("a", "b", "why"), "source-pairs")
    return connected_components(records, told.where("why = 'one'").select("a", "b")), told.where("why <> 'one'")


def cluster_classes(components: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(id, component, size, cluster_class, ambiguous): AMBIGUOUS if a member of several has an ambiguous neighbour, FRAGMENTED
    if none has, SINGLETON alone; ``ambiguous`` says whether the record itself has one."""
    near = ambiguous.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("_a", F.lit(True))
    rows = components.join(near, "id", "left").withColumn("ambiguous", F.col("_a").isNotNull())
    facts = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.bool_or("ambiguous").alias("_any"))
    klass = F.when(F.col("size") < 2, "SINGLETON").when(F.col("_any"), "AMBIGUOUS").otherwise("FRAGMENTED")
    return rows.join(facts, "component").select("id", "component", "size", klass.alias("cluster_class"), "ambiguous")


def namesake_groups(components: DataFrame, records: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(key, records, group_class): FRAGMENTED in one component, AMBIGUOUS if a namesake is near but not linked, else DISTINCT.
    Generic and placeholder names have no group."""
    near = ambiguous.where("why = 'namesake_nearby'").select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("_a", F.lit(True))
    named = records.select("id", parse_name("name").alias("p")).where("not p.generic and not p.placeholder")
    rows = named.select("id", F.col("p.key").alias("key")).join(components, "id").join(near, "id", "left")
    facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("component").alias("parts"), F.bool_or(F.col("_a").isNotNull()).alias("near"))
    klass = F.when(F.col("parts") == 1, "FRAGMENTED").when(F.col("near"), "AMBIGUOUS").otherwise("DISTINCT")
    return facts.where("records > 1").select("key", "records", klass.alias("group_class"))


def nearest_other_component(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """(id, gap_m): the nearest record with name evidence in another component."""
    ca, cb = components.select(F.col("id").alias("a"), F.col("component").alias("ca")), components.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    other = pairs.where("name_evidence").join(ca, "a").join(cb, "b").where("ca <> cb")
    ends = other.select(F.explode(F.array("a", "b")).alias("id"), "boundary_gap_m")
    return ends.groupBy("id").agg(F.min("boundary_gap_m").alias("gap_m"))


def flatten_aliases(aliases: DataFrame) -> DataFrame:
    """(retired_id, survivor_id) with every chain followed to its end; an error on a cycle. Followed stretches double each
    round, so one that is still followed when it is longer than the table has come back to itself."""
    checkpoint_root(aliases.sparkSession)
    flat = aliases.select("retired_id", "survivor_id").checkpoint()
    for _ in range(flat.count().bit_length() + 1):
        onward = flat.select(F.col("retired_id").alias("survivor_id"), F.col("survivor_id").alias("_next"))
        joined = flat.join(onward, "survivor_id", "left").select("retired_id", F.coalesce("_next", "survivor_id").alias("survivor_id"), F.col("_next").isNotNull().alias("moves")).checkpoint()
        flat = joined.select("retired_id", "survivor_id")
        if not joined.where("moves").limit(1).count():
            return flat
    raise ValueError("alias cycle")


def audit_connectivity(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Records (id, component, rederived) whose component differs from that of the qualifying edges."""
    again = connected_components(clusters, edges.where("edge = 'link'")).withColumnRenamed("component", "rederived")
    return clusters.join(again, "id").where("component <> rederived")


def with_bbox(df: DataFrame, polys: str = "polys") -> DataFrame:
    return df.withColumn("box", bbox(polys))
