"""Points and regions: containment, nearest boundary, assignment (SPJ-1..6, SPJ-10, SPJ-11, PRJ-1).

A region is edges (region, x1, y1, x2, y2), holes included. Points meet a region's edges by an equi-join on latitude bands
and on columns as wide as the region, so only edges near the point are looked at; an odd count of crossings is inside.
Nearest boundaries use cells as wide as a cap; without one, rings of cells grow until every point has found its boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import COUNTRY, LAT_M, LON_M, crosses, lat_step, lon_step, segment_distance_at, segment_distance_m
from gridloom.functions.session import saved

BAND = 0.02


def region_edges(features: DataFrame, name_col: str = "region") -> DataFrame:
    """Edges of features with ``polys`` (parts of rings of [x, y] points)."""
    rings = features.select(F.col(name_col).alias("region"), F.posexplode("polys").alias("part", "poly")).select("region", "part", F.posexplode("poly").alias("ring", "points"))
    points = rings.select("region", "part", "ring", "points", F.posexplode("points").alias("seq", "p")).where("seq < size(points) - 1")
    nxt = F.get("points", F.col("seq") + 1)
    return points.select("region", "part", "ring", "seq", F.get("p", F.lit(0)).alias("x1"), F.get("p", F.lit(1)).alias("y1"), F.get(nxt, F.lit(0)).alias("x2"), F.get(nxt, F.lit(1)).alias("y2"))


def region_boxes(edges: DataFrame) -> DataFrame:
    return edges.groupBy("region").agg(F.min("x1").alias("west"), F.max("x1").alias("east"), F.min("y1").alias("south"), F.max("y1").alias("north"))


def _bands(low, high, size: float):
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def contained_in(points: DataFrame, edges: DataFrame, id_col: str = "id", band: float = BAND) -> DataFrame:
    """(id, region) for every region that contains the point. A region's edges lie in columns at least as wide as the region,
    two at most, and points ask in the columns of each width in use, so what lies east or west of a region doesn't meet it."""
    boxes = edges.groupBy("region").agg(F.min(F.least("x1", "x2")).alias("_west"), F.max(F.greatest("x1", "x2")).alias("_east"))
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("_east") - F.col("_west")) / band))).cast("int")
    levels = boxes.where("_west is not null").select("region", "_west", level.alias("level"))
    used = sorted(r["level"] for r in levels.select("level").distinct().collect())  # some twenty: each is twice the one before
    wide = lambda k: F.pow(F.lit(2.0), k) * band
    asks = F.transform(F.array(*map(F.lit, used or [0])), lambda k: F.struct(k.alias("level"), F.floor(F.col("longitude") / wide(k)).alias("column")))
    places = points.select(F.col(id_col).alias("id"), "longitude", "latitude", F.floor(F.col("latitude") / band).alias("band"), F.inline(asks)).where("longitude is not null and latitude is not null")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.where("y1 <> y2").join(levels, "region").select("region", "x1", "y1", "x2", "y2", "_west", "level", _bands(low, high, band).alias("band"))
    columns = F.sequence(F.floor(F.col("_west") / wide(F.col("level"))), F.floor(F.greatest("x1", "x2") / wide(F.col("level"))))
    filed = banded.select("region", "x1", "y1", "x2", "y2", "level", "band", F.explode(columns).alias("column"))
    hits = places.join(filed.hint("merge"), ["band", "level", "column"]).where(crosses("longitude", "latitude", "x1", "y1", "x2", "y2"))
    return hits.groupBy("id", "region").count().where("count % 2 = 1").select("id", "region")


def nearest_region(points: DataFrame, edges: DataFrame, max_m: float, id_col: str = "id", most_lat: float = COUNTRY[1]) -> DataFrame:
    """(id, region, distance_m) of the nearest boundary within the cap, in whole metres; the first region wins ties."""
    rows, columns = lat_step(max_m), lon_step(max_m, most_lat)
    places = points.select(F.col(id_col).alias("id"), "longitude", "latitude", F.floor(F.col("latitude") / rows).alias("row"), F.floor(F.col("longitude") / columns).alias("column"))
    return _nearest_of(places.join(_around(edges, rows, columns).hint("merge"), ["row", "column"]), max_m)


def _around(edges: DataFrame, rows: float, columns: float) -> DataFrame:
    """Edges in the cells of their boxes and those around."""
    spread = edges.select(
        "region", "x1", "y1", "x2", "y2",
        F.expr(f"explode(sequence(floor(least(y1, y2) / {rows!r}) - 1, floor(greatest(y1, y2) / {rows!r}) + 1))").alias("row"),
    )
    return spread.select("*", F.expr(f"explode(sequence(floor(least(x1, x2) / {columns!r}) - 1, floor(greatest(x1, x2) / {columns!r}) + 1))").alias("column"))


def _nearest_of(pairs: DataFrame, max_m: float) -> DataFrame:
    near = pairs.withColumn("d", segment_distance_m("longitude", "latitude", "x1", "y1", "x2", "y2"))
    metre = F.floor(F.min("d") + 0.5)
    by_region = near.where(F.col("d") <= max_m).groupBy("id", "region").agg(metre.alias("distance_m"))
    best = F.min(F.struct("distance_m", "region"))
    return by_region.groupBy("id").agg(best.alias("b")).select("id", "b.region", "b.distance_m")


def _nearest_by_parts(points: DataFrame, edges: DataFrame, max_m: float, most_lat: float, parts: int = 16) -> DataFrame:
    """``nearest_region`` for wide caps. Edges are first told apart for whole parts of a cell: an edge stays if from the part's
    centre it may be nearest, to the metre, for some point of the part. So a point meets only edges about as near as its
    nearest, and a part meets the many around it."""
    rows, columns = lat_step(max_m), lon_step(max_m, most_lat)
    spread = _around(edges, rows, columns).hint("merge")
    fine = [F.floor(F.col("latitude") / (rows / parts)).alias("_r"), F.floor(F.col("longitude") / (columns / parts)).alias("_c")]
    places = points.select("id", "longitude", "latitude", *fine)
    low, high = F.col("_r") * (rows / parts), (F.col("_r") + 1) * (rows / parts)
    degree = lambda lat: LON_M * F.cos(F.radians(F.least(lat, F.lit(90.0))))
    least, most = degree(F.greatest(F.abs(low), F.abs(high))), degree(F.least(F.abs(low), F.abs(high)))
    # half a diagonal, and a little for rounding at the borders of parts
    reach = F.sqrt(F.pow(most * (columns / parts / 2), 2) + F.pow(F.lit(LAT_M * rows / parts / 2), 2)) + 0.01
    cells = places.select("_r", "_c").distinct().select(
        "_r", "_c", F.floor(F.col("_r") / parts).alias("row"), F.floor(F.col("_c") / parts).alias("column"), ((F.col("_c") + 0.5) * (columns / parts)).alias("_lon"),
        ((F.col("_r") + 0.5) * (rows / parts)).alias("_lat"), least.alias("_least"), most.alias("_most"), reach.alias("_reach"),
    )
    far = lambda k: segment_distance_at(F.col(k), "_lon", "_lat", "x1", "y1", "x2", "y2")
    bounds = cells.join(spread, ["row", "column"]).groupBy(*cells.columns).agg(F.min(far("_most") + F.col("_reach")).alias("_bound"))
    kept = bounds.join(spread, ["row", "column"]).where(far("_least") - F.col("_reach") <= F.col("_bound") + 1).select("_r", "_c", "region", "x1", "y1", "x2", "y2")
    return _nearest_of(places.join(kept.hint("merge"), ["_r", "_c"]), max_m)


def nearest_region_any(points: DataFrame, edges: DataFrame, first_m: float = 1000, wider: float = 8, id_col: str = "id", most_lat: float = COUNTRY[1]) -> DataFrame:
    """(id, region, distance_m) of the nearest boundary, however far: rings of cells, each ``wider`` times the one before.
    A point leaves once what it found is nearer than the ring, so only far points, against ever coarser cells, go on."""
    edges = saved(edges, "edges")
    left, found, ring = points.select(F.col(id_col).alias("id"), "longitude", "latitude").where("longitude is not null and latitude is not null"), [], float(first_m)
    while ring < 30_000_000:
        left = saved(left, "points-left")
        if left.isEmpty() or edges.isEmpty():
            break
        near = nearest_region(left, edges, ring, most_lat=most_lat) if ring == first_m else _nearest_by_parts(left, edges, ring, most_lat)
        near = saved(near.where(F.col("distance_m") < int(ring)), "nearest")
        found.append(near)
        left, ring = left.join(near.hint("merge"), "id", "left_anti"), ring * wider
    told = points.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("bigint").alias("distance_m")).limit(0)
    for near in found:
        told = told.unionByName(near)
    return told


def _placed(points: DataFrame, edges: DataFrame, max_m: float) -> DataFrame:
    """id, array of containing regions in Turkish order, nearest region for points in none."""
    inside = contained_in(points, edges).groupBy("id").agg(F.array_sort(F.collect_set("region")).alias("inside"))
    outside = points.join(inside, "id", "left_anti")
    near = nearest_region(outside, edges, max_m).withColumnsRenamed({"region": "near", "distance_m": "near_m"})
    return points.select("id").join(inside, "id", "left").join(near, "id", "left")


def verify_region(points: DataFrame, edges: DataFrame, expected_col: str = "city", max_m: float = 2000) -> DataFrame:
    """(id, verified, inside): in the expected region, or in none and nearest to it within the cap."""
    found = points.select("id", F.col(expected_col).alias("expected")).join(_placed(points, edges, max_m), "id")
    ok = F.coalesce(F.array_contains("inside", F.col("expected")), F.lit(False)) | (F.col("inside").isNull() & F.coalesce(F.col("near") == F.col("expected"), F.lit(False)))
    return found.select("id", ok.alias("verified"), "inside")


def assign_region(points: DataFrame, edges: DataFrame, max_m: float = 2000) -> DataFrame:
    """(id, region, method): contained; ambiguous (the first in Turkish order); nearest; unresolved."""
    found = _placed(points, edges, max_m)
    if dict(edges.dtypes)["region"] == "string":
        first = F.array_sort("inside", lambda x, y: F.when(F.collate(x, "tr") < F.collate(y, "tr"), -1).when(F.collate(x, "tr") > F.collate(y, "tr"), 1).otherwise(0))
    else:
        first = F.col("inside")
    method = F.when(F.size("inside") == 1, "contained").when(F.size("inside") > 1, "ambiguous").when(F.col("near").isNotNull(), "nearest").otherwise("unresolved")
    return found.select("id", F.coalesce(F.get(first, F.lit(0)), "near").alias("region"), method.alias("method"))


def resolve_district(points: DataFrame, edges: DataFrame, mode: str = "spatial", field: str | None = None, max_m: float = 3000) -> DataFrame:
    """(id, district, method). ``mode``: field, spatial or none; several containing districts stay unresolved."""
    if mode == "none":
        return points.select("id", F.lit(None).cast("string").alias("district"), F.lit("none").alias("method"))
    if mode == "field":
        value = F.nullif(F.trim(field), F.lit(""))
        return points.select("id", value.alias("district"), F.when(value.isNull(), "unresolved").otherwise("field").alias("method"))
    found = assign_region(points, edges, max_m)
    kept = F.when(F.col("method").isin("contained", "nearest"), F.col("region"))
    return found.select("id", kept.alias("district"), F.when(kept.isNull(), F.when(F.col("method") == "ambiguous", "ambiguous").otherwise("unresolved")).otherwise(F.col("method")).alias("method"))


def districts_of(provinces: DataFrame, districts: DataFrame) -> DataFrame:
    """(district, province) of the province that holds the centre of the district's box."""
    centres = region_boxes(districts).select(F.col("region").alias("id"), ((F.col("west") + F.col("east")) / 2).alias("longitude"), ((F.col("south") + F.col("north")) / 2).alias("latitude"))
    return contained_in(centres, provinces).select(F.col("id").alias("district"), F.col("region").alias("province"))


def unique_containment(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, region) where the region holds one point and the point lies in one region."""
    n = F.count(F.lit(1))
    pairs = contained_in(points, edges)
    both = pairs.withColumn("_p", n.over(Window.partitionBy("id"))).withColumn("_r", n.over(Window.partitionBy("region")))
    return both.where("_p = 1 and _r = 1").select("id", "region")


def polygon_candidates(points: DataFrame, edges: DataFrame, names: DataFrame, metres: float = 300, most_lat: float = COUNTRY[1]) -> DataFrame:
    """(id, region, inside, distance_m, similarity, rank): polygons within a distance of a point (0 inside). ``names``:
    (region, name). ``inside`` follows the half-open rule: of the boundary, at distance 0, only a part is inside. Ranks go by
    distance in whole millimetres, then name similarity, then region: a border that regions share is as near to each."""
    from gridloom.functions.names import similarity
    from gridloom.functions.text import name_key

    rows, columns = lat_step(metres), lon_step(metres, most_lat)
    inside = contained_in(points, edges).withColumn("inside", F.lit(True)).withColumn("distance_m", F.lit(0.0))
    spread = edges.select("region", "x1", "y1", "x2", "y2", F.expr(f"explode(sequence(floor(least(y1, y2) / {rows!r}) - 1, floor(greatest(y1, y2) / {rows!r}) + 1))").alias("row"))
    spread = spread.select("*", F.expr(f"explode(sequence(floor(least(x1, x2) / {columns!r}) - 1, floor(greatest(x1, x2) / {columns!r}) + 1))").alias("column"))
    places = points.select("id", "longitude", "latitude", F.floor(F.col("latitude") / rows).alias("row"), F.floor(F.col("longitude") / columns).alias("column"))
    near = places.join(spread, ["row", "column"]).select("id", "region", F.lit(False).alias("inside"), segment_distance_m("longitude", "latitude", "x1", "y1", "x2", "y2").alias("distance_m")).where(F.col("distance_m") <= metres)
    best = inside.unionByName(near).groupBy("id", "region").agg(F.bool_or("inside").alias("inside"), F.min("distance_m").alias("distance_m"))
    named = best.join(points.select("id", name_key("name").alias("_a")), "id").join(names.select("region", name_key("name").alias("_b")), "region")
    ranked = named.withColumn("similarity", similarity(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    order = Window.partitionBy("id").orderBy(F.floor(F.col("distance_m") * 1000 + 0.5), F.desc("similarity"), "region")
    return ranked.withColumn("rank", F.row_number().over(order))


def normalize_region(parks: DataFrame, edges: DataFrame, known: DataFrame, max_m: float = 50_000) -> tuple[DataFrame, DataFrame]:
    """Parks whose ``city`` is no known region get the containing, else nearest, one; and the audit (id, old, new, method)."""
    strange = parks.join(known.select(F.col("region").alias("city")), "city", "left_anti")
    audit = strange.select("id", F.col("city").alias("old")).join(assign_region(strange, edges, max_m).select("id", F.col("region").alias("new"), "method"), "id")
    fixed = parks.join(audit.select("id", "new"), "id", "left").withColumn("city", F.coalesce("new", "city")).drop("new")
    return fixed, audit
