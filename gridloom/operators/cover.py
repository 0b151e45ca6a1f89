"""Pairs of shapes that come near each other, from a cover of their boxes by grid cells (SPJ-13, SPJ-14, GRF-2).

A shape's box, grown by half the distance on each side, is filed in the cells of the level whose cells are at least as wide
and high as it, four at most. It asks in its own cells of that and every coarser level in use, four each. So each pair meets
at the level of its larger box, and is kept only in the cell that holds the corner where the two boxes' overlap begins. The
work follows the number of shapes and of true pairs of boxes, whatever their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import COUNTRY, bbox, lat_step, lon_step


def with_box(df: DataFrame, polys: str = "polys", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Adds ``box`` of the polygons, or of the point where there are none."""
    point = F.struct(F.col(lon).alias("west"), F.col(lat).alias("south"), F.col(lon).alias("east"), F.col(lat).alias("north"))
    return df.withColumn("box", F.when(F.col(polys).isNull(), point).otherwise(bbox(polys)))


def box_pairs(boxes: DataFrame, metres: float, id_col: str = "id", by: list[str] | None = None, most_lat: float = COUNTRY[1]) -> DataFrame:
    """(a, b) with a < b: ids whose boxes (a struct ``box`` of west, south, east, north) are no farther apart than ``metres``
    in either direction, and equal in the columns ``by``. Ids are distinct; rows without a box find nothing."""
    by = by or []
    dy, dx = lat_step(metres) / 2, lon_step(metres, most_lat) / 2
    high, wide = lat_step(max(metres, 50.0)), lon_step(max(metres, 50.0), most_lat)
    grown = boxes.where("box.west is not null and box.south is not null").select(
        F.col(id_col).alias("id"), *by,
        (F.col("box.west") - dx).alias("w"), (F.col("box.south") - dy).alias("s"), (F.col("box.east") + dx).alias("e"), (F.col("box.north") + dy).alias("n"),
    )
    size = F.greatest((F.col("e") - F.col("w")) / wide, (F.col("n") - F.col("s")) / high)
    filed = grown.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(size))).cast("int"))
    levels = sorted(r["level"] for r in filed.select("level").distinct().collect())  # some twenty: each is twice the one before

    def cells(at: Column) -> Column:
        span = lambda low, high_, step: F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high_) / step))
        unit = F.pow(F.lit(2.0), at)
        return F.flatten(F.transform(span("w", "e", unit * wide), lambda x: F.transform(span("s", "n", unit * high), lambda y: F.struct(at.cast("int").alias("l"), x.alias("x"), y.alias("y")))))

    own = filed.select(F.struct("id", "level", "w", "s", "e", "n").alias("b"), *(F.col(k).alias(f"b_{k}") for k in by), F.explode(cells(F.col("level"))).alias("c"))
    coarser = F.filter(F.array(*map(F.lit, levels or [0])), lambda v: v >= F.col("level"))
    asked = filed.select(F.struct("id", "level", "w", "s", "e", "n").alias("a"), *(F.col(k).alias(f"a_{k}") for k in by), F.explode(F.flatten(F.transform(coarser, cells))).alias("c"))
    met = asked.join(own.hint("merge"), ["c"]).where((F.col("a.level") < F.col("b.level")) | ((F.col("a.level") == F.col("b.level")) & (F.col("a.id") < F.col("b.id"))))
    for k in by:
        met = met.where(F.col(f"a_{k}") == F.col(f"b_{k}"))
    west, south = F.greatest("a.w", "b.w"), F.greatest("a.s", "b.s")
    meets = (west <= F.least("a.e", "b.e")) & (south <= F.least("a.n", "b.n"))
    unit = F.pow(F.lit(2.0), F.col("b.level"))
    corner = (F.floor(west / (unit * wide)) == F.col("c.x")) & (F.floor(south / (unit * high)) == F.col("c.y"))
    return met.where(meets & corner).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
