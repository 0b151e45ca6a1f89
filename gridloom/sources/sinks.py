"""Boundary tiles and their viewports (SNK-2, GEO-6)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import tile_key
from gridloom.functions.session import saved
from gridloom.operators.polygons import clean_geometry


HEAD, TAIL = '{"type":"FeatureCollection","features":[', "]}"


def tile_features(parks: DataFrame) -> DataFrame:
    """(tile, id, feature): a GeoJSON feature for each park. ``parks``: (id, osm_id, latitude, longitude, polys); polygons
    that don't clean are left out."""
    rows = parks.withColumn("polys", clean_geometry("polys")).where("polys is not null").withColumn("tile", tile_key("latitude", "longitude"))
    geometry = F.when(F.size("polys") == 1, F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.get("polys", F.lit(0))), F.lit("}"))).otherwise(
        F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json("polys"), F.lit("}"))
    )
    head = F.to_json(F.struct("id", "osm_id"))
    return rows.select("tile", "id", F.concat(F.lit('{"type":"Feature","properties":'), head, F.lit(',"geometry":'), geometry, F.lit("}")).alias("feature"))


def tile_list(features: DataFrame) -> DataFrame:
    """(tile, boundaries, bytes, content_hash) of ``tile_features``, by partial aggregates. ``bytes``: of the tile as one
    FeatureCollection. Features are hashed, grouped by the first two bytes of their hash, each group's sorted hashes are
    hashed, and so are a tile's 65,536 groups' hashes."""
    hashed = features.select("tile", F.sha2("feature", 256).alias("h"), F.octet_length("feature").alias("b"))
    groups = hashed.groupBy("tile", F.substring("h", 1, 4).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("gh"))
    sums = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "gh"))), lambda x: x["gh"]), ""), 256)
    frame = len(HEAD) + len(TAIL) - 1
    return groups.groupBy("tile").agg(F.sum("n").alias("boundaries"), (F.sum("b") + F.sum("n") + frame).alias("bytes"), F.substring(sums, 1, 12).alias("content_hash"))


def _collections(features: DataFrame, most_bytes: int) -> DataFrame:
    """(tile, part, collection) of features in order of tile and id: documents of ``most_bytes`` at most, or of one feature."""

    def run(batches):
        tile, held, size, part = None, [], 0, TaskContext.get().partitionId() << 33

        def told():
            text = HEAD + ",".join(held) + TAIL
            return pa.RecordBatch.from_arrays([pa.array([tile], pa.string()), pa.array([part], pa.int64()), pa.array([text], pa.string())], ["tile", "part", "collection"])

        for batch in batches:
            for t, f in zip(batch.column("tile").to_pylist(), batch.column("feature").to_pylist()):
                n = len(f.encode()) + 1
                if held and (t != tile or size + n > most_bytes):
                    yield told()
                    held, size, part = [], 0, part + 1
                if not held:
                    size = len(HEAD) + len(TAIL) - 1
                tile, size = t, size + n
                held.append(f)
        if held:
            yield told()

    return features.mapInArrow(run, "tile string, part bigint, collection string")


def _tiles(parks: DataFrame, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The tile list and the documents of all tiles."""
    features = saved(tile_features(parks), "tile-features")
    told = saved(tile_list(features), "tile-list")
    # a row a tile: a million quarter degrees at most, whatever the parks
    sized = features.join(F.broadcast(told.select("tile", (F.col("bytes") > most_bytes).alias("large"))), "tile")
    small = sized.where(~F.col("large")).repartition("tile").sortWithinPartitions("tile", "id", "feature")
    large = sized.where("large").repartitionByRange("tile", "id").sortWithinPartitions("tile", "id", "feature")
    return told, _collections(small, most_bytes).union(_collections(large, most_bytes))


def boundary_tiles(parks: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """(tile, boundaries, bytes, content_hash, part, collection): a FeatureCollection as JSON for each quarter degree, ids
    in order; ``parks`` as for ``tile_features``. A tile of over ``most_bytes`` has several rows, each a FeatureCollection of
    its own whose ids follow those of lesser ``part``; boundaries, bytes and hash are the whole tile's."""
    told, documents = _tiles(parks, most_bytes)
    return documents.join(F.broadcast(told), "tile").select("tile", "boundaries", "bytes", "content_hash", "part", "collection")


def write_boundary_tiles(parks: DataFrame, path: str, most_bytes: int = 16 << 20) -> DataFrame:
    """Writes a text partition for each tile, a document of ``boundary_tiles`` a line, and returns the list (tile,
    boundaries, bytes, content_hash)."""
    told, documents = _tiles(parks, most_bytes)
    named = documents.join(F.broadcast(told), "tile").select(F.concat_ws("-", "tile", "content_hash").alias("tile"), F.col("collection").alias("value"))
    named.write.partitionBy("tile").text(path)
    return told


def tiles_of_viewport(south: float, north: float, west: float, east: float) -> list[str]:
    step = 0.25
    return [f"{x}-{y}" for x in range(math.floor(west / step), math.floor(east / step) + 1) for y in range(math.floor(south / step), math.floor(north / step) + 1)]


def visible_boundaries(parks: DataFrame, south: float, north: float, west: float, east: float, selected: str | None = None) -> DataFrame:
    """Parks (id, latitude, longitude, polys) of the viewport's tiles and of the selected park's, marked ``selected``."""
    tiles = tile_key("latitude", "longitude").isin(tiles_of_viewport(south, north, west, east))
    chosen = F.col("id") == selected if selected is not None else F.lit(False)
    return parks.where(F.col("polys").isNotNull() & (tiles | chosen)).withColumn("selected", chosen)


def curve(lon, lat, bits: int = 16):
    """A number whose order keeps near places together: the bits of both coordinates by turns."""
    unit = lambda c, low, span: F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor((c - low) / span * (1 << bits)))).cast("bigint")

    def spread(x):
        # bits apart by doubling gaps
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return x

    return F.shiftleft(spread(unit(lat, -90.0, 180.0)), 1).bitwiseOR(spread(unit(lon, -180.0, 360.0)))


def write_places(places: DataFrame, path: str, files: int = 64, group_rows: int = 20_000) -> None:
    """Places (with ``bbox``: xmin, xmax, ymin, ymax) dealt to files and sorted in them along a space-filling curve of their
    boxes' centres. So the least and greatest coordinates of a file and of its row groups span little, and a reader with a box
    skips the others."""
    key = curve((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2, (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2)
    dealt = places.withColumn("_curve", key).repartitionByRange(files, "_curve").sortWithinPartitions("_curve").drop("_curve")
    rows = str(group_rows)
    dealt.write.option("parquet.block.row.count.limit", rows).option("parquet.page.row.count.limit", rows).parquet(path)
