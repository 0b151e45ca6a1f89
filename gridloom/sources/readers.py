"""Readers (SRC-*): landed files to DataFrames with fixed schemas. Nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import has_park_word, source_name
from gridloom.operators.regions import region_boxes, region_edges
from gridloom.sources.split_json import split_features

FEATURES = "features array<struct<type string, id string, properties map<string,string>, geometry struct<type string, coordinates string>>>"
RING = "array<array<double>>"


def geometry_columns(kind: Column, coordinates: Column) -> dict[str, Column]:
    """Point coordinates and polygons of a GeoJSON geometry whose coordinates are JSON text; what doesn't parse is null."""
    point = F.from_json(coordinates, "array<double>")
    poly = F.from_json(coordinates, f"array<{RING}>")
    multi = F.from_json(coordinates, f"array<array<{RING}>>")
    return {
        "longitude": F.when(kind == "Point", F.get(point, F.lit(0))),
        "latitude": F.when(kind == "Point", F.get(point, F.lit(1))),
        "polys": F.when(kind == "Polygon", F.array(poly)).when(kind == "MultiPolygon", multi),
    }


FEATURE = "type string, id string, properties map<string,string>, geometry struct<type string, coordinates string>"


def read_features(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(file, position, properties, geom_type, longitude, latitude, polys) of GeoJSON FeatureCollections, a row for each feature.
    With ``range_bytes``, files are cut and read by several tasks each (``split_json``); without, a file is one task's, which
    does for files that fit it."""
    if range_bytes is None:
        raw = spark.read.schema(FEATURES).json(path, multiLine=True)
        rows = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("position", "f"))
    else:
        rows = split_features(spark, path, range_bytes).select("file", "position", F.from_json("feature", FEATURE).alias("f"))
    cols = geometry_columns(F.col("f.geometry.type"), F.col("f.geometry.coordinates"))
    return rows.select("file", "position", "f.properties", F.col("f.geometry.type").alias("geom_type"), *(c.alias(n) for n, c in cols.items()))


def read_osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, name, tags, latitude, longitude): nodes by their position, ways and relations by their centre."""
    schema = "elements array<struct<type string, id bigint, lat double, lon double, center struct<lat double, lon double>, tags map<string,string>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    return e.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("osm_id"), source_name("tags").alias("name"), "tags", F.coalesce("lat", "center.lat").alias("latitude"), F.coalesce("lon", "center.lon").alias("longitude"))


def osm_catalog(points: DataFrame, multipolygons: DataFrame) -> DataFrame:
    """Catalog rows of an extract: points are nodes; polygons are ways if they have a way id, else relations."""
    node = points.select(F.concat(F.lit("node/"), F.col("osm_id").cast("string")).alias("osm_id"), "name", "latitude", "longitude")
    way = F.when(F.col("osm_way_id").isNotNull(), F.concat(F.lit("way/"), F.col("osm_way_id").cast("string"))).otherwise(F.concat(F.lit("relation/"), F.col("osm_id").cast("string")))
    return node.unionByName(multipolygons.select(way.alias("osm_id"), "name", "latitude", "longitude"))


CATALOG = ["id", "osm_id", "name", "city", "district", "latitude", "longitude"]


def load_osm_source(fresh: DataFrame | None, legacy: DataFrame) -> DataFrame:
    """The fresh baseline when there is one, else the legacy catalog; seven fixed columns."""
    return (fresh if fresh is not None else legacy).select(*CATALOG)


def read_municipal_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, BOM, quoted commas and line breaks; empty rows dropped; fails on an open quote."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", encoding="UTF-8")
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | (F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "")
    return df.where(filled)


# Header names of coordinates.
LAT_NAMES, LON_NAMES = ["lat", "latitude", "enlem", "y"], ["lon", "lng", "longitude", "boylam", "x"]


def sniff_delimiter(header: str) -> str:
    return max(";,\t|", key=header.count)


def decimal(c: Column) -> Column:
    """A number with decimal point or comma; null for what is none."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def read_coordinate_csv(spark: SparkSession, path: str, swapped: bool = False) -> DataFrame:
    """CSV with its delimiter and coordinate columns found in the header; ``swapped``: the labels are known to be exchanged."""
    header = spark.read.text(path, wholetext=False).limit(1).first()
    delimiter = sniff_delimiter(header[0] if header else ",")
    df = spark.read.csv(path, header=True, sep=delimiter, multiLine=True, quote='"', escape='"')
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    by_name = {c.lower(): c for c in df.columns}
    lat, lon = (next((by_name[n] for n in names if n in by_name), None) for names in (LAT_NAMES, LON_NAMES))
    if lat is None or lon is None:
        raise ValueError(f"no coordinate columns in {df.columns}")
    if swapped:
        lat, lon = lon, lat
    return df.withColumn("_latitude", decimal(F.col(f"`{lat}`"))).withColumn("_longitude", decimal(F.col(f"`{lon}`")))


def read_places(spark: SparkSession, path: str, bbox: tuple[float, float, float, float], hierarchy: str) -> DataFrame:
    """Places whose box overlaps (west, south, east, north) and whose taxonomy has a value in its hierarchy. Of a table of
    ``sinks.write_places``, only files and row groups near the box are read."""
    west, south, east, north = bbox
    df = spark.read.parquet(path)
    overlap = (F.col("bbox.xmin") <= east) & (F.col("bbox.xmax") >= west) & (F.col("bbox.ymin") <= north) & (F.col("bbox.ymax") >= south)
    return df.where(overlap & F.array_contains("taxonomy.hierarchy", hierarchy))


def read_regions(spark: SparkSession, path: str, name_key: str = "shapeName") -> tuple[DataFrame, DataFrame]:
    """(edges, boxes) of the named polygons of a FeatureCollection."""
    features = read_features(spark, path).where("polys is not null").select(F.trim(F.col("properties")[name_key]).alias("region"), "polys")
    edges = region_edges(features)
    return edges, region_boxes(edges)


def read_arcgis(spark: SparkSession, path: str) -> DataFrame:
    """(attributes, rings) of ArcGIS polygon rows; rings follow the even-odd rule."""
    schema = f"features array<struct<attributes map<string,string>, geometry struct<rings array<{RING}>>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.attributes", "f.geometry.rings")


def companion_serials(df: DataFrame, column: str, pattern: str | None = None) -> DataFrame:
    """(serial): a column of digits, or with ``pattern`` every match of its first group in a text."""
    if pattern is None:
        return df.where(F.regexp_like(F.trim(column), F.lit(r"^\d+$"))).select(F.trim(column).alias("serial"))
    return df.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("serial"))


def stage_records(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of a JSON array held in a text column."""
    return raw.select(F.inline(F.from_json(column, f"array<struct<{schema}>>")))


def report_context(reports: DataFrame, parks: DataFrame, events: DataFrame) -> DataFrame:
    """Reports with a JSON ``context`` of the park and event that they are about."""
    p, e = parks.select(F.col("id").alias("park_id"), F.struct("id", "name", "city").alias("park")), events.select(F.col("id").alias("feeding_id"), F.struct("id", "user_id", "occurred_at").alias("event"))
    j = reports.join(p, "park_id", "left").join(e, "feeding_id", "left")
    return j.select(*reports.columns, F.to_json(F.struct("park", "event")).alias("context"))


def park_like(df: DataFrame, column: str) -> DataFrame:
    return df.where(has_park_word(column))
