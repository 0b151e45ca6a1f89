"""Dataset readiness and license evidence (JOB-15, FLT-6, FLT-7, AGG-12, SRC-10, SRC-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import in_bounds
from gridloom.functions.text import has_park_word, name_key
from gridloom.operators.tables import profile_fields


def license_status(orgs: DataFrame, evidence: DataFrame, unknown: DataFrame | None = None, boilerplate: tuple[str, ...] = ()) -> DataFrame:
    """(org, status): evidence (org, status, label, priority) by folded name, the best priority wins; labels that are
    boilerplate are no evidence; organisations listed as unknown stay UNKNOWN."""
    labels = [name_key(F.lit(b)) for b in boilerplate]
    good = evidence.where(~name_key("label").isin(labels)) if labels else evidence
    best = good.groupBy(name_key("org").alias("_k")).agg(F.min_by("status", "priority").alias("_s"))
    rows = orgs.select("org", name_key("org").alias("_k")).join(best, "_k", "left")
    if unknown is not None:
        rows = rows.join(unknown.select(name_key("org").alias("_k")).distinct().withColumn("_u", F.lit(True)), "_k", "left")
    else:
        rows = rows.withColumn("_u", F.lit(None).cast("boolean"))
    return rows.select("org", F.when(F.col("_u"), "UNKNOWN").otherwise(F.coalesce("_s", F.lit("UNKNOWN"))).alias("status"))


def licensed(df: DataFrame, licenses: DataFrame, key: str = "org") -> DataFrame:
    return df.join(licenses.where("status = 'SAFE_OPEN'").select(key), key, "left_semi")


def catalog_resources(datasets: DataFrame) -> DataFrame:
    """(dataset_id, title, resource_id, format, url, park_like) of datasets with ``resources`` and ``tags``."""
    park = has_park_word("title") | F.exists(F.coalesce("tags", F.array().cast("array<string>")), has_park_word)
    rows = datasets.withColumn("park_like", park).select("dataset_id", "title", "park_like", F.explode_outer("resources").alias("r"))
    return rows.select("dataset_id", "title", "r.resource_id", "r.format", "r.url", "park_like")


def classify_format(df: DataFrame, declared: str = "format", sample: str = "sample") -> DataFrame:
    """Adds ``format_class``: the declared format, or for CSV and JSON what a sample of the content shows."""
    f = F.lower(F.coalesce(F.trim(declared), F.lit("")))
    s = F.coalesce(sample, F.lit(""))
    header = F.lower(F.substring_index(s, "\n", 1))
    coordinates = F.regexp_like(header, F.lit(r"(?<![a-z])(lat|latitude|enlem|y)(?![a-z])")) & F.regexp_like(header, F.lit(r"(?<![a-z])(lon|lng|longitude|boylam|x)(?![a-z])"))
    geo = F.regexp_like(s, F.lit('"type"\\s*:\\s*"(FeatureCollection|Feature)"'))
    klass = (
        F.when(f.isin("geojson"), "geojson").when(f.isin("shp", "shapefile", "zip"), "archive").when(f.isin("kml", "kmz"), "kml")
        .when(f.isin("csv", "tsv", "txt"), F.when(s == "", "csv_unknown").when(coordinates, "csv_coordinates").otherwise("csv_table"))
        .when(f.isin("json", "api"), F.when(s == "", "json_unknown").when(geo, "geojson").otherwise("json_table"))
        .when(f.isin("xls", "xlsx"), "spreadsheet").when(f.isin("wms", "wfs", "esri rest", "arcgis"), "service").otherwise("other")
    )
    return df.withColumn("format_class", klass)


def taxonomy_profile(features: DataFrame, field: str = "taxonomy", by: str = "dataset_id") -> DataFrame:
    """(dataset_id, value, n, park_share) of taxonomy values."""
    return features.groupBy(by, F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.avg(has_park_word("name").cast("double")).alias("park_share"))


def dataset_readiness(datasets: DataFrame, features: DataFrame, park_share: float = 0.5, least_unique: float = 1.0) -> DataFrame:
    """(dataset_id, status, reason). ``datasets``: (dataset_id, license_status, needs_parser); ``features``: (dataset_id,
    external_id, name, taxonomy, latitude, longitude). The first thing in the way decides."""
    placed = in_bounds("latitude", "longitude")
    facts = features.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("latitude").isNotNull()).alias("with_place"), F.count_if(placed).alias("in_country"),
        F.count("external_id").alias("with_id"), F.count_distinct("external_id").alias("ids"), F.count_if(F.coalesce(F.trim("name"), F.lit("")) != "").alias("named"),
        F.count_if(has_park_word("name") | has_park_word("taxonomy")).alias("parks"), F.count("taxonomy").alias("with_taxonomy"),
    )
    j = datasets.join(facts, "dataset_id", "left")
    share = lambda c: F.col(c) / F.col("n")
    said = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    d = (
        F.when(F.coalesce(F.col("license_status"), F.lit("")) != "SAFE_OPEN", said("BLOCKED_LICENSE", "license"))
        .when(F.coalesce("n", F.lit(0)) == 0, said("BLOCKED_SCHEMA", "no_features"))
        .when((F.col("with_place") == 0) | (F.col("named") == 0), said("BLOCKED_SCHEMA", "no_coordinates_or_names"))
        .when(share("in_country") < 0.5, said("BLOCKED_CRS", "outside_country"))
        .when((F.col("with_id") < F.col("n")) | (F.col("ids") / F.col("with_id") < least_unique), said("BLOCKED_IDENTITY", "ids_missing_or_repeated"))
        .when((F.col("parks") == 0) & (F.col("with_taxonomy") == 0), said("NOT_PARK_DATA", "no_park_word"))
        .when((share("parks") < park_share) & (F.col("with_taxonomy") == 0), said("BLOCKED_TAXONOMY", "too_few_park_names"))
        .when(F.coalesce("needs_parser", F.lit(False)), said("READY_AFTER_SMALL_PARSER", "parser"))
        .otherwise(said("READY_FOR_RECONCILIATION", "ready"))
    )
    return j.withColumn("d", d).select("dataset_id", "d.status", "d.reason")


def choose_id_field(features: DataFrame, fields: list[str]) -> Column | DataFrame:
    """The profile of candidate id fields, the best first."""
    return profile_fields(features, fields).orderBy((F.col("unique_share") < 1), F.desc("non_null"), "field")
