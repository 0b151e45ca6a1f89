"""Distance joins over grid cells (SPJ-7..12, SPJ-16..21).

Pairs come from an equi-join on cells two radii wide: one side is exploded to the cells within a radius, four but for rounding,
the other keeps its own. So no plan compares everything with everything, and a dense cell is a skewed join key, which adaptive
execution splits. Both sides need latitude and longitude; rows without them find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import haversine_m, in_bounds, lat_step, lon_step
from gridloom.functions.names import name_evidence, parse_name
from gridloom.functions.rules import district_match
from gridloom.functions.text import is_generic, is_placeholder, name_key

WORLD = (-85.0, 85.0, -180.0, 180.0)
#: Any finite numbers, so that wrong coordinates still equal themselves.
ANYWHERE = (-1e9, 1e9, -1e9, 1e9)


def _celled(df: DataFrame, name: str, metres: float, most_lat: float, around: bool, by: list[str], box=WORLD) -> DataFrame:
    """Rows with their cell, or with those that come within a radius of them. Cells are two radii wide, so these are two in
    each direction at most, or three where a row lies in the middle of its cell and rounding moves both ends outward."""
    high, wide = lat_step(metres), lon_step(metres, most_lat)
    row = lambda shift: F.floor((F.col("latitude") + shift) / (2 * high))
    column = lambda shift: F.floor((F.col("longitude") + shift) / (2 * wide))
    keep = df.where(in_bounds("latitude", "longitude", box))
    keys = [F.col(k).alias(f"_{name}_{k}") for k in by]
    if not around:
        return keep.select(F.struct(*df.columns).alias(name), row(0.0).alias("_row"), column(0.0).alias("_column"), *keys)
    columns = F.sequence(column(-wide), column(wide))
    cells = F.transform(F.sequence(row(-high), row(high)), lambda r: F.transform(columns, lambda c: F.struct(r.alias("_row"), c.alias("_column"))))
    return keep.select(F.struct(*df.columns).alias(name), *keys, F.inline(F.flatten(cells)))


def within_radius(a: DataFrame, b: DataFrame, metres: float, by: list[str] | None = None, most_lat: float = 43.0, distance=haversine_m, box=WORLD) -> DataFrame:
    """Pairs (a struct, b struct, distance_m) within a radius; ``by``: columns that must be equal. Latitudes beyond
    ``most_lat`` need a larger value there, and rows outside ``box`` find nothing. Cells always meet by a shuffle: the optimizer's estimate of a side knows neither
    its copies nor how well its file is compressed, so a broadcast could be any size."""
    by = by or []
    left, right = _celled(a, "a", metres, most_lat, True, by, box), _celled(b, "b", metres, most_lat, False, by, box)
    same = (left["_row"] == right["_row"]) & (left["_column"] == right["_column"])
    for k in by:
        same = same & (left[f"_a_{k}"] == right[f"_b_{k}"])
    d = distance(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    return left.join(right.hint("merge"), same).select("a", "b", d.alias("distance_m")).where(F.col("distance_m") <= metres)


def self_pairs(df: DataFrame, metres: float, id_col: str = "id", by: list[str] | None = None, **options) -> DataFrame:
    """Pairs within one table, each once, a.id < b.id."""
    return within_radius(df, df, metres, by, **options).where(F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))


def tiered_match(a: DataFrame, b: DataFrame, tiers: tuple[float, float], id_col: str = "id", by: list[str] | None = None, inner_only: Column | None = None) -> DataFrame:
    """Pairs of the inner tier where a row has any, else of the outer; ``inner_only``: rows that use the inner alone."""
    pairs = within_radius(a, b, tiers[1], by)
    w = Window.partitionBy(F.col(f"a.{id_col}"))
    pairs = pairs.withColumn("_near", F.max(F.col("distance_m") <= tiers[0]).over(w))
    keep = ~F.col("_near") | (F.col("distance_m") <= tiers[0])
    if inner_only is not None:
        keep = keep & (~inner_only | (F.col("distance_m") <= tiers[0]))
    return pairs.where(keep).drop("_near")


def reciprocal(pairs: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """Pairs that are the only pair of both their ends."""
    n = F.count(F.lit(1))
    return (
        pairs.withColumn("_na", n.over(Window.partitionBy(a_key))).withColumn("_nb", n.over(Window.partitionBy(b_key)))
        .where("_na = 1 and _nb = 1").drop("_na", "_nb")
    )


def unique_point_match(points: DataFrame, parks: DataFrame, metres: float = 25) -> DataFrame:
    """Nearest alone never names a park: one candidate, and one park near it."""
    return reciprocal(within_radius(points, parks, metres), "a.id", "b.id")


def best_candidate(pairs: DataFrame, key: str, distance: str = "distance_m", tie: str = "b.id") -> DataFrame:
    """The nearest partner of each key (WIN-4)."""
    best = F.min_by(F.struct(*pairs.columns), F.struct(F.col(distance).alias("d"), F.col(tie).alias("t")))
    return pairs.groupBy(F.col(key).alias("_key")).agg(best.alias("_best")).select("_best.*")


def with_parsed(df: DataFrame, name_col: str = "name") -> DataFrame:
    return df.withColumn("parsed", parse_name(name_col))


def extended_guard(candidates: DataFrame, registry: DataFrame, source_code: str, metres: float = 250) -> DataFrame:
    """The nearest registry park with strong name evidence and no district conflict; parks of the own source excluded."""
    others = registry.where(~F.exists("source_refs", lambda r: r["source_code"] == source_code) | F.col("source_refs").isNull())
    pairs = within_radius(with_parsed(candidates), with_parsed(others), metres, ["city"])
    pairs = pairs.withColumn("evidence", name_evidence(F.col("a.parsed"), F.col("b.parsed")))
    pairs = pairs.where(F.col("evidence.kind").isNotNull() & (district_match("a.district", "b.district") != "DISTRICT_CONFLICT"))
    return best_candidate(pairs, "a.id")


def near_duplicates(df: DataFrame, metres: float = 30, id_col: str = "id") -> DataFrame:
    """Rows that lie within the radius of a row with the same, not empty, name key; both are returned once. Rows of one
    place and key count as one in the distance join, so a crowd at a place makes no pairs."""
    keyed = df.withColumn("_key", name_key("name")).where("_key <> ''").withColumn("_place", F.xxhash64("_key", "latitude", "longitude"))
    places = keyed.groupBy("_place").agg(F.first("_key").alias("_key"), F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"), F.count(F.lit(1)).alias("n"))
    pairs = self_pairs(places, metres, "_place", ["_key"])
    both = pairs.select(F.explode(F.array("a._place", "b._place")).alias("_place")).union(places.where(F.expr("n > 1") & in_bounds("latitude", "longitude", WORLD)).select("_place")).distinct()
    return keyed.join(both.hint("merge"), "_place", "left_semi").select(*df.columns)


def proximity_edges(df: DataFrame, metres: float, id_col: str = "id") -> DataFrame:
    """Edges (a, b) with the components of all pairs within a radius: rows of one place hang on its least id, and pairs are
    made of places only."""
    rows = df.select(id_col, "latitude", "longitude").where(in_bounds("latitude", "longitude", WORLD))
    places = rows.groupBy("latitude", "longitude").agg(F.min(id_col).alias("_least"))
    stars = rows.join(places, ["latitude", "longitude"]).where(F.col(id_col) != F.col("_least")).select(F.col("_least").alias("a"), F.col(id_col).alias("b"))
    pairs = self_pairs(places, metres, "_least")
    return stars.unionByName(pairs.select(F.col("a._least").alias("a"), F.col("b._least").alias("b")))


def possible_duplicates(registry: DataFrame, metres: float = 40) -> DataFrame:
    """(id_a, id_b, distance_m, pair_type, same_name)."""
    kinds = registry.select("id", "name", "latitude", "longitude", F.when(F.col("osm_id").isNull(), "municipal").otherwise("osm").alias("kind"))
    pairs = self_pairs(kinds, metres)
    pair_type = F.concat_ws("-", F.array_sort(F.array("a.kind", "b.kind")))
    same = (name_key("a.name") == name_key("b.name")) & (name_key("a.name") != "")
    return pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), "distance_m", pair_type.alias("pair_type"), same.alias("same_name"))


def near_duplicate_audit(registry: DataFrame) -> DataFrame:
    """Per source of municipal-only parks: parks with a strong namesake within 250 and 150 m, any park within 30 m, and
    one of the same source within 30 m."""
    parsed = with_parsed(registry.select("id", "name", "latitude", "longitude", "osm_id", F.col("source_refs.source_code").alias("codes")))
    own = parsed.where("osm_id is null and size(codes) > 0")
    pairs = within_radius(own, parsed, 250).where("a.id <> b.id")
    strong = name_evidence(F.col("a.parsed"), F.col("b.parsed"))["kind"].isNotNull()
    d = F.col("distance_m")

    def parks(holds: Column, name: str) -> Column:
        return F.count_distinct(F.when(holds, F.col("a.id"))).alias(name)

    return (
        pairs.withColumn("strong", strong).withColumn("source_code", F.explode("a.codes"))
        .groupBy("source_code").agg(
            parks(F.col("strong"), "strong_250"), parks(F.col("strong") & (d <= 150), "strong_150"), parks(d <= 30, "any_30"),
            parks((d <= 30) & F.array_contains("b.codes", F.col("source_code")), "same_source_30"),
        )
    )


def cross_resource_duplicates(records: DataFrame, close_m: float = 30, strong_m: float = 150) -> DataFrame:
    """Pairs of different resources that may be one place, with reasons. ``rings``: optional polygon of a record."""
    from gridloom.functions.geo import in_rings_even_odd

    pairs = self_pairs(with_parsed(records), strong_m, "key").where("a.resource_uuid <> b.resource_uuid")
    strong = name_evidence(F.col("a.parsed"), F.col("b.parsed"))["kind"].isNotNull() & ~is_placeholder("a.name") & ~is_placeholder("b.name")
    inside = F.lit(False)
    if "rings" in records.columns:
        inside = F.coalesce(in_rings_even_odd("b.longitude", "b.latitude", "a.rings"), F.lit(False)) | F.coalesce(
            in_rings_even_odd("a.longitude", "a.latitude", "b.rings"), F.lit(False)
        )
    reasons = F.array_compact(F.array(
        F.when(F.col("distance_m") <= close_m, "very_close"), F.when(strong, "strong_name_nearby"), F.when(inside, "point_inside_other_polygon"),
    ))
    told = pairs.select(F.col("a.key").alias("_a"), F.col("b.key").alias("_b"), "distance_m", reasons.alias("reasons")).where("size(reasons) > 0")
    return told.withColumnsRenamed({"_a": "a", "_b": "b"})


def _guarded_places(candidates: DataFrame, metres: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Specifically named records with their ``_place``; places (_place, n); pairs of places with equal or nested names nearby.
    Records of one name and place count as one in the distance join, so a crowd at a place makes no pairs."""
    named = candidates.where(~is_generic("name")).withColumn("_key", name_key("name")).withColumn("_place", F.xxhash64("_key", "latitude", "longitude"))
    places = named.groupBy("_place").agg(F.first("_key").alias("_key"), F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"), F.count(F.lit(1)).alias("n"))
    pairs = self_pairs(places, metres, "_place")
    return named, places.where(in_bounds("latitude", "longitude", WORLD)), pairs.where(F.contains("a._key", F.col("b._key")) | F.contains("b._key", F.col("a._key")))


def duplicate_guard(candidates: DataFrame, metres: float, id_col: str = "external_id") -> DataFrame:
    """New records of a source that have an equal or nested specific name nearby: (external_id, others), with how many."""
    named, places, pairs = _guarded_places(candidates, metres)
    ends = F.explode(F.array(F.struct(F.col("a._place").alias("_place"), F.col("b.n").alias("n")), F.struct(F.col("b._place").alias("_place"), F.col("a.n").alias("n"))))
    near = pairs.select(ends.alias("e")).groupBy(F.col("e._place").alias("_place")).agg(F.sum("e.n").alias("near"))
    own = places.join(near.hint("merge"), "_place", "left").select("_place", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("others"))
    return named.join(own.where("others > 0").hint("merge"), "_place").select(id_col, "others")


def duplicate_lists(candidates: DataFrame, metres: float, id_col: str = "external_id") -> DataFrame:
    """(external_id, others) of ``duplicate_guard``, with the sorted ids of the others. A list is as long as its record has
    others, so a crowd's lists grow with its square."""
    named, places, pairs = _guarded_places(candidates, metres)
    ends = lambda x, y: F.struct(F.col(f"{x}._place").alias("_place"), F.col(f"{y}._place").alias("_other"))
    met = pairs.select(F.inline(F.array(ends("a", "b"), ends("b", "a")))).unionByName(places.where("n > 1").select("_place", F.col("_place").alias("_other")))
    members = named.select(F.col("_place").alias("_other"), F.col(id_col).alias("_id"))
    lists = met.join(members.hint("merge"), "_other").groupBy("_place").agg(F.array_sort(F.collect_set("_id")).alias("_all"))
    told = named.select("_place", id_col).join(lists.hint("merge"), "_place").select(id_col, F.array_remove("_all", F.col(id_col)).alias("others"))
    return told.where("size(others) > 0")


def vets_within(vets: DataFrame, lat: float | None, lon: float | None, radius_m: float | None, most_m: float = 50_000) -> DataFrame:
    """Active vets by distance (spherical) within the capped radius; all of them if a parameter is missing."""
    active = vets.where("active")
    if lat is None or lon is None or radius_m is None:
        return active.withColumn("distance_m", F.lit(None).cast("double"))
    metres = min(radius_m, most_m)
    rows, columns = lat_step(metres), lon_step(metres, min(abs(lat) + lat_step(metres), 85))
    near = active.where(F.col("latitude").between(lat - rows, lat + rows) & F.col("longitude").between(lon - columns, lon + columns))
    return near.withColumn("distance_m", haversine_m(F.lit(lat), F.lit(lon), "latitude", "longitude")).where(F.col("distance_m") <= metres)
