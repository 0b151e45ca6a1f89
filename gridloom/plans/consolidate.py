"""Physical consolidation, taxonomy gate, lifecycle manifest (JOB-4, JOB-5, JOB-6, JOB-12..14, JN-14, AGG-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.rules import only_source
from gridloom.functions.session import spread
from gridloom.functions.text import is_generic, name_key
from gridloom.operators.polygons import flatten_aliases
from gridloom.operators.regions import contained_in, polygon_candidates, unique_containment
from gridloom.operators.spatial import unique_point_match, within_radius
from gridloom.operators.tables import signal_fractions, unique_key_match
from gridloom.plans.registry import exploded_refs, with_refs


def survivors(members: DataFrame) -> DataFrame:
    """(component, action, survivor_id, survivor_kind, retired) from members (id, component, status, canonical_id, order_id):
    one OSM target is the survivor; without one, the municipal park of the least source id; several OSM targets prevent it."""
    osm = F.array_sort(F.collect_set(F.when(F.col("status") == "accepted_osm_matched", F.col("canonical_id"))))
    own = F.array_sort(F.collect_list(F.when(F.col("status") == "accepted_municipal_new", F.struct("order_id", "canonical_id"))))
    facts = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), osm.alias("osm"), own.alias("_own"))
    municipal = F.col("_own.canonical_id")
    facts = facts.withColumn("municipal", municipal)
    several, one = F.size("osm") > 1, F.size("osm") == 1
    many = F.col("size") >= 2
    action = F.when(many & several, "no_consolidation").when(many & (one | (F.size("municipal") >= 2)), "consolidate").otherwise("none")
    joins = action == "consolidate"
    survivor = F.when(joins, F.when(one, F.get("osm", F.lit(0))).otherwise(F.get("municipal", F.lit(0))))
    retired = F.when(joins, F.array_distinct(F.array_remove("municipal", survivor))).otherwise(F.array().cast("array<string>"))
    return facts.select("component", "size", action.alias("action"), survivor.alias("survivor_id"), F.when(joins, F.when(one, "osm").otherwise("municipal")).alias("survivor_kind"), retired.alias("retired"))


def consolidate(registry: DataFrame, members: DataFrame, decisions: DataFrame, source_code: str) -> tuple[DataFrame, DataFrame]:
    """(new registry, retired): refs of retired parks move to survivors, parks that are retired go. retired: (retired_id,
    survivor_id, component)."""
    retired = decisions.where("action = 'consolidate'").select("component", "survivor_id", F.explode("retired").alias("retired_id")).where("retired_id <> survivor_id")
    moves = retired.select(F.col("retired_id").alias("id"), "survivor_id")
    refs = exploded_refs(registry).join(moves, "id", "left").withColumn("id", F.coalesce("survivor_id", "id")).drop("survivor_id")
    kept = registry.join(moves, "id", "left_anti")
    return with_refs(kept, refs).select(*registry.columns), retired.select("retired_id", "survivor_id", "component")


SIGNALS = ["name_park_word", "layer_park_token", "non_park_keyword", "facility_name", "green_space_name"]
LEVELS = ["TAXONOMY_AMBIGUOUS", "PARK_LIKELY", "PARK_CONFIRMED"]


def taxonomy_gate(members: DataFrame, shapes: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(component, taxonomy_class, signals, shape flags) of members with boolean ``SIGNALS`` and shapes of
    ``polygons.shape_metrics``. Shape takes one level from a cluster: path-like always, linear if it has one signal."""
    s = signal_fractions(members, "component", SIGNALS, fraction).join(shapes, "component", "left")
    strength = F.col("name_park_word").cast("int") + F.col("layer_park_token").cast("int")
    path, linear = F.coalesce("path_like", F.lit(False)), F.coalesce("linear", F.lit(False))
    level = F.greatest(F.lit(0), strength - (path | (linear & (strength == 1))).cast("int"))
    klass = (
        F.when(F.col("non_park_keyword") & ~F.col("name_park_word"), "NON_PARK")
        .when(F.col("facility_name") & ~F.col("name_park_word"), "TAXONOMY_AMBIGUOUS")
        .otherwise(F.get(F.array(*map(F.lit, LEVELS)), level))
    )
    return s.withColumn("taxonomy_class", klass)


def demoted_parks(registry: DataFrame, members: DataFrame, gate: DataFrame, source_code: str) -> DataFrame:
    """(id, component, taxonomy_class): parks of this source alone whose cluster is gated."""
    gated = gate.where("taxonomy_class in ('NON_PARK', 'TAXONOMY_AMBIGUOUS')").select("component", "taxonomy_class")
    held = exploded_refs(registry).where(F.col("source_code") == source_code).select("id", "external_id")
    rows = members.select(F.col("id").alias("external_id"), "component").join(gated, "component").join(held, "external_id")
    own = registry.where(F.col("osm_id").isNull() & only_source("source_refs", source_code)).select("id")
    return rows.select("id", "component", "taxonomy_class").join(own, "id", "left_semi").groupBy("id").agg(F.min("component").alias("component"), F.min("taxonomy_class").alias("taxonomy_class"))


def lifecycle_manifest(retired: DataFrame, demoted: DataFrame) -> DataFrame:
    """(retired_id, action, survivor_id, queue): aliases flattened; what leads to a demoted park is a tombstone too."""
    flat = flatten_aliases(retired)
    d = demoted.select(F.col("id").alias("survivor_id"), "taxonomy_class")
    rows = flat.join(d, "survivor_id", "left").select("retired_id", "survivor_id", "taxonomy_class")
    own = demoted.select(F.col("id").alias("retired_id"), F.lit(None).cast("string").alias("survivor_id"), "taxonomy_class")
    action = F.when(F.col("taxonomy_class").isNull(), "ALIAS_REDIRECT").when(F.col("taxonomy_class") == "NON_PARK", "TOMBSTONE_NON_PARK").otherwise("TOMBSTONE_TAXONOMY_REVIEW")
    queue = F.when(F.col("taxonomy_class") == "NON_PARK", "non_park_ledger").when(F.col("taxonomy_class").isNotNull(), "taxonomy_review_queue")
    return rows.unionByName(own).select("retired_id", action.alias("action"), F.when(F.col("taxonomy_class").isNull(), F.col("survivor_id")).alias("survivor_id"), queue.alias("queue"))


def classify_polygons(points: DataFrame, edges: DataFrame, names: DataFrame, generic_m: float = 30, near_m: float = 300) -> DataFrame:
    """(region, klass) of official polygons against OSM points (id, name, longitude, latitude): contained_single,
    multiple_contained, generic_fragment, generic_multiple, named_near, unanchored."""
    pairs = polygon_candidates(points, edges, names, near_m)
    facts = pairs.groupBy("region").agg(
        F.count_if("inside").alias("inside"), F.count_if(F.col("distance_m") <= generic_m).alias("close"), F.count(F.lit(1)).alias("near")
    )
    rows = names.select("region", "name").join(facts, "region", "left").na.fill(0)
    vague = is_generic("name")
    klass = (
        F.when(F.col("inside") == 1, "contained_single").when(F.col("inside") > 1, "multiple_contained")
        .when(vague & (F.col("close") == 1), "generic_fragment").when(vague & (F.col("close") > 1), "generic_multiple")
        .when(~vague & (F.col("near") > 0), "named_near").otherwise("unanchored")
    )
    return rows.select("region", klass.alias("klass"))


def anchor_clusters(members: DataFrame) -> DataFrame:
    """(component, decision, anchors) of members (component, anchor_id, needs_review): one anchor and no review attaches."""
    facts = members.groupBy("component").agg(F.array_sort(F.collect_set("anchor_id")).alias("anchors"), F.bool_or("needs_review").alias("review"))
    decision = F.when(F.col("review") | (F.size("anchors") > 1), "review").when(F.size("anchors") == 1, "attach").otherwise("official_only")
    return facts.select("component", decision.alias("decision"), "anchors")


def multi_anchor_groups(classified: DataFrame) -> DataFrame:
    """(anchor_id, polygons): anchors with more than one official polygon, and how many. The polygons are the rows that name
    the anchor."""
    pairs = classified.where("anchor_id is not null").select("anchor_id", "region").distinct()
    return pairs.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("polygons")).where("polygons > 1").orderBy(F.desc("polygons"), "anchor_id")


def rescue_by_name(clusters: DataFrame, anchors: DataFrame, metres: float = 150) -> DataFrame:
    """(component, anchor_id, distance_m): unanchored clusters with exactly one anchor of the same name nearby."""
    keyed = clusters.withColumn("key", name_key("name")).where("key <> ''")
    pairs = within_radius(keyed, anchors.withColumn("key", name_key("name")), metres, ["key"])
    best = pairs.groupBy(F.col("a.component").alias("component"), F.col("b.id").alias("anchor_id")).agg(F.min("distance_m").alias("distance_m"))
    facts = best.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.first("anchor_id").alias("anchor_id"), F.first("distance_m").alias("distance_m"))
    return facts.where("n = 1").drop("n")


def enrich_catalog(parks: DataFrame, polygons: DataFrame, polygon_names: DataFrame, named_points: DataFrame, districts: DataFrame, addresses: DataFrame, source: tuple[str, str] = ("", "")) -> DataFrame:
    """Parks with what official data adds; nothing known is replaced.

    An unnamed park takes the name of the polygon (``polygons``: edges of regions, ``polygon_names``: region, name) that holds it
    alone and that it lies in alone, unless a reciprocal point has another name: such a conflict is left to people. Only where no
    polygon holds the park does it take the point's name. ``named_points``: (id, name, neighborhood, latitude, longitude).
    Districts come from unique containment; addresses from the point's neighborhood, if the park has no name or the point's,
    else from ``addresses`` (name, district, address) by a key that one park and one address have. ``source``: name and URL."""
    parks = spread(parks, "id")
    sole = unique_containment(parks, polygons).join(polygon_names, "region").select("id", F.col("name").alias("_poly"))
    held = contained_in(parks, polygons).select("id").distinct().withColumn("_held", F.lit(True))
    pairs = unique_point_match(named_points.select("id", "name", "neighborhood", "latitude", "longitude"), parks.select("id", "name", "latitude", "longitude"))
    point = pairs.select(F.col("b.id").alias("id"), F.col("a.name").alias("_point"), F.nullif("a.neighborhood", F.lit("")).alias("_hood"))
    out = parks.join(sole, "id", "left").join(held, "id", "left").join(point, "id", "left").join(unique_district(parks, districts), "id", "left")
    same = name_key("_poly") == name_key("_point")
    found = F.when(F.col("_poly").isNotNull() & (F.col("_point").isNull() | same), F.col("_poly")).when(F.col("_held").isNull(), F.col("_point"))
    unnamed, own_point = is_generic("name"), name_key("name") == name_key("_point")
    hood = F.when(F.col("_hood").isNotNull() & (unnamed | own_point), F.concat("_hood", F.lit(" Mahallesi")))
    named = unnamed & (F.coalesce(found, F.lit("")) != "")
    new = {
        "name": F.when(named, found).otherwise(F.col("name")), "district": F.coalesce(F.nullif("district", F.lit("")), F.col("_district"), F.col("district")),
        "name_status": F.when(named, "municipal").otherwise(F.col("name_status") if "name_status" in parks.columns else F.lit(None)),
        "name_source": F.when(named, source[0]).otherwise(F.col("name_source") if "name_source" in parks.columns else F.lit(None)),
        "name_source_url": F.when(named, source[1]).otherwise(F.col("name_source_url") if "name_source_url" in parks.columns else F.lit(None)),
    }
    kept = F.nullif("address_label", F.lit("")) if "address_label" in parks.columns else F.lit(None).cast("string")
    fields = [c for c in parks.columns if c != "address_label"]
    out = out.select(*(new[c].alias(c) if c in new else F.col(c) for c in fields), F.coalesce(kept, hood).alias("_label"))
    keyed = unique_key_match(out.select("id", "name", "district"), addresses.select("name", "district", "address"), ["name", "district"])
    by_key = keyed.select(F.col("a.id").alias("id"), F.col("b.address").alias("_address"))
    return out.join(by_key, "id", "left").select(*fields, F.coalesce("_label", "_address").alias("address_label"))


def unique_district(parks: DataFrame, districts: DataFrame) -> DataFrame:
    """(id, _district) of parks in exactly one district."""
    return contained_in(parks, districts).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("region").alias("_district")).where("n = 1").drop("n")
