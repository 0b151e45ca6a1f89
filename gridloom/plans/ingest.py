"""Source ingestion and gap analysis (JOB-1, JOB-2): every input row gets one outcome with its reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import in_bounds
from gridloom.functions.ids import det_uuid
from gridloom.functions.session import saved
from gridloom.functions.text import UNNAMED, clean, has_park_word, is_generic, name_key
from gridloom.operators.regions import assign_region, resolve_district, verify_region
from gridloom.operators.spatial import duplicate_guard, extended_guard, near_duplicates, tiered_match
from gridloom.operators.tables import first_valid_by_id, shared_targets


@dataclass(frozen=True)
class SourceConfig:
    source_code: str
    display_name: str
    dataset_url: str
    id_namespace: str
    province: str
    license_status: str = "SAFE_OPEN"
    url_param: str = "id"
    allowed_taxonomy: tuple[str, ...] | None = None
    name_is_evidence: bool = False
    tiers_m: tuple[float, float] = (25, 150)
    name_conflict_first: bool = True
    extended_m: float | None = 250
    duplicate_guard_m: float | None = None
    province_fallback_m: float = 2000
    district_mode: str = "none"
    district_field: str | None = None
    district_fallback_m: float = 3000


def _outcome(df: DataFrame, outcome: str, reason: str | None, *more) -> DataFrame:
    wanted = {"target_id": "string", "others": "bigint"}
    have = {c.split(" as ")[-1] for c in more}
    rest = [F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in have]
    return df.select("external_id", F.lit(outcome).alias("outcome"), F.lit(reason).cast("string").alias("reason"), *(F.expr(c) for c in more), *rest).select("external_id", "outcome", "reason", *wanted)


def candidates(features: DataFrame, provinces: DataFrame, cfg: SourceConfig, districts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records that can be matched, outcomes of the others). ``features``: (external_id, name, taxonomy, latitude,
    longitude, position), coordinates null where the geometry failed."""
    if cfg.license_status != "SAFE_OPEN":
        raise ValueError(f"{cfg.source_code}: license {cfg.license_status} is not open")
    marked = first_valid_by_id(features, "external_id", "position", F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    invalid = marked.where("reject is not null").select("external_id", F.lit("INVALID").alias("outcome"), F.col("reject").alias("reason"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("bigint").alias("others"))
    rows = marked.where("reject is null").drop("reject").withColumn("source_name", F.col("name")).withColumn("external_id", F.col("external_id").cast("string"))
    if cfg.name_is_evidence:
        park = has_park_word("name")
    else:
        park = F.lit(True) if cfg.allowed_taxonomy is None else F.coalesce(F.col("taxonomy").isin(list(cfg.allowed_taxonomy)), F.lit(False))
    not_park = _outcome(rows.where(~park), "REJECTED_NON_PARK", "taxonomy")
    rows = rows.where(park)
    outside = _outcome(rows.where(~in_bounds("latitude", "longitude")), "INVALID", "invalid_coordinate")
    rows = saved(rows.where(in_bounds("latitude", "longitude")).withColumn("city", F.lit(cfg.province)).withColumn("id", F.col("external_id")), "ingest-rows")
    checked = saved(rows.join(verify_region(rows, provinces, "city", cfg.province_fallback_m).select("id", "verified"), "id"), "ingest-checked")
    mismatch = _outcome(checked.where(~F.col("verified")), "PROVINCE_MISMATCH", None)
    good = checked.where("verified").drop("verified")
    placed = resolve_district(good, districts if districts is not None else provinces, cfg.district_mode if districts is not None or cfg.district_mode != "spatial" else "none", cfg.district_field, cfg.district_fallback_m)
    good = good.join(placed.select("id", F.coalesce("district", F.lit("")).alias("district"), F.col("method").alias("district_method")), "id")
    good = good.withColumn("name", F.when(clean("name") == "", UNNAMED).otherwise(clean("name")))
    return good, invalid.unionByName(not_park).unionByName(outside).unionByName(mismatch)


def ingest(features: DataFrame, registry: DataFrame, provinces: DataFrame, cfg: SourceConfig, districts: DataFrame | None = None) -> DataFrame:
    """(external_id, outcome, reason, target_id, others) of every feature; ``others``: how many more share the target, or
    are possible duplicates. ``registry``: parks (id, osm_id, name, city,
    district, latitude, longitude, source_refs)."""
    good, rejected = candidates(features, provinces, cfg, districts)
    osm = registry.where(F.col("osm_id").isNotNull() & (F.col("city") == cfg.province)).select("id", "osm_id", "name", "latitude", "longitude")
    slim = saved(good.select("id", "external_id", "name", "city", "district", "latitude", "longitude"), "ingest-candidates")
    pairs = tiered_match(slim, osm, cfg.tiers_m).select("a.external_id", F.col("a.name").alias("name"), F.col("b.id").alias("target_id"), F.col("b.name").alias("target_name"))
    pairs = saved(pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("external_id"))), "ingest-pairs")
    several = _outcome(pairs.where("n > 1").select("external_id").distinct(), "REVIEW", "multiple_osm_candidates")
    single = pairs.where("n = 1").drop("n")
    conflict = ~is_generic("name") & ~is_generic("target_name") & (name_key("name") != name_key("target_name"))
    single = single.withColumn("conflict", conflict)
    asks = single.where("not conflict") if cfg.name_conflict_first else single
    shared = shared_targets(asks, "external_id", "target_id").withColumn("others", F.col("claims") - 1)
    clash = _outcome(shared.where("claims > 1"), "REVIEW", "shared_osm_target_conflict", "target_id", "others")
    sole = shared.where("claims = 1")
    named = single if cfg.name_conflict_first else sole
    different = _outcome(named.where("conflict"), "REVIEW", "name_conflict_at_same_location", "target_id")
    matched = _outcome(sole.where("not conflict"), "MATCHED", None, "target_id")
    new = slim.join(pairs.select("external_id").distinct(), "external_id", "left_anti")
    parts = [rejected, several, clash, different, matched]
    if cfg.extended_m:
        guarded = extended_guard(new, registry.select("id", "name", "city", "district", "latitude", "longitude", "source_refs"), cfg.source_code, cfg.extended_m)
        guarded = guarded.select("a.external_id", F.col("b.id").alias("target_id"))
        parts.append(_outcome(guarded, "REVIEW", "possible_match_outside_primary_radius", "target_id"))
        new = new.join(guarded, "external_id", "left_anti")
    if cfg.duplicate_guard_m:
        twins = duplicate_guard(new, cfg.duplicate_guard_m)
        parts.append(_outcome(twins, "REVIEW", "possible_duplicate_within_source", "others"))
        new = new.join(twins, "external_id", "left_anti")
    parts.append(_outcome(new, "NEW", None))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def name_upgrades(outcomes: DataFrame, features: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, old_name, proposed_name): matched parks without a name of their own whose source record has one."""
    rows = outcomes.where("outcome = 'MATCHED'").join(features.select(F.col("external_id").cast("string").alias("external_id"), clean("name").alias("proposed_name")), "external_id")
    joined = rows.join(registry.select(F.col("id").alias("target_id"), F.col("name").alias("old_name")), "target_id")
    return joined.where(is_generic("old_name") & ~is_generic("proposed_name")).select(F.col("target_id").alias("id"), "old_name", "proposed_name")


def source_ref(cfg: SourceConfig, external_id="external_id"):
    e = F.col(external_id)
    return F.struct(F.lit(cfg.source_code).alias("source_code"), e.alias("external_id"), F.concat(F.lit(f"{cfg.dataset_url}#{cfg.url_param}_"), e).alias("source_url"))


def to_canonical(good: DataFrame, cfg: SourceConfig) -> DataFrame:
    """New parks in the registry's shape, each with its own source ref."""
    return good.select(
        det_uuid(F.concat(F.lit(cfg.id_namespace + ":"), "external_id")).alias("id"), F.lit(None).cast("string").alias("osm_id"), "name",
        F.lit(cfg.province).alias("city"), "district", "latitude", "longitude", F.lit(cfg.display_name).alias("source"),
        F.when(is_generic("name"), "missing").otherwise("municipal").alias("name_status"), F.lit(cfg.display_name).alias("name_source"),
        F.lit(cfg.dataset_url).alias("name_source_url"), F.array(source_ref(cfg)).alias("source_refs"),
    )


def gap_analysis(places: DataFrame, registry: DataFrame, provinces: DataFrame, allowed: list[str], tiers_m: tuple[float, float] = (25, 150), generic: tuple[str, ...] = (UNNAMED, "Park", "Yeşil Alan", "Park Alanı"), fallback_m: float = 2000) -> DataFrame:
    """(id, position, outcome, target_id), one row for each row of places (id, name, taxonomy, latitude, longitude; position is
    unique): REJECT_NON_PARK, INVALID, PROVINCE_MISMATCH, DUPLICATE_SOURCE, MATCHED_EXISTING, REVIEW, STRONG_NEW. Of the rows
    of an id, the first that passes the filters counts and later ones that pass are duplicates. Generic names are matched within
    the first tier only; a place without a park near is new whatever its name."""
    parkish, placed = F.coalesce(F.col("taxonomy").isin(allowed), F.lit(False)), in_bounds("latitude", "longitude")
    early = F.when(~parkish, "REJECT_NON_PARK").when(~placed, "INVALID")
    rows = places.withColumn("_early", early)
    valid = rows.where("_early is null")
    cities = assign_region(valid.select(F.col("position").alias("id"), "latitude", "longitude"), provinces, fallback_m)
    valid = valid.join(cities.select(F.col("id").alias("position"), F.col("region").alias("city")), "position")
    nth = F.row_number().over(Window.partitionBy("id", F.col("city").isNotNull()).orderBy("position"))
    valid = saved(valid.withColumn("_nth", nth), "gap-valid")
    first = valid.where("city is not null and _nth = 1")
    twins = near_duplicates(first).select("position")
    rest = saved(first.join(twins, "position", "left_anti").select(F.col("position").alias("id"), "name", "city", "latitude", "longitude"), "gap-rows")
    pairs = tiered_match(rest, registry.select("id", "name", "city", "latitude", "longitude"), tiers_m, by=["city"], inner_only=is_generic("a.name", generic))
    fits = is_generic("a.name", generic) | is_generic("b.name", generic) | (name_key("a.name") == name_key("b.name"))
    # counts and one row a place, however many parks are near
    found = pairs.groupBy(F.col("a.id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("b.id").cast("string")).alias("target_id"), F.bool_and(fits).alias("fits"))
    one = (F.col("n") == 1) & F.col("fits")
    outcome = F.when(F.col("n").isNull(), "STRONG_NEW").when(one, "MATCHED_EXISTING").otherwise("REVIEW")
    matched = rest.join(found, "id", "left").select(F.col("id").alias("position"), outcome.alias("outcome"), F.when(one, F.col("target_id")).alias("target_id"))
    none = F.lit(None).cast("string").alias("target_id")
    told = (
        rows.where("_early is not null").select("position", F.col("_early").alias("outcome"), none)
        .unionByName(valid.where("city is null").select("position", F.lit("PROVINCE_MISMATCH").alias("outcome"), none))
        .unionByName(valid.where("city is not null and _nth > 1").select("position", F.lit("DUPLICATE_SOURCE").alias("outcome"), none))
        .unionByName(twins.select("position", F.lit("DUPLICATE_SOURCE").alias("outcome"), none))
        .unionByName(matched)
    )
    return places.select("id", "position").join(told, "position").select("id", "position", "outcome", "target_id")
