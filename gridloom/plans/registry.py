"""The registry as a whole: merge, differences, coverage, invariants, audits (JOB-3, JOB-18, JOB-21, JOB-22, JN-9, JN-13, JN-15,
AGG-6, AGG-17, PRJ-3, PRJ-6, PRJ-8, PRJ-9, DML-1, DML-2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import haversine_m, in_bounds
from gridloom.functions.names import similarity
from gridloom.functions.text import is_generic, let, name_key
from gridloom.operators.spatial import possible_duplicates

REF = "struct<source_code:string,external_id:string,source_url:string>"


def exploded_refs(registry: DataFrame) -> DataFrame:
    return registry.select("id", F.explode("source_refs").alias("r")).select("id", "r.source_code", "r.external_id", "r.source_url")


def with_refs(parks: DataFrame, refs: DataFrame) -> DataFrame:
    """Parks with their refs (id, source_code, external_id, source_url) gathered in order of key."""
    own = refs.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("source_code", "external_id", "source_url"))).alias("source_refs"))
    return parks.drop("source_refs").join(own, "id", "left").withColumn("source_refs", F.coalesce("source_refs", F.array().cast(f"array<{REF}>")))


def attach_refs(registry: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds refs to their parks; parks without new ones keep their row."""
    own = refs.groupBy("id").agg(F.collect_set(F.struct("source_code", "external_id", "source_url")).alias("_new"))
    joined = registry.join(own, "id", "left")
    both = F.concat(*(F.coalesce(c, F.array().cast(f"array<{REF}>")) for c in ("source_refs", "_new")))
    # equal ones lie side by side: array_union would compare each ref with all others
    once = let(F.array_sort(both), lambda refs: F.filter(refs, lambda r, i: (i == 0) | ~r.eqNullSafe(F.get(refs, i - 1))))
    return joined.withColumn("source_refs", once).drop("_new")


def merge(registry: DataFrame, matched_refs: DataFrame, new_parks: DataFrame) -> DataFrame:
    """The registry with refs attached and new parks appended. Callers publish it only if ``check_invariants`` is empty."""
    return attach_refs(registry, matched_refs).unionByName(new_parks, allowMissingColumns=True)


def enrich_backlog(reviews: DataFrame, records: DataFrame, registry: DataFrame) -> DataFrame:
    """Reviews with a target get the distance to it and the name similarity (null where a name is empty)."""
    a = records.select(F.col("external_id"), F.col("name").alias("_n"), F.col("latitude").alias("_la"), F.col("longitude").alias("_lo"))
    b = registry.select(F.col("id").alias("target_id"), F.col("name").alias("_tn"), F.col("latitude").alias("_ta"), F.col("longitude").alias("_to"))
    rows = reviews.join(a, "external_id", "left").join(b, "target_id", "left")
    ka, kb = name_key("_n"), name_key("_tn")
    return rows.withColumn("distance_m", haversine_m("_la", "_lo", "_ta", "_to")).withColumn("name_similarity", F.when((ka != "") & (kb != ""), similarity(ka, kb))).drop("_n", "_la", "_lo", "_tn", "_ta", "_to")


def _violations(name: str, rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("id"))


def check_invariants(base: DataFrame, candidate: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(rule, id) of every violation; publishing needs none. Rows of ``base`` may gain refs, nothing else."""
    repeated = lambda df, key: df.groupBy(key).count().where(f"count > 1 and {key} is not null")
    refs, old_refs = exploded_refs(candidate), exploded_refs(base)
    key = ["source_code", "external_id"]
    held = refs.groupBy(*key).agg(F.count_distinct("id").alias("n")).where("n > 1").withColumn("id", F.concat_ws("/", *key))
    found = [
        _violations("duplicate_id", repeated(candidate, "id")),
        _violations("duplicate_osm_id", repeated(candidate, "osm_id"), "osm_id"),
        _violations("ref_held_twice", held),
        _violations("coordinate", candidate.where(~in_bounds("latitude", "longitude"))),
        _violations("lost_park", base.join(candidate, "id", "left_anti")),
        _violations("lost_ref", old_refs.join(refs, key, "left_anti").withColumn("id", F.concat_ws("/", *key))),
        _violations("mutated", base.alias("o").join(candidate.alias("n"), "id").where(" or ".join(f"not (o.{c} <=> n.{c})" for c in ("osm_id", "name", "city", "district", "latitude", "longitude")))),
    ]
    if regions is not None:
        found.append(_violations("province", candidate.join(regions.select(F.col("region").alias("city")), "city", "left_anti")))
    return reduce(DataFrame.unionByName, found)


def diff_catalog(old: DataFrame, new: DataFrame, moved: float = 5e-7) -> DataFrame:
    """(osm_id, state, name_changed, moved, city_changed, district_changed, id_stable): full outer on the OSM id."""
    o, n = old.where("osm_id is not null").alias("o"), new.where("osm_id is not null").alias("n")
    j = o.join(n, F.col("o.osm_id") == F.col("n.osm_id"), "full_outer")
    state = F.when(F.col("o.osm_id").isNull(), "new").when(F.col("n.osm_id").isNull(), "removed").otherwise("unchanged")
    both = state == "unchanged"
    shift = F.greatest(F.abs(F.col("o.latitude") - F.col("n.latitude")), F.abs(F.col("o.longitude") - F.col("n.longitude"))) > moved
    differs = lambda c: both & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return j.select(
        F.coalesce("o.osm_id", "n.osm_id").alias("osm_id"), state.alias("state"), differs("name").alias("name_changed"),
        (both & F.coalesce(shift, F.lit(False))).alias("moved"), differs("city").alias("city_changed"), differs("district").alias("district_changed"),
        (both & F.col("o.id").eqNullSafe(F.col("n.id"))).alias("id_stable"),
    )


def refresh_reconcile(old: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new registry, review): fresh OSM rows win and take over the frozen refs; an upgraded name stays while the fresh
    one is missing; rows gone from OSM go to review if they have refs, and official-only parks stay."""
    o = old.select(F.col("osm_id").alias("_osm"), F.col("source_refs").alias("_refs"), F.col("name").alias("_name"), F.col("name_status").alias("_status"))
    keep = is_generic("name") & F.col("_status").isin("municipal", "community")
    joined = fresh.drop("source_refs").join(o, F.col("osm_id") == F.col("_osm"), "left")
    merged = joined.withColumn("name", F.when(keep, F.col("_name")).otherwise(F.col("name"))).withColumn("name_status", F.when(keep, F.col("_status")).otherwise(F.col("name_status")))
    merged = merged.withColumn("source_refs", F.coalesce("_refs", F.array().cast(f"array<{REF}>"))).drop("_osm", "_refs", "_name", "_status")
    own = old.where("osm_id is null")
    gone = old.where("osm_id is not null").join(fresh.select("osm_id"), "osm_id", "left_anti").where("size(source_refs) > 0")
    return merged.unionByName(own, allowMissingColumns=True), gone


def identity_conflicts(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """(kind, incoming_id, held_by): an OSM id or source ref already held by another park, or an id with another OSM id."""
    i, r = incoming.alias("i"), registry.alias("r")
    osm = i.join(r, F.col("i.osm_id") == F.col("r.osm_id")).where("i.id <> r.id").select(F.lit("osm_id").alias("kind"), F.col("i.id").alias("incoming_id"), F.col("r.id").alias("held_by"))
    same = i.join(r, F.col("i.id") == F.col("r.id")).where("not (i.osm_id <=> r.osm_id)").select(F.lit("id").alias("kind"), F.col("i.id").alias("incoming_id"), F.col("r.id").alias("held_by"))
    a, b = exploded_refs(incoming).alias("a"), exploded_refs(registry).alias("b")
    refs = a.join(b, (F.col("a.source_code") == F.col("b.source_code")) & (F.col("a.external_id") == F.col("b.external_id"))).where("a.id <> b.id").select(F.lit("source_ref").alias("kind"), F.col("a.id").alias("incoming_id"), F.col("b.id").alias("held_by"))
    return osm.unionByName(same).unionByName(refs)


def region_coverage(registry: DataFrame, regions: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """(region, osm, refs, canonical, official_only, review) for every region, empty ones included."""
    facts = registry.groupBy(F.col("city").alias("region")).agg(
        F.count("osm_id").alias("osm"), F.sum(F.size("source_refs")).alias("refs"), F.count(F.lit(1)).alias("canonical"), F.count_if(F.col("osm_id").isNull()).alias("official_only")
    )
    out = regions.select("region").distinct().join(facts, "region", "left")
    if reviews is not None:
        out = out.join(reviews.groupBy(F.col("province").alias("region")).agg(F.count(F.lit(1)).alias("review")), "region", "left")
    else:
        out = out.withColumn("review", F.lit(0))
    return out.na.fill(0)


def ref_conservation(before: DataFrame, after: DataFrame, queues: DataFrame) -> DataFrame:
    """(source_code, before, after, queued, lost): refs of a source on parks and in queues; nothing may be lost."""
    key = ["source_code", "external_id"]
    tag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    rows = tag(exploded_refs(before), "b").join(tag(exploded_refs(after), "a"), key, "full_outer").join(tag(queues, "q"), key, "full_outer")
    return rows.groupBy("source_code").agg(
        F.count("b").alias("before"), F.count("a").alias("after"), F.count("q").alias("queued"),
        F.count_if(F.col("b").isNotNull() & F.col("a").isNull() & F.col("q").isNull()).alias("lost"),
    )


def upgrade_names(parks: DataFrame, official: DataFrame) -> DataFrame:
    """Parks without a name take the one specific official name (id, official_name) if there is just one."""
    names = official.where(~is_generic("official_name")).groupBy("id").agg(F.collect_set("official_name").alias("_names"))
    joined = parks.join(names, "id", "left")
    takes = is_generic("name") & (F.size("_names") == 1)
    return joined.withColumn("name_status", F.when(takes, "municipal").otherwise(F.col("name_status"))).withColumn("name", F.when(takes, F.get("_names", F.lit(0))).otherwise(F.col("name"))).drop("_names")


def with_export_defaults(parks: DataFrame, details: DataFrame) -> DataFrame:
    """Source label, name status and url as exported: details (id, name_source, name_source_url) where known."""
    d = details.select("id", F.col("name_source").alias("_s"), F.col("name_source_url").alias("_u"))
    joined = parks.join(d, "id", "left")
    status = F.when(is_generic("name"), "missing").otherwise(F.coalesce("name_status", F.lit("source")))
    source = F.coalesce("source", F.when(F.col("osm_id").isNotNull(), "OpenStreetMap").otherwise(F.lit("municipal")))
    return joined.withColumn("source", source).withColumn("name_status", status).withColumn("name_source", F.coalesce("name_source", "_s")).withColumn("name_source_url", F.coalesce("name_source_url", "_u")).drop("_s", "_u")


IDENTITY = ("osm_id", "name", "city", "district", "latitude", "longitude", "source", "name_source", "name_source_url")


def upsert_parks(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Full outer by id: data columns come from the incoming row, the activity flag and reviewed community names stay, a
    blank address is filled. Parks that aren't incoming stay as they are."""
    c, n = current.alias("c"), incoming.withColumn("_in", F.lit(True)).alias("n")
    j = c.join(n, F.col("c.id") == F.col("n.id"), "full_outer")
    is_in, had = F.col("n._in").isNotNull(), F.col("c.id").isNotNull()
    reviewed = had & (F.col("c.name_status") == "community")

    def pick(col: str):
        if col == "id":
            return F.coalesce("c.id", "n.id")
        if col == "active":
            return F.coalesce("c.active", F.lit(True))
        if col == "address_label":
            return F.coalesce(F.nullif("c.address_label", F.lit("")), F.col("n.address_label") if "address_label" in incoming.columns else F.lit(None).cast("string"))
        if col not in incoming.columns:
            return F.col(f"c.{col}")
        kept = F.coalesce(reviewed, F.lit(False)) & F.lit(col in ("name", "name_status", "name_source", "name_source_url"))
        return F.when(is_in & ~kept, F.col(f"n.{col}")).otherwise(F.col(f"c.{col}"))

    return j.select(*(pick(col).alias(col) for col in current.columns))


def upsert_refs(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Refs by (source_code, external_id): (new table, counts of inserted and updated), rows that don't change stay."""
    key = ["source_code", "external_id"]
    data = [c for c in incoming.columns if c not in key]
    n = incoming.select(*key, *(F.col(c).alias(f"_n_{c}") for c in data), F.lit(True).alias("_in"))
    j = current.withColumn("_had", F.lit(True)).join(n, key, "full_outer")
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in data))
    j = j.withColumn("_write", F.col("_in").isNotNull() & (F.col("_had").isNull() | differs))
    counts = j.agg(F.count_if(F.col("_write") & F.col("_had").isNull()).alias("inserted"), F.count_if(F.col("_write") & F.col("_had").isNotNull()).alias("updated"))
    table = j.select(*key, *(F.when(F.col("_write"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in data else F.col(c) for c in current.columns if c not in key))
    return table.select(*current.columns), counts


def restore_activity(parks: DataFrame, saved: DataFrame, columns: list[str]) -> DataFrame:
    """Authoritative identity columns with the saved activity ``columns`` laid over them."""
    own = saved.select("id", *(F.col(c).alias(f"_s_{c}") for c in columns))
    out = parks.join(own, "id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_s_{c}", c) if c in parks.columns else F.col(f"_s_{c}"))
    return out.drop(*(f"_s_{c}" for c in columns))


def inventory(tables: dict[str, DataFrame], bundle_parks: DataFrame, bundle_refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read-only: (table, rows) of every table, and (kind, id) of parks and refs that only the registry has."""
    counts = reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()))
    parks = tables["parks"].join(bundle_parks, "id", "left_anti").select(F.lit("park").alias("kind"), "id")
    refs = tables["refs"].join(bundle_refs, ["source_code", "external_id"], "left_anti").select(F.lit("ref").alias("kind"), F.concat_ws("/", "source_code", "external_id").alias("id"))
    return counts, parks.unionByName(refs)


def audit_registry(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(city, kind, parks, missing_names, missing_districts) and the possible duplicates."""
    kind = F.when(F.col("osm_id").isNull(), "municipal").otherwise(F.split_part("osm_id", F.lit("/"), F.lit(1)))
    counts = registry.groupBy("city", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("parks"), F.count_if(is_generic("name")).alias("missing_names"), F.count_if(F.coalesce(F.trim("district"), F.lit("")) == "").alias("missing_districts")
    )
    return counts, possible_duplicates(registry)
