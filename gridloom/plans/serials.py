"""Sources whose ids are serial numbers: snapshots, companions, scope, validation (JN-10..12, AGG-14, JOB-16, JOB-17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ids import encode_serial, is_uuid
from gridloom.functions.session import saved
from gridloom.operators.spatial import ANYWHERE, cross_resource_duplicates, within_radius

KEY = ["package_uuid", "resource_uuid", "serial"]
SAME_M = 0.5


def compare_snapshots(before: DataFrame, after: DataFrame, reuse_m: float = 200, remap_m: float = 10) -> DataFrame:
    """(package, resource, serial, status, n) of resources that both snapshots have: ADDED, UNCHANGED, REMAPPED (now where
    another serial of the resource was), SERIAL_REUSED (far off), NORMAL_ATTRIBUTE_CHANGE, REMOVED. Each row of a serial is
    compared with each of its rows in the other snapshot, and ``n`` says how many pairs (or rows without any) have the
    status. Only pairs within ``reuse_m`` are looked at; the others follow from the numbers of rows."""
    both = before.select(*KEY[:2]).distinct().join(after.select(*KEY[:2]).distinct(), KEY[:2])
    b, a = (saved(_places(df.join(both, KEY[:2], "left_semi")), name) for df, name in ((before, "before"), (after, "after")))
    held = b.groupBy(*KEY[:2], "latitude", "longitude").agg(F.min("serial").alias("least"), F.max("serial").alias("most"))
    moved = within_radius(a.select(*KEY, "latitude", "longitude").distinct(), held, remap_m, KEY[:2]).where("a.serial <> b.least or a.serial <> b.most")
    remapped = moved.select(*(F.col(f"a.{k}").alias(k) for k in KEY)).distinct().withColumn("_remap", F.lit(True))
    d, pairs = F.col("distance_m"), F.col("a.n") * F.col("b.n")
    same = (F.col("a.name") == F.col("b.name")) & (d <= SAME_M)
    near = within_radius(a, b, max(reuse_m, SAME_M), KEY, most_lat=85.0, box=ANYWHERE).groupBy(*(F.col(f"a.{k}").alias(k) for k in KEY)).agg(
        F.sum(F.when(same, pairs).otherwise(0)).alias("_same"), F.sum(F.when(~same & (d <= reuse_m), pairs).otherwise(0)).alias("_near")
    )
    # without a distance, rows of equal name and latitude are the same
    level = [*KEY, "name", "latitude"]
    x, y = _sums(a, level, "a").alias("x"), _sums(b, level, "b").alias("y")
    flat = x.join(y, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in level[:-1]] + [F.col("x.latitude").eqNullSafe(F.col("y.latitude"))])
    flat = flat.groupBy(*(F.col(f"x.{k}").alias(k) for k in KEY)).agg(F.sum(F.expr("_na * _nb - _la * _lb")).alias("_flat"))
    rows = _sums(b, KEY, "b").join(_sums(a, KEY, "a"), KEY, "full_outer").join(near, KEY, "left").join(flat, KEY, "left").join(remapped, KEY, "left")
    rows = rows.na.fill(0, ["_na", "_nb", "_la", "_lb", "_same", "_near", "_flat"])
    unchanged, far = F.expr("_same + _flat"), F.expr("_la * _lb - _same - _near")
    told = lambda **n: F.array(*(F.struct(F.lit(status).alias("status"), c.alias("n")) for status, c in n.items()))
    counts = (
        F.when(F.expr("serial is null or _nb = 0"), told(ADDED=F.expr("_na + _nb"))).when(F.col("_na") == 0, told(REMOVED=F.col("_nb")))
        .when(F.col("_remap"), told(UNCHANGED=unchanged, REMAPPED=F.expr("_na * _nb") - unchanged))
        .otherwise(told(UNCHANGED=unchanged, SERIAL_REUSED=far, NORMAL_ATTRIBUTE_CHANGE=F.expr("_na * _nb") - unchanged - far))
    )
    return rows.select(*KEY, F.inline(counts)).where("n > 0")


def _places(df: DataFrame) -> DataFrame:
    """(package, resource, serial, name, latitude, longitude, n): equal rows once."""
    return df.select(*KEY, F.coalesce("name", F.lit("")).alias("name"), "latitude", "longitude").groupBy(*KEY, "name", "latitude", "longitude").agg(F.count(F.lit(1)).alias("n"))


def _sums(places: DataFrame, by: list[str], side: str) -> DataFrame:
    """Rows of each key (_n), and those with coordinates (_l)."""
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return places.groupBy(*by).agg(F.sum("n").alias(f"_n{side}"), F.sum(F.when(located, F.col("n")).otherwise(0)).alias(f"_l{side}"))


def snapshot_flags(before: DataFrame, after: DataFrame, records: DataFrame, mass: float = 0.2, remap_m: float = 10) -> DataFrame:
    """(flag, package, resource, serial, other): RESOURCE_REPLACED, RESOURCE_MOVED, MASS_RENUMBERING."""
    res = lambda df: df.select(*KEY[:2]).distinct()
    gone, added = res(before).join(res(after), KEY[:2], "left_anti"), res(after).join(res(before), KEY[:2], "left_anti")
    none = F.lit(None).cast("string")
    replaced = gone.join(added.select("package_uuid", F.col("resource_uuid").alias("other")), "package_uuid").select(F.lit("RESOURCE_REPLACED").alias("flag"), *KEY[:2], none.alias("serial"), "other")
    lost = before.join(after, KEY, "left_anti")
    moved = within_radius(after, lost, remap_m, ["package_uuid", "serial"], most_lat=85.0, box=ANYWHERE).where("a.resource_uuid <> b.resource_uuid").select(F.lit("RESOURCE_MOVED").alias("flag"), "b.package_uuid", "b.resource_uuid", "b.serial", F.col("a.resource_uuid").alias("other"))
    share = records.where("status <> 'REMOVED'").groupBy(*KEY[:2]).agg(F.sum(F.when(F.col("status") == "REMAPPED", F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("total"))
    renumbered = share.where((F.col("n") > 0) & (F.col("n") / F.col("total") >= mass)).select(F.lit("MASS_RENUMBERING").alias("flag"), *KEY[:2], none.alias("serial"), none.alias("other"))
    return replaced.unionByName(moved).unionByName(renumbered)


def blockers(records: DataFrame, flags: DataFrame, resource: str | None = None, max_reused: int = 0) -> DataFrame:
    """(blocker) of a comparison, or of one resource's part of it."""
    if resource is not None:
        records = records.where(F.col("resource_uuid") == resource)
        flags = flags.where((F.col("resource_uuid") == resource) | (F.col("other") == resource))
    reused = records.where("status = 'SERIAL_REUSED'").agg(F.sum("n").alias("n")).where(F.col("n") > max_reused).select(F.lit("SERIAL_REUSED").alias("blocker"))
    return flags.select(F.col("flag").alias("blocker")).distinct().unionByName(reused)


def companion_coverage(features: DataFrame, companion: DataFrame, least: float = 0.95) -> DataFrame:
    """One row: counts, joined share, repeats, missing and orphan serials, passes. Both have a ``serial`` column."""
    f = features.select("serial").groupBy("serial").agg(F.count(F.lit(1)).alias("nf"))
    c = companion.select("serial").groupBy("serial").agg(F.count(F.lit(1)).alias("nc"))
    j = f.join(c, "serial", "full_outer")
    out = j.agg(
        F.coalesce(F.sum("nf"), F.lit(0)).alias("feature_count"), F.count("nf").alias("serial_count"), F.coalesce(F.sum("nc"), F.lit(0)).alias("table_rows"),
        F.coalesce(F.sum(F.when(F.col("nc").isNotNull(), F.col("nf"))), F.lit(0)).alias("joined_count"),
        F.count_if(F.col("nf").isNotNull() & F.col("nc").isNull()).alias("missing"), F.count_if(F.col("nf").isNull()).alias("orphans"),
        F.coalesce(F.sum(F.col("nf") - 1), F.lit(0)).alias("duplicate_serials"), F.coalesce(F.sum(F.col("nc") - 1), F.lit(0)).alias("duplicate_table_serials"),
    )
    share = F.when(F.col("feature_count") > 0, F.col("joined_count") / F.col("feature_count")).otherwise(0.0)
    return out.withColumn("join_coverage", share).withColumn("passes", (F.col("feature_count") > 0) & (F.col("join_coverage") >= least) & (F.col("duplicate_serials") == 0))


def package_scope_proof(upstream: DataFrame, loaded: DataFrame) -> DataFrame:
    """(package_uuid, proven, missing_resources, collisions): serials may be package-scoped if every upstream resource was
    loaded and no serial is in two rows; a missing serial is none."""
    missing = upstream.join(loaded.select(*KEY[:2]).distinct(), KEY[:2], "left_anti").groupBy("package_uuid").agg(F.count(F.lit(1)).alias("missing_resources"))
    serials = loaded.where("serial is not null").groupBy("package_uuid", "serial").agg(F.count(F.lit(1)).alias("n")).groupBy("package_uuid").agg(F.sum(F.col("n") - 1).alias("collisions"))
    rows = upstream.select("package_uuid").distinct().join(missing, "package_uuid", "left").join(serials, "package_uuid", "left").na.fill(0)
    return rows.withColumn("proven", (F.col("missing_resources") == 0) & (F.col("collisions") == 0))


def validate_serial_resource(records: DataFrame, license_status: DataFrame, companion: DataFrame | None = None, blocked: DataFrame | None = None, replaced: DataFrame | None = None, least_serials: float = 1.0) -> DataFrame:
    """(package, resource, status, failed) of every resource, checks A to I, failing closed. ``companion``: (package,
    resource, passes); ``blocked`` and ``replaced``: (package, resource)."""
    has = F.coalesce(F.trim("serial"), F.lit("")) != ""
    encoded = encode_serial("package_uuid", "resource_uuid", "serial")
    facts = records.withColumn("_has", has).withColumn("_id", encoded).groupBy(*KEY[:2]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_has").alias("with_serial"), F.count_distinct(F.when(F.col("_has"), F.trim("serial"))).alias("distinct_serials"),
        F.count("_id").alias("encoded"), F.count_distinct("_id").alias("distinct_ids"),
    )
    mark = lambda df, name: df.select(*KEY[:2]).distinct().withColumn(name, F.lit(True))
    j = facts.join(license_status.select(*KEY[:2], "license_status"), KEY[:2], "left")
    j = j.join(mark(companion.where("passes"), "_e"), KEY[:2], "left") if companion is not None else j.withColumn("_e", F.lit(None).cast("boolean"))
    j = j.join(mark(blocked, "_f"), KEY[:2], "left") if blocked is not None else j.withColumn("_f", F.lit(None).cast("boolean"))
    j = j.join(mark(replaced, "_h"), KEY[:2], "left") if replaced is not None else j.withColumn("_h", F.lit(None).cast("boolean"))
    checks = {
        "A": F.col("with_serial") / F.col("n") >= least_serials, "B": F.col("with_serial") == F.col("distinct_serials"), "C": is_uuid("package_uuid"), "D": is_uuid("resource_uuid"),
        "E": F.col("_e").isNotNull(), "F": F.col("_f").isNull(), "G": (F.col("encoded") == F.col("with_serial")) & (F.col("distinct_ids") == F.col("encoded")), "H": F.col("_h").isNull(), "I": F.col("license_status") == "SAFE_OPEN",
    }
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), k) for k, ok in checks.items())))
    status = F.when(F.exists("failed", lambda x: x != "I"), "BLOCKED_IDENTITY").when(F.size("failed") > 0, "BLOCKED_LICENSE").otherwise("READY_FOR_RECONCILIATION")
    return j.withColumn("failed", failed).select(*KEY[:2], status.alias("status"), "failed")


def serial_dry_run(records: DataFrame, license_status: DataFrame, companions: DataFrame, upstream: DataFrame, before: DataFrame | None = None) -> dict[str, DataFrame]:
    """All reports for a serial source: resources, scope, duplicates across resources, totals."""
    counts = records.groupBy(*KEY).agg(F.count(F.lit(1)).alias("nf")).join(companions.groupBy(*KEY).agg(F.count(F.lit(1)).alias("nc")), KEY, "left")
    covered = counts.groupBy(*KEY[:2]).agg((F.sum(F.when(F.col("nc").isNotNull(), F.col("nf")).otherwise(0)) / F.sum("nf")).alias("share"), F.max("nf").alias("most"))
    companion = covered.select(*KEY[:2], ((F.col("share") >= 0.95) & (F.col("most") == 1)).alias("passes"))
    blocked = replaced = None
    if before is not None:
        changes = compare_snapshots(before, records)
        flags = snapshot_flags(before, records, changes)
        reused = changes.where("status = 'SERIAL_REUSED'").select(*KEY[:2])
        blocked = flags.where("flag <> 'RESOURCE_REPLACED'").select(*KEY[:2]).unionByName(reused)
        replaced = flags.where("flag = 'RESOURCE_REPLACED'").select("package_uuid", F.col("other").alias("resource_uuid"))
    resources = validate_serial_resource(records, license_status, companion, blocked, replaced)
    keyed = records.withColumn("key", encode_serial("package_uuid", "resource_uuid", "serial"))
    return {
        "resources": resources, "scope": package_scope_proof(upstream, records), "duplicates": cross_resource_duplicates(keyed),
        "totals": resources.groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    }


def all_serials(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
