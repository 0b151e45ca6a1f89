"""Releases: bundle, validation, application as a pure function over tables (JOB-19, JOB-20, SNK-1, SNK-4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.session import saved
from gridloom.operators.activity import rekey_activity, rekey_favorites
from gridloom.plans.registry import upsert_parks, upsert_refs

#: Sort keys of the record sets of a bundle.
KEYS = {
    "parks": ["id"], "refs": ["source_code", "external_id"], "aliases": ["retired_id"], "tombstones": ["retired_id"],
    "reviews": ["source_code", "external_id"], "rejections": ["source_code", "external_id"],
}


def content_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """(rows, hash) that doesn't depend on partitioning: rows are hashed, grouped by the first byte of their hash, each
    group's sorted hashes are hashed, and so are the 65,536 groups' hashes."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    groups = df.select(row.alias("h")).groupBy(F.substring("h", 1, 4).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("gh"), F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "gh"))), lambda x: x["gh"]), ""), 256).alias("hash"))


def manifest(frames: dict[str, DataFrame]) -> DataFrame:
    """(artifact, rows, hash) of the record sets."""
    return reduce(DataFrame.unionByName, (content_hash(df, KEYS[name]).select(F.lit(name).alias("artifact"), "rows", "hash") for name, df in sorted(frames.items())))


def export_release(frames: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each record set, sorted, and the manifest below ``path``."""
    for name, df in frames.items():
        df.repartitionByRange(*KEYS[name]).sortWithinPartitions(*KEYS[name]).write.parquet(f"{path}/{name}")
    told = manifest(frames)
    told.coalesce(1).write.json(f"{path}/manifest")
    return told


def _rule(name: str, df: DataFrame, key: str) -> DataFrame:
    return df.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("id"))


def validate_bundle(frames: dict[str, DataFrame], expected: DataFrame | None = None) -> DataFrame:
    """(rule, id) of every violation of a bundle."""
    parks, refs, aliases, tombs, reviews, rejections = (frames[k] for k in KEYS)
    ref = ["source_code", "external_id"]
    keyed = lambda df: df.withColumn("_k", F.concat_ws("/", *ref))
    found = []
    for name, df in frames.items():
        found.append(_rule(f"repeated_{name}", df.groupBy(F.concat_ws("/", *KEYS[name]).alias("_k")).count().where("count > 1"), "_k"))
    live = parks.select(F.col("id").alias("survivor_id"))
    retired = aliases.select("retired_id").union(tombs.select("retired_id"))
    found += [
        _rule("ref_without_park", keyed(refs.join(parks.select(F.col("id").alias("park_id")), "park_id", "left_anti")), "_k"),
        _rule("alias_without_survivor", aliases.join(live, "survivor_id", "left_anti"), "retired_id"),
        _rule("alias_of_itself", aliases.where("retired_id = survivor_id"), "retired_id"),
        _rule("alias_chain", aliases.join(retired.select(F.col("retired_id").alias("survivor_id")), "survivor_id", "left_semi"), "retired_id"),
        _rule("retired_but_live", retired.join(parks.select(F.col("id").alias("retired_id")), "retired_id", "left_semi"), "retired_id"),
        _rule("alias_and_tombstone", aliases.join(tombs, "retired_id", "left_semi"), "retired_id"),
        _rule("review_and_rejection", keyed(reviews.join(rejections, ref, "left_semi")), "_k"),
        _rule("rejected_but_served", keyed(rejections.join(refs, ref, "left_semi")), "_k"),
    ]
    if expected is not None:
        both = manifest(frames).alias("m").join(expected.alias("e"), "artifact", "full_outer")
        found.append(_rule("manifest", both.where("not (m.rows <=> e.rows) or not (m.hash <=> e.hash)"), "artifact"))
    return reduce(DataFrame.unionByName, found)


def classify_registry_only(parks: DataFrame, frames: dict[str, DataFrame], history: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(id, kind) of active parks that the bundle neither has nor retires: TEST_FIXTURE, SOURCE_WITHDRAWN with or without
    history, UNKNOWN (no source ref, which stops a release)."""
    known = frames["parks"].select("id").union(frames["aliases"].select("retired_id")).union(frames["tombstones"].select("retired_id"))
    only = parks.where("active").join(known, "id", "left_anti")
    fx, hist = fixtures.select("id").distinct().withColumn("_f", F.lit(True)), history.select(F.col("park_id").alias("id")).distinct().withColumn("_h", F.lit(True))
    j = only.join(fx, "id", "left").join(hist, "id", "left")
    kind = F.when(F.col("_f"), "TEST_FIXTURE").when(F.col("osm_id").isNull() & (F.coalesce(F.size("source_refs"), F.lit(0)) <= 0), "UNKNOWN").when(F.col("_h"), "SOURCE_WITHDRAWN_WITH_HISTORY").otherwise("SOURCE_WITHDRAWN")
    return j.select("id", kind.alias("kind"))


def apply_release(tables: dict[str, DataFrame], frames: dict[str, DataFrame], fixtures: DataFrame, acknowledged: bool = False, expected: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new tables, report). ``tables``: parks, refs, points, events, observations, favorites, suggestions, aliases,
    tombstones. Raises, and changes nothing, on an invalid bundle, an unknown park that only the registry has, or one
    withdrawn with history that isn't acknowledged. Applying a bundle twice gives the same tables."""
    bad = validate_bundle(frames, expected)
    if bad.limit(1).count():
        raise ValueError(f"invalid bundle: {[tuple(r) for r in bad.limit(5).collect()]}")
    history = tables["events"].select("park_id").union(tables["observations"].select("park_id"))
    only = saved(classify_registry_only(tables["parks"], frames, history, fixtures), "registry-only")
    stop = ["UNKNOWN"] if acknowledged else ["UNKNOWN", "SOURCE_WITHDRAWN_WITH_HISTORY"]
    stopped = only.where(F.col("kind").isin(stop))
    if stopped.limit(1).count():
        raise ValueError(f"registry-only parks: {[tuple(r) for r in stopped.limit(5).collect()]}")
    aliases, tombs = frames["aliases"], frames["tombstones"]
    withdrawn = only.where("kind like 'SOURCE_WITHDRAWN%'").select(F.col("id").alias("retired_id"), F.lit("source_withdrawn").alias("kind"))
    retired = aliases.select("retired_id").union(tombs.select("retired_id")).union(withdrawn.select("retired_id")).withColumn("_r", F.lit(True))
    parks = upsert_parks(tables["parks"], frames["parks"])
    parks = parks.join(retired.withColumnRenamed("retired_id", "id").distinct(), "id", "left").withColumn("active", F.col("active") & F.col("_r").isNull()).drop("_r")
    general = frames["parks"].select("id", F.col("id").alias("park_id"), F.lit("Genel").alias("name"), "latitude", "longitude", F.lit(True).alias("active"))
    points = tables["points"].unionByName(general.join(tables["points"].select("id"), "id", "left_anti").select(*tables["points"].columns))
    points, events, observations = rekey_activity(points, tables["events"], tables["observations"], aliases)
    favorites, suggestions = rekey_favorites(tables["favorites"], tables["suggestions"], aliases)
    refs, counts = upsert_refs(tables["refs"], frames["refs"])
    gone = refs.join(frames["refs"].select("source_code", "external_id"), ["source_code", "external_id"], "left_anti").join(retired.select(F.col("retired_id").alias("park_id")).distinct(), "park_id", "left_semi")
    refs = refs.join(gone.select("source_code", "external_id"), ["source_code", "external_id"], "left_anti").select(*tables["refs"].columns)
    add = lambda old, new: old.unionByName(new.select(*old.columns).join(old.select("retired_id"), "retired_id", "left_anti").select(*old.columns))
    new = {
        "parks": parks.select(*tables["parks"].columns), "refs": refs, "points": points, "events": events, "observations": observations, "favorites": favorites, "suggestions": suggestions,
        "aliases": add(tables["aliases"], aliases), "tombstones": add(tables["tombstones"], tombs.unionByName(withdrawn, allowMissingColumns=True)),
    }
    kinds = only.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    report = kinds.select(F.concat(F.lit("registry_only_"), "kind").alias("what"), "n").unionByName(counts.select(F.lit("refs_inserted").alias("what"), F.col("inserted").alias("n"))).unionByName(counts.select(F.lit("refs_updated").alias("what"), F.col("updated").alias("n")))
    return new, report


def load_registry(parks: DataFrame, path: str) -> None:
    """Writes parks, refs and one general point a park as a new registry version; refuses a table with repeated ids."""
    if parks.groupBy("id").count().where("count > 1 or id is null").limit(1).count():
        raise ValueError("repeated or missing park ids")
    parks.drop("source_refs").write.parquet(f"{path}/parks")
    parks.select(F.col("id").alias("park_id"), F.explode("source_refs").alias("r")).select("park_id", "r.*").write.parquet(f"{path}/refs")
    parks.select("id", F.col("id").alias("park_id"), F.lit("Genel").alias("name"), "latitude", "longitude", F.lit(True).alias("active")).write.parquet(f"{path}/points")
