import pytest
from pyspark.sql import functions as F

from gridloom.functions.text import UNNAMED
from gridloom.plans import consolidate as C
from gridloom.plans import readiness as Y
from gridloom.plans import registry as G
from gridloom.plans import release as L
from gridloom.plans import review as V
from gridloom.plans import serials as Z
from gridloom.plans.ingest import SourceConfig, ingest, name_upgrades, to_canonical

REFS = f"array<{G.REF}>"
PARK = f"id string, osm_id string, name string, city string, district string, latitude double, longitude double, source_refs {REFS}"


def province(spark):
    ring = [(26.0, 37.0), (28.0, 37.0), (28.0, 39.0), (26.0, 39.0), (26.0, 37.0)]
    return spark.createDataFrame([("P", *a, *b) for a, b in zip(ring, ring[1:])], "region string, x1 double, y1 double, x2 double, y2 double")


def registry(spark):
    return spark.createDataFrame([
        ("o1", "node/1", "Gazi Parkı", "P", "", 38.0, 27.0, []), ("o2", "node/2", UNNAMED, "P", "", 38.01, 27.0, []), ("o3", "node/3", "Zafer Parkı", "P", "", 38.02, 27.0, []),
        ("o4", "node/4", "Barış Parkı", "P", "", 38.03, 27.0, []), ("o5", "node/5", "Kuzey Parkı", "P", "", 38.04, 27.0, []), ("o6", "node/6", "Kuzey Parkı", "P", "", 38.0401, 27.0, []),
    ], PARK)


FEATURES = [
    ("1", "Gazi Parkı", "Park", 38.0001, 27.0), ("2", "Yeni Parkı", "Park", 38.0101, 27.0), ("3", "Başka Parkı", "Park", 38.0201, 27.0), ("4", "Barış Parkı", "Park", 38.0301, 27.0),
    ("5", "Barış Parkı", "Park", 38.0299, 27.0), ("6", "Kuzey Parkı", "Park", 38.04005, 27.0), ("7", "Uzak Parkı", "Park", 38.2, 27.0), ("8", "Okul", "Okul", 38.3, 27.0), ("9", "Dış Parkı", "Park", 41.0, 30.0),
    ("10", "Deniz Parkı", "Park", 5.0, 5.0), ("11", "Bozuk Parkı", "Park", None, None), (None, "Adsız", "Park", 38.0, 27.0), ("1", "Gazi Parkı", "Park", 38.0, 27.0), ("12", "Zafer Parkı", "Park", 38.0218, 27.0),
]
WANTED = {
    ("1", "MATCHED", None), ("2", "MATCHED", None), ("3", "REVIEW", "name_conflict_at_same_location"), ("4", "REVIEW", "shared_osm_target_conflict"), ("5", "REVIEW", "shared_osm_target_conflict"),
    ("6", "REVIEW", "multiple_osm_candidates"), ("7", "NEW", None), ("8", "REJECTED_NON_PARK", "taxonomy"), ("9", "PROVINCE_MISMATCH", None), ("10", "INVALID", "invalid_coordinate"),
    ("11", "INVALID", "invalid_geometry"), (None, "INVALID", "missing_id"), ("1", "INVALID", "duplicate_id"), ("12", "REVIEW", "possible_match_outside_primary_radius"),
}


def test_ingest_gives_each_row_one_outcome(spark):
    cfg = SourceConfig("s", "S", "https://example.org/d", "ns", "P", allowed_taxonomy=("Park",), tiers_m=(25, 150))
    f = spark.createDataFrame([(*r, i) for i, r in enumerate(FEATURES)], "external_id string, name string, taxonomy string, latitude double, longitude double, position int")
    out = ingest(f, registry(spark), province(spark), cfg).cache()
    rows = [(r["external_id"], r["outcome"], r["reason"]) for r in out.collect()]
    assert set(rows) == WANTED and len(rows) == len(FEATURES)
    up = name_upgrades(out, f, registry(spark)).collect()
    assert [tuple(r) for r in up] == [("o2", UNNAMED, "Yeni Parkı")]
    with pytest.raises(ValueError):
        ingest(f, registry(spark), province(spark), SourceConfig("s", "S", "u", "ns", "P", license_status="UNKNOWN"))


def test_new_parks_have_their_ref(spark):
    good = spark.createDataFrame([("7", "Uzak Parkı", "", 38.2, 27.0)], "external_id string, name string, district string, latitude double, longitude double")
    p = to_canonical(good, SourceConfig("s", "S", "https://example.org/d", "ns", "P")).first()
    assert p["source_refs"][0]["source_url"] == "https://example.org/d#id_7" and p["name_status"] == "municipal" and p["id"][14] == "5"


def test_merge_and_invariants(spark):
    base = registry(spark)
    refs = spark.createDataFrame([("o1", "s", "1", "u")], "id string, source_code string, external_id string, source_url string")
    new = base.limit(1).withColumn("id", F.lit("n1")).withColumn("osm_id", F.lit(None).cast("string"))
    merged = G.merge(base, refs, new)
    assert G.check_invariants(base, merged).count() == 0 and merged.count() == 7
    broken = merged.withColumn("name", F.when(F.col("id") == "o3", "X").otherwise(F.col("name"))).where("id <> 'o4'").unionByName(merged.where("id = 'o5'"))
    assert {r["rule"] for r in G.check_invariants(merged, broken).collect()} == {"mutated", "lost_park", "duplicate_id", "duplicate_osm_id"}
    conflicts = G.identity_conflicts(new.withColumn("osm_id", F.lit("node/1")), base)
    assert [r["kind"] for r in conflicts.collect()] == ["osm_id"]


def test_refresh_keeps_refs_and_upgrades(spark):
    old = spark.createDataFrame([("o1", "node/1", "Gazi Parkı", "municipal", [("s", "1", None)]), ("o2", "node/2", "Gone", "source", [("s", "2", None)]), ("m1", None, "Own", "municipal", [("s", "3", None)])], f"id string, osm_id string, name string, name_status string, source_refs {REFS}")
    fresh = spark.createDataFrame([("o1", "node/1", UNNAMED, "missing"), ("o9", "node/9", "New", "source")], "id string, osm_id string, name string, name_status string")
    new, review = G.refresh_reconcile(old, fresh)
    found = {r["id"]: (r["name"], len(r["source_refs"])) for r in new.collect()}
    assert found == {"o1": ("Gazi Parkı", 1), "o9": ("New", 0), "m1": ("Own", 1)}
    assert [r["id"] for r in review.collect()] == ["o2"]


def review_inputs(spark):
    rec = "key string, source_code string, external_id string, name string, city string, district string, latitude double, longitude double, tier2_m double, order_id int, trustworthy boolean, texts string, component string"
    rows = [
        ("s:1", "s", "1", "Gazi Parkı", "P", "", 38.0005, 27.0, 100.0, 1, True, "", "s:1"), ("s:2", "s", "2", "Bambaşka Parkı", "P", "", 38.5, 27.0, 100.0, 2, True, "", "s:2"),
        ("s:3", "s", "3", "Yol", "P", "", 38.6, 27.0, 100.0, 3, False, "bisiklet yolu", "s:3"), ("s:4", "s", "4", "Park", "P", "", 38.0101, 27.0, 100.0, 4, True, "", "s:4"),
        ("s:5", "s", "5", "Ikiz Bahçe Yeri", "P", "", 38.7, 27.0, 100.0, 5, True, "", "s:5"), ("s:6", "s", "6", "Ikiz Bahçe Yeri", "P", "", 38.7, 27.0001, 100.0, 6, True, "", "s:5"),
    ]
    return spark.createDataFrame(rows, rec).withColumn("polys", F.lit(None).cast("array<array<array<array<double>>>>"))


def test_review_chain(spark):
    rec = review_inputs(spark)
    parks = registry(spark).withColumn("polys", F.lit(None).cast("array<array<array<array<double>>>>"))
    cand = V.review_candidates(rec, parks).cache()
    assert {(r["key"], r["park_id"], r["strong"]) for r in cand.collect()} == {("s:1", "o1", True), ("s:4", "o2", False)}
    sizes = rec.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("order_id").alias("first_id"))
    clusters = sizes.join(rec.select("key", "component"), "component").withColumn("ambiguous", F.lit(False)).withColumn("ambiguous_cluster", F.lit(False))
    ev = V.new_safe(V.review_evidence(rec.drop("component"), cand, clusters)).cache()
    rivals = V.park_rivals(rec.drop("component"), parks, clusters)
    assert [tuple(r) for r in rivals.collect()] == [("o2", "s", "s:4", 1)]
    targets = V.record_targets(ev, cand, rivals)
    mates = V.accepted_mates(rec.withColumn("status", F.lit("review")).withColumn("canonical_id", F.lit(None).cast("string")))
    got = {r["key"]: (r["outcome"], r["target_id"]) for r in V.resolve_reviews(ev, targets, mates).collect()}
    assert got == {
        "s:1": ("MATCH_EXISTING", "o1"), "s:2": ("NEW_CANONICAL_SAFE", None), "s:3": ("REJECT_NON_PARK", None), "s:4": ("MATCH_EXISTING", "o2"),
        "s:5": ("NEW_CANONICAL_SAFE", None), "s:6": ("REJECT_DUPLICATE", None),
    }
    decisions = V.resolve_reviews(ev, targets, mates)
    after = V.apply_resolution(registry(spark), rec, decisions, "ns")
    assert after.count() == 8 and after.where("size(source_refs) > 0").count() == 4


def test_consolidation_and_manifest(spark):
    rows = [("1", "c", "accepted_municipal_new", "m1", 1), ("2", "c", "accepted_municipal_new", "m2", 2), ("3", "d", "accepted_osm_matched", "o1", 3), ("4", "d", "accepted_municipal_new", "m4", 4), ("5", "e", "accepted_osm_matched", "o2", 5), ("6", "e", "accepted_osm_matched", "o3", 6)]
    d = C.survivors(spark.createDataFrame(rows, "id string, component string, status string, canonical_id string, order_id int"))
    assert {r["component"]: (r["action"], r["survivor_id"], r["retired"]) for r in d.collect()} == {"c": ("consolidate", "m1", ["m2"]), "d": ("consolidate", "o1", ["m4"]), "e": ("no_consolidation", None, [])}
    reg = spark.createDataFrame([("m1", None, [("s", "1", None)]), ("m2", None, [("s", "2", None)]), ("o1", "node/1", []), ("m4", None, [("s", "4", None)])], f"id string, osm_id string, source_refs {REFS}")
    new, retired = C.consolidate(reg, None, d, "s")
    assert {r["id"]: len(r["source_refs"]) for r in new.collect()} == {"m1": 2, "o1": 1}
    demoted = spark.createDataFrame([("m1", "c", "NON_PARK")], "id string, component string, taxonomy_class string")
    m = {r["retired_id"]: (r["action"], r["survivor_id"]) for r in C.lifecycle_manifest(retired, demoted).collect()}
    assert m == {"m2": ("TOMBSTONE_NON_PARK", None), "m4": ("ALIAS_REDIRECT", "o1"), "m1": ("TOMBSTONE_NON_PARK", None)}


def test_taxonomy_gate(spark):
    rows = [("a", True, True, False, False), ("b", True, False, False, False), ("c", False, False, True, False), ("d", False, True, False, True), ("e", True, True, False, False)]
    m = spark.createDataFrame(rows, "component string, name_park_word boolean, layer_park_token boolean, non_park_keyword boolean, facility_name boolean").withColumn("green_space_name", F.lit(False))
    s = spark.createDataFrame([("b", True, False), ("e", True, True)], "component string, linear boolean, path_like boolean")
    found = {r["component"]: r["taxonomy_class"] for r in C.taxonomy_gate(m, s).collect()}
    assert found == {"a": "PARK_CONFIRMED", "b": "TAXONOMY_AMBIGUOUS", "c": "NON_PARK", "d": "TAXONOMY_AMBIGUOUS", "e": "PARK_LIKELY"}


def release_inputs(spark):
    parks = spark.createDataFrame([("live", "node/1", "Gazi", True, "source"), ("old", None, "Eski", True, "source")], "id string, osm_id string, name string, active boolean, name_status string").withColumn("source_refs", F.array(F.struct(F.lit("s").alias("source_code"))))
    refs = spark.createDataFrame([("s", "1", "old", "u")], "source_code string, external_id string, park_id string, source_url string")
    points = spark.createDataFrame([("live", "live", "Genel", 38.0, 27.0, True), ("old", "old", "Genel", 38.0, 27.0, True)], "id string, park_id string, name string, latitude double, longitude double, active boolean")
    tables = {
        "parks": parks, "refs": refs, "points": points, "events": spark.createDataFrame([("e1", "old", "old")], "id string, point_id string, park_id string"),
        "observations": spark.createDataFrame([], "id string, point_id string, park_id string"), "favorites": spark.createDataFrame([("u", "old", 1)], "user_id string, park_id string, created_at int"),
        "suggestions": spark.createDataFrame([], "id string, user_id string, park_id string, status string"), "aliases": spark.createDataFrame([], "retired_id string, survivor_id string"), "tombstones": spark.createDataFrame([], "retired_id string, kind string"),
    }
    frames = {
        "parks": spark.createDataFrame([("live", "node/1", "Gazi Parkı", 38.0, 27.0)], "id string, osm_id string, name string, latitude double, longitude double"),
        "refs": spark.createDataFrame([("s", "1", "live", "u")], "source_code string, external_id string, park_id string, source_url string"),
        "aliases": spark.createDataFrame([("old", "live")], "retired_id string, survivor_id string"), "tombstones": spark.createDataFrame([], "retired_id string, kind string"),
        "reviews": spark.createDataFrame([], "source_code string, external_id string"), "rejections": spark.createDataFrame([], "source_code string, external_id string"),
    }
    return tables, frames


def test_release(spark):
    tables, frames = release_inputs(spark)
    none = spark.createDataFrame([], "id string")
    new, report = L.apply_release(tables, frames, none)
    assert {(r["id"], r["name"], r["active"]) for r in new["parks"].collect()} == {("live", "Gazi Parkı", True), ("old", "Eski", False)}
    assert [tuple(r) for r in new["events"].collect()] == [("e1", "live", "live")] and [r["park_id"] for r in new["favorites"].collect()] == ["live"]
    assert [r["id"] for r in new["points"].collect()] == ["live"] and [r["park_id"] for r in new["refs"].collect()] == ["live"]
    assert {r["what"]: r["n"] for r in report.collect()} == {"refs_inserted": 0, "refs_updated": 1}
    again, report = L.apply_release(new, frames, none)
    assert all(sorted(map(str, again[t].collect())) == sorted(map(str, new[t].collect())) for t in new)
    assert {r["what"]: r["n"] for r in report.collect()} == {"refs_inserted": 0, "refs_updated": 0}
    with pytest.raises(ValueError, match="alias"):
        L.apply_release(tables, frames | {"aliases": spark.createDataFrame([("old", "nowhere")], "retired_id string, survivor_id string")}, none)
    with pytest.raises(ValueError, match="registry-only"):
        L.apply_release(tables, frames | {"aliases": frames["aliases"].where("false")}, none)
    with pytest.raises(ValueError, match="manifest"):
        L.apply_release(tables, frames, none, expected=L.manifest(frames).withColumn("hash", F.lit("x")))


def test_manifest_is_independent_of_partitions(spark, tmp_path):
    _, frames = release_inputs(spark)
    again = {k: v.repartition(7) for k, v in frames.items()}
    assert sorted(map(tuple, L.manifest(frames).collect())) == sorted(map(tuple, L.manifest(again).collect()))
    L.export_release(frames, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "parks")).count() == 1


def test_serials(spark):
    u, w = "0f8fad5b-d9cb-469f-a165-70867728950e", "7c9e6679-7425-40de-944b-e07fc1f90ae7"
    kind = "package_uuid string, resource_uuid string, serial string, name string, latitude double, longitude double"
    before = spark.createDataFrame([(u, w, "1", "A", 38.0, 27.0), (u, w, "2", "B", 38.01, 27.0), (u, w, "3", "C", 38.02, 27.0)], kind)
    after = spark.createDataFrame([(u, w, "1", "B", 38.01, 27.0), (u, w, "2", "B", 38.01, 27.0), (u, w, "4", "D", 38.03, 27.0)], kind)
    ch = Z.compare_snapshots(before, after)
    assert {r["serial"]: r["status"] for r in ch.collect()} == {"1": "REMAPPED", "2": "UNCHANGED", "3": "REMOVED", "4": "ADDED"}
    flags = Z.snapshot_flags(before, after, ch)
    assert [r["flag"] for r in flags.collect()] == ["MASS_RENUMBERING"]
    assert [r["blocker"] for r in Z.blockers(ch, flags, w).collect()] == ["MASS_RENUMBERING"]
    lic = spark.createDataFrame([(u, w, "SAFE_OPEN")], "package_uuid string, resource_uuid string, license_status string")
    ok = spark.createDataFrame([(u, w, True)], "package_uuid string, resource_uuid string, passes boolean")
    assert Z.validate_serial_resource(after, lic, ok).first()["status"] == "READY_FOR_RECONCILIATION"
    assert Z.validate_serial_resource(after.union(after.limit(1)), lic, ok).first()["failed"] == ["B", "G"]
    assert Z.validate_serial_resource(after, lic.withColumn("license_status", F.lit("X")), ok).first()["status"] == "BLOCKED_LICENSE"
    reports = Z.serial_dry_run(after, lic, after.select("package_uuid", "resource_uuid", "serial"), after.select("package_uuid", "resource_uuid"), before)
    assert reports["resources"].first()["failed"] == ["F"] and reports["scope"].first()["proven"]


def test_repeated_serials_are_counted_not_paired(spark):
    import math
    import random
    from collections import Counter

    kind = "package_uuid string, resource_uuid string, serial string, name string, latitude double, longitude double"
    dice = random.Random(3)
    place = lambda: (dice.choice([38.0, 38.0 + 3e-6, 38.0005, 38.01, 38.5, None, 95.0, math.nan]), dice.choice([27.0, 27.0 + 2e-6, 27.001, 27.2, None]))
    rows = lambda n, serials: [("p", dice.choice("rs"), dice.choice(serials), dice.choice(["A", "B", "", None]), *place()) for _ in range(n)]
    b, a = rows(120, ["1", "2", "3", None]), rows(110, ["1", "2", "4", None]) + [("p", "t", "1", "A", 38.0, 27.0)]
    b += [("p", "r", "7", "A", 39.0, 28.0)] * 2 + [("p", "r", "8", "A", 39.3, 28.0)]
    a += [("p", "r", "7", "A", 39.3, 28.0)] * 3 + [("p", "r", "8", "B", 39.5, 28.0)] * 2

    def metres(x, y):
        if None in (*x[4:], *y[4:]):
            return None
        p, q = math.radians(x[4]), math.radians(y[4])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(y[5] - x[5]) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1.0, math.sqrt(h))) if h == h else math.nan

    told = Counter()
    a, b = [r for r in a if r[1] in "rs"], [r for r in b if r[1] in "rs"]
    bounded = lambda r: r[4] is not None and abs(r[4]) <= 85 and r[5] is not None
    remapped = {x[:3] for x in a for y in b if x[:2] == y[:2] and x[2] and y[2] and x[2] != y[2] and bounded(x) and bounded(y) and metres(x, y) <= 10}
    for x in a:
        told[(*x[:3], "ADDED")] += x[2] is None or not any(x[:3] == y[:3] for y in b)
        for y in b:
            if x[:3] == y[:3] and x[2]:
                d = metres(x, y)
                same = (x[3] or "") == (y[3] or "") and (x[4] == y[4] or x[4] != x[4] and y[4] != y[4] if d is None else d <= 0.5)
                told[(*x[:3], "UNCHANGED" if same else "REMAPPED" if x[:3] in remapped else "SERIAL_REUSED" if d is not None and not d <= 200 else "NORMAL_ATTRIBUTE_CHANGE")] += 1
    for y in b:
        told[(*y[:3], "ADDED" if y[2] is None else "REMOVED")] += y[2] is None or not any(x[:3] == y[:3] for x in a)
    found = Counter()
    for r in Z.compare_snapshots(spark.createDataFrame(b, kind), spark.createDataFrame(a, kind)).collect():
        found[tuple(r)[:4]] += r["n"]
    assert found == Counter({k: n for k, n in told.items() if n})

    many = spark.range(4000).select(F.lit("p").alias("package_uuid"), F.lit("r").alias("resource_uuid"), F.lit("1").alias("serial"), F.lit("A").alias("name"), (35 + F.col("id") * 1e-3).alias("latitude"), F.lit(27.0).alias("longitude"))
    shifted = many.withColumn("latitude", F.col("latitude") + 1e-3)
    assert {tuple(r)[3:] for r in Z.compare_snapshots(many, shifted).collect()} == {("UNCHANGED", 3999), ("NORMAL_ATTRIBUTE_CHANGE", 7998), ("SERIAL_REUSED", 16_000_000 - 3999 - 7998)}


def test_a_park_of_many_refs_holds_each_once(spark):
    """Time grows with the refs, not with their square: 60,000 of one park."""
    import time

    from gridloom.plans.registry import REF, attach_refs

    ref = lambda k: F.struct(F.lit("s").alias("source_code"), k.cast("string").alias("external_id"), F.lit(None).cast("string").alias("source_url"))
    held = spark.range(40_000).groupBy(F.lit("p").alias("id")).agg(F.collect_list(ref(F.col("id"))).alias("source_refs"))
    registry = held.unionByName(spark.createDataFrame([("q", None), ("r", [("s", "2", None), ("s", "1", None), ("s", "2", None)])], f"id string, source_refs array<{REF}>"))
    began = time.time()
    told = attach_refs(registry, spark.range(20_000, 60_000).select(F.lit("p").alias("id"), ref(F.col("id")).alias("r")).select("id", "r.*")).cache()
    assert {r["id"]: r["n"] for r in told.select("id", F.size("source_refs").alias("n")).collect()} == {"p": 60_000, "q": 0, "r": 2}
    assert time.time() - began < 20
    assert [x["external_id"] for x in told.where("id = 'r'").first()["source_refs"]] == ["1", "2"]
    told.unpersist()


def test_readiness_helpers(spark):
    orgs = spark.createDataFrame([("İzmir Belediyesi",), ("Konya",), ("Van",)], "org string")
    ev = spark.createDataFrame([("izmir belediyesi", "SAFE_OPEN", "CC-BY", 1), ("Konya", "SAFE_OPEN", "genel", 1), ("Van", "SAFE_OPEN", "CC0", 1)], "org string, status string, label string, priority int")
    s = Y.license_status(orgs, ev, spark.createDataFrame([("VAN",)], "org string"), ("Genel",))
    assert {tuple(r) for r in s.collect()} == {("İzmir Belediyesi", "SAFE_OPEN"), ("Konya", "UNKNOWN"), ("Van", "UNKNOWN")}
    f = spark.createDataFrame([("CSV", "ad;enlem;boylam\n"), ("csv", "ad;adres\n"), ("JSON", '{"type": "FeatureCollection"}'), ("shp", None), (None, None)], "format string, sample string")
    assert [r["format_class"] for r in Y.classify_format(f).collect()] == ["csv_coordinates", "csv_table", "geojson", "archive", "other"]


def test_official_clusters(spark):
    m = spark.createDataFrame([("a", "o1", False), ("a", None, False), ("b", "o1", False), ("b", "o2", False), ("c", None, False), ("d", "o3", True)], "component string, anchor_id string, needs_review boolean")
    assert {r["component"]: r["decision"] for r in C.anchor_clusters(m).collect()} == {"a": "attach", "b": "review", "c": "official_only", "d": "review"}


def test_enrichment_leaves_conflicts_to_people(spark):
    def square(region, x, y):
        c = [(x, y), (x + 0.001, y), (x + 0.001, y + 0.001), (x, y + 0.001), (x, y)]
        return [(region, *a, *b) for a, b in zip(c, c[1:])]

    at = [(i, "İsimsiz park", "", 38.0005, 27.0005 + 0.01 * i, "") for i in range(5)]
    parks = spark.createDataFrame(at + [(9, "Zafer Parkı", "D", 38.0005, 27.2, "")], "id int, name string, district string, latitude double, longitude double, address_label string")
    edges = spark.createDataFrame([e for r, i in (("a", 0), ("b", 1), ("c", 3), ("d", 3)) for e in square(r, 27.0 + 0.01 * i, 38.0)], "region string, x1 double, y1 double, x2 double, y2 double")
    names = spark.createDataFrame([(r, f"Poly {r}") for r in "abcd"], "region string, name string")
    points = spark.createDataFrame([("1", "Poly a", "Yeni", 38.00051, 27.0005), ("2", "Other", "", 38.00051, 27.0105), ("3", "Point", "", 38.00051, 27.0205), ("4", "Point d", "", 38.00051, 27.0305), ("5", "Başka", "Eski", 38.00051, 27.2)], "id string, name string, neighborhood string, latitude double, longitude double")
    addresses = spark.createDataFrame([("Zafer Parkı", "D", "Sokak 1"), ("Point", "", "Sokak 2")], "name string, district string, address string")
    told = {r["id"]: (r["name"], r["address_label"]) for r in C.enrich_catalog(parks, edges, names, points, edges.limit(0), addresses).collect()}
    assert told == {
        0: ("Poly a", "Yeni Mahallesi"),  # polygon and point agree
        1: ("İsimsiz park", None),  # polygon and point have different names
        2: ("Point", "Sokak 2"),  # no polygon holds it
        3: ("İsimsiz park", None),  # two polygons
        4: ("İsimsiz park", None), 9: ("Zafer Parkı", "Sokak 1"),
    }


def test_review_parses_names_once(spark):
    """Records that are parsed already are taken as they are, and tell the same candidates and evidence."""
    rec = review_inputs(spark).drop("component")
    parks = registry(spark).withColumn("polys", F.lit(None).cast("array<array<array<array<double>>>>"))
    parsed = V.parsed_records(rec)
    assert V.parsed_records(parsed) is parsed
    clusters = rec.select("key", F.col("key").alias("component"), F.lit(1).alias("size"), F.lit(False).alias("ambiguous"), F.lit(False).alias("ambiguous_cluster"), F.col("order_id").alias("first_id"))
    by_row, V.NAMES_HELD = V.NAMES_HELD, 0
    try:
        plain = V.review_candidates(rec, parks)
    finally:
        V.NAMES_HELD = by_row
    told = V.review_candidates(parsed, parks)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, told.select(*plain.columns).collect())) != []
    of = lambda r, c: sorted(map(repr, V.review_evidence(r, c, clusters).drop("polys").collect()))
    assert of(parsed, told) == of(rec, plain)


def test_catalog_joins_keep_tasks_small(spark):
    """Rows are spread by number, not by bytes: as many partitions as rows need, and more than the session's own number."""
    from gridloom.functions.session import spread

    own, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    rows = spark.range(1000).withColumn("x", F.col("id") * 0)
    assert spread(rows, "id", 10).rdd.getNumPartitions() == 100
    assert spread(rows, "id").rdd.getNumPartitions() in (4 * cores, 4 * cores + 1)
    joined = spread(rows, "id", 10).join(spark.range(1000).hint("merge"), "id")
    assert joined.rdd.getNumPartitions() == 100 and joined.count() == 1000 and own != 100
