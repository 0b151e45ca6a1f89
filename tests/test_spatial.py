import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom import views as V
from gridloom.functions import geo as G
from gridloom.functions.geo import lat_step, lon_step
from gridloom.operators import polygons as P
from gridloom.operators import regions as R
from gridloom.operators import spatial as S
from gridloom.operators.cover import box_pairs
from gridloom.operators.graph import star_components

SQUARE = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]], [[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6], [0.4, 0.4]]]]
POLY = "array<array<array<array<double>>>>"


def box(x, y, w, h):
    x, y = float(x), float(y)
    return [[[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]]


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_pairs_against_brute_force(spark):
    r = random.Random(3)
    pts = [(i, 38 + r.random() * 0.01, 27 + r.random() * 0.01) for i in range(120)] + [(900, None, 27.0), (901, 38.0, 27.0), (902, 38.0, 27.0)]
    df = spark.createDataFrame(pts, "id int, latitude double, longitude double")
    found = {(x["a"]["id"], x["b"]["id"]) for x in S.self_pairs(df, 150).collect()}
    good = [p for p in pts if p[1] is not None]
    assert found == {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and haversine(a[1:], b[1:]) <= 150}


def test_holes_and_outside(spark):
    edges = R.region_edges(spark.createDataFrame([("A", SQUARE), ("B", box(0.5, 0.5, 2, 2))], f"region string, polys {POLY}"))
    pts = spark.createDataFrame([("in", 0.2, 0.2), ("hole", 0.5, 0.45), ("out", 5.0, 5.0), ("both", 0.8, 0.8)], "id string, longitude double, latitude double")
    assert {tuple(x) for x in R.contained_in(pts, edges).collect()} == {("in", "A"), ("both", "A"), ("both", "B")}
    assert {(x["id"], x["method"]) for x in R.assign_region(pts, edges).collect()} == {("in", "contained"), ("hole", "unresolved"), ("out", "unresolved"), ("both", "ambiguous")}
    assert {x["id"] for x in R.unique_containment(pts, edges).collect()} == set()


def test_even_odd_and_area(spark):
    df = spark.createDataFrame([(0.2, 0.2, SQUARE[0]), (0.5, 0.5, SQUARE[0]), (3.0, 0.5, SQUARE[0])], "x double, y double, r array<array<array<double>>>")
    assert [x[0] for x in df.select(G.in_rings_even_odd("x", "y", "r")).collect()] == [True, False, False]
    one = df.limit(1).select(G.ring_area(F.col("r")[0]).alias("a"), G.ring_centroid(F.col("r")[0]).alias("c")).first()
    assert one["a"] == pytest.approx(1) and (one["c"]["lon"], one["c"]["lat"]) == pytest.approx((0.5, 0.5))


@pytest.mark.parametrize("polys,ok", [
    (SQUARE, True), ([], False), ([[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]]], False), ([[[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]]], False),
    ([[SQUARE[0][0], [[0.1, 0.1], [0.2, 0.1], [0.2, 0.2]]]], False), ([[[[0.0, 0.0], [float("nan"), 0.0], [1.0, 1.0], [0.0, 0.0]]]], False), ([[[[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [0.0, 0.0]]]], False),
])
def test_ring_cleaning(spark, polys, ok):
    df = spark.createDataFrame([(polys,)], f"p {POLY}")
    assert (df.select(P.clean_geometry("p")).first()[0] is not None) is ok


def test_surface_point_lies_inside():
    u = [[[[0, 0], [3, 0], [3, 3], [2, 3], [2, 1], [1, 1], [1, 3], [0, 3], [0, 0]]]]
    for polys in (SQUARE, u, box(5, 5, 1, 1)):
        assert P.inside(np.array([P.surface_point(polys)]), P._parts(polys))[0]
    assert P.surface_point([]) is None


def test_relations():
    d = 1e-4
    r = P.relation_of(box(0, 0, d, d), box(d / 2, 0, d, d))
    assert r["intersects"] and r["overlap_fraction_a"] == pytest.approx(0.5, abs=0.05) and r["boundary_gap_m"] == 0
    far = P.relation_of(box(0, 0, d, d), box(2 * d, 0, d, d))
    assert not far["intersects"] and far["boundary_gap_m"] == pytest.approx(d * 111320, rel=0.01)
    assert P.relation_of(box(0, 0, d, d), box(d + 1e-6, 0, d, d))["touches"]
    assert P.relation_of(box(d / 4, d / 4, d / 4, d / 4), box(0, 0, d, d))["a_within_b"]


def test_components_and_groups(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a int, b int")
    found = dict(map(tuple, star_components(df).collect()))
    assert found == {k: find(k) for k in parent}
    assert star_components(df.where("false")).count() == 0
    comp = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")], "id string, component string")
    e = spark.createDataFrame([("b", "c", "gray"), ("a", "b", "link")], "a string, b string, edge string")
    g = {x["component"]: x["group_class"] for x in P.component_groups(comp, e).collect()}
    assert g == {"a": "AMBIGUOUS_CLUSTER", "c": "AMBIGUOUS_CLUSTER", "d": "STANDALONE_PHYSICAL_PARK"}


def test_aliases(spark):
    flat = P.flatten_aliases(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "retired_id string, survivor_id string"))
    assert dict(map(tuple, flat.select("retired_id", "survivor_id").collect())) == {"a": "d", "b": "d", "c": "d", "x": "y"}
    with pytest.raises(ValueError):
        P.flatten_aliases(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "retired_id string, survivor_id string"))


def test_shapes(spark):
    rows = [("s", "1", box(27, 38, 0.0001, 0.01)), ("q", "2", box(27, 38, 0.001, 0.001))]
    found = {x["component"]: x for x in P.shape_metrics(spark.createDataFrame(rows, f"component string, id string, polys {POLY}")).collect()}
    assert found["s"]["linear"] and not found["q"]["linear"] and found["q"]["compactness"] == pytest.approx(0.49, abs=0.03)


def test_pair_evidence_and_edges(spark):
    d = 1e-4
    rows = [("1", "Gazi Parkı", "D", 38.00005, 27.00005, box(27, 38, d, d)), ("2", "Gazi Parkı", "D", 38.00005, 27.00016, box(27 + 1.1 * d, 38, d, d)), ("3", "Zafer Parkı", "D", 38.00005, 27.00005, box(27, 38, d, d))]
    rec = spark.createDataFrame(rows, f"id string, name string, district string, latitude double, longitude double, polys {POLY}")
    pairs = P.pair_evidence(rec)
    strict = rec.where("false").select("id")
    found = {(x["a"], x["b"]): x["edge"] for x in P.classify_edges(pairs, strict).collect()}
    assert found == {("1", "2"): "link", ("1", "3"): "conflict", ("2", "3"): None}


def test_guard_and_vets(spark):
    c = spark.createDataFrame([("1", "Gazi Parkı", 38.0, 27.0), ("2", "Gazi Parkı", 38.0001, 27.0), ("3", "Park", 38.0, 27.0), ("4", "Zafer Parkı", 38.0, 27.0)], "external_id string, name string, latitude double, longitude double")
    assert {x["external_id"]: x["others"] for x in S.duplicate_guard(c, 50).collect()} == {"1": 1, "2": 1}
    crowd = c.union(spark.createDataFrame([(f"c{i}", "Gazi Parkı", 38.0, 27.0) for i in range(5)], c.schema))
    assert {x["external_id"]: x["others"] for x in S.duplicate_guard(crowd, 50).collect()} == {i: 6 for i in ("1", "2", "c0", "c1", "c2", "c3", "c4")}
    v = spark.createDataFrame([("a", 38.0, 27.0, True), ("b", 39.0, 27.0, True), ("c", 38.0, 27.0, False)], "id string, latitude double, longitude double, active boolean")
    assert {x["id"] for x in S.vets_within(v, 38.0, 27.0, 1e9).collect()} == {"a"}
    assert S.vets_within(v, None, 27.0, 5).count() == 2


def test_box_pairs_of_any_size(spark):
    r = random.Random(11)
    rows = []
    for i in range(300):
        x, y, size = 27 + r.random(), 38 + r.random(), 10 ** r.uniform(-5, -0.3)
        rows.append((i, x, y, x + size * r.random(), y + size * r.random()))
    rows += [(300, 27.5, 38.5, 27.5, 38.5), (301, 27.5, 38.5, 27.5, 38.5), (302, 20.0, 30.0, 40.0, 50.0)]
    df = spark.createDataFrame([(i, (w, s, e, n)) for i, w, s, e, n in rows] + [(400, None)], "id int, box struct<west double, south double, east double, north double>")
    for metres in (0.0, 500.0):
        dy, dx = lat_step(metres), lon_step(metres)
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[3] + dx and b[1] <= a[3] + dx and a[2] <= b[4] + dy and b[2] <= a[4] + dy}
        found = [tuple(x) for x in box_pairs(df, metres).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    even = df.withColumn("k", F.col("id") % 2)
    assert all((a - b) % 2 == 0 for a, b in box_pairs(even, 500.0, by=["k"]).collect())
    assert box_pairs(df.limit(0), 10.0).collect() == []


def test_hulls_and_extents():
    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 500):
        points = draw.normal(size=(n, 2)).round(1)
        want = max(float(np.hypot(*(p - q))) for p in points for q in points)
        assert P.extent(P.hull(points)) == pytest.approx(want)
    line = np.column_stack([np.arange(9.0), np.arange(9.0)])
    assert P.extent(P.hull(line)) == pytest.approx(8 * 2**0.5)


def test_shapes_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(P._merged_hulls, "__defaults__", (500,))
    r = random.Random(4)
    rows = [(("big", "small")[i % 50 == 0], i, box(27 + r.random() * 0.01, 38 + r.random() * 0.01, 1e-4 * r.random(), 1e-4)) for i in range(1500)]
    df = spark.createDataFrame(rows, f"component string, id int, polys {POLY}").repartition(6)
    for x in P.shape_metrics(df).collect():
        own = [p for c, _, p in rows if c == x["component"]]
        k = np.array([P.LON_M * np.cos(np.radians(own[0][0][0][0][1])), P.LAT_M])
        points = np.array([q for p in own for q in p[0][0][:-1]]) * k
        area = sum(abs(P._area(np.array(p[0][0]) * k)) for p in own)
        far = max(float(np.sqrt(((points - q) ** 2).sum(axis=1)).max()) for q in points)
        assert x["area_m2"] == pytest.approx(area, rel=1e-4) and x["max_extent_m"] == pytest.approx(far)


def test_source_clusters_follow_names_and_overlap(spark):
    d = 1e-4
    rows = [
        ("1", "Zafer Parkı", box(27, 38, d, d)), ("2", "İsimsiz park", box(27 + d / 2, 38, d, d)),  # overlap, one is generic: one
        ("3", "İsimsiz park", box(27.1, 38, d, d)), ("4", "İsimsiz park", box(27.1 + 1.2 * d, 38, d, d)),  # generic names 2 m apart: two
        ("5", "Deniz Parkı", None), ("6", "Çınar Parkı", None), ("7", "Deniz Parkı", None),  # 5 and 7 at one place, 6 elsewhere
        ("8", "Kavak Parkı", box(27.3, 38, d, d)), ("9", "Menekşe Parkı", box(27.3 + d / 2, 38, d, d)),  # overlap of two names: ambiguous
        ("10", "Güneş Parkı", box(27.4, 38, d, d)), ("11", "Güneş Parkı", box(27.4 + 8 * d, 38, d, d)),  # 61 m apart: ambiguous
    ]
    places = {"5": (38.0, 27.2), "7": (38.0, 27.2), "6": (38.0, 27.21)}
    at = lambda i, p: places.get(i) or (p[0][0][0][1] + d / 2, p[0][0][0][0] + d / 2)
    df = spark.createDataFrame([(i, n, *at(i, p), p) for i, n, p in rows], f"id string, name string, latitude double, longitude double, polys {POLY}")
    components, ambiguous = P.source_clusters(df)
    assert sorted(tuple(x) for x in ambiguous.collect()) == [("10", "11", "namesake_nearby"), ("8", "9", "overlap_with_other_name")]
    told = {x["id"]: (x["component"], x["cluster_class"], x["ambiguous"]) for x in P.cluster_classes(components, ambiguous).collect()}
    assert told["1"][:2] == told["2"][:2] == ("1", "FRAGMENTED") and told["5"][0] == told["7"][0]
    assert told["3"][1] == told["4"][1] == told["6"][1] == "SINGLETON" and told["8"][2] and told["11"][2] and not told["6"][2]
    groups = {x["key"]: x["group_class"] for x in P.namesake_groups(components, df, ambiguous).collect()}
    assert groups == {"denizparki": "FRAGMENTED", "gunesparki": "AMBIGUOUS"}


def test_gaps_alone_equal_those_of_whole_relations():
    """Apart, crossing, one in the other, in a hole, touching, thin, and of several parts."""
    r = random.Random(7)

    def ring(x, y, s, n, digits):
        turns = [(r.uniform(0.3, 1) * s, 2 * math.pi * i / n) for i in range(n)]
        pts = [[round(x + far * math.cos(t), digits), round(y + far * math.sin(t) * (0.02 if n == 5 else 1), digits)] for far, t in turns]
        return pts + pts[:1]

    def shape():
        parts = []
        for _ in range(r.choice([1, 1, 2])):
            x, y, s, digits = 27 + r.random() * 0.02, 38 + r.random() * 0.02, r.choice([2e-3, 1e-2]), r.choice([3, 12])
            parts.append([ring(x, y, s, r.choice([3, 5, 9]), digits)] + [ring(x, y, s * 0.3, 4, 12)] * r.choice([0, 1]))
        return P._Shape(parts)

    shapes = [shape() for _ in range(60)]
    told = [(P._related(a, b)["boundary_gap_m"], P._gap(a, b)) for a in shapes for b in shapes]
    assert all(x == y for x, y in told) and 300 < sum(x == 0 for x, _ in told) < 3300


def test_source_clusters_of_large_shapes_whose_points_are_far_apart(spark):
    d = 1e-2  # some 900 m: reference points are the lower left corners
    rows = [
        ("1", "Zafer Parkı", box(27, 38, 2 * d, 2 * d)), ("2", "İsimsiz park", box(27 + d, 38 + d, 1e-4, 1e-4)),  # one in the other, generic: one
        ("3", "Güneş Parkı", box(27.1, 38, d, d)), ("4", "Güneş Parkı", box(27.1 + d + 2e-4, 38, d, d)),  # namesakes 18 m apart: one
        ("5", "Kavak Parkı", box(27.2, 38, d, d)), ("6", "Kavak Parkı", box(27.2 + d + 1e-3, 38, d, d)),  # namesakes 88 m apart: ambiguous
        ("7", "Deniz Parkı", box(27.3, 38, d, d)), ("8", "Bülbül Parkı", box(27.3, 38 + d / 2, d, d)), ("9", "Deniz Parkı", None),  # 7 and 8 overlap: ambiguous; 9 is 11 m from 7: one
        ("10", "Çınar Parkı", box(27.4, 38, d, d)), ("11", "Çınar Parkı", box(27.4 + d + 2e-3, 38, d, d)),  # namesakes 175 m apart: nothing
    ]
    at = lambda p: (p[0][0][0][1], p[0][0][0][0]) if p else (38 - 1e-4, 27.3 + 0.9 * d)
    df = spark.createDataFrame([(i, n, *at(p), p) for i, n, p in rows], f"id string, name string, latitude double, longitude double, polys {POLY}")
    components, ambiguous = P.source_clusters(df)
    assert sorted(tuple(x) for x in ambiguous.collect()) == [("5", "6", "namesake_nearby"), ("7", "8", "overlap_with_other_name")]
    groups = {}
    for x in components.collect():
        groups.setdefault(x["component"], set()).add(x["id"])
    assert sorted(map(sorted, groups.values())) == [["1", "2"], ["10"], ["11"], ["3", "4"], ["5"], ["6"], ["7", "9"], ["8"]]
    near = P.source_clusters(df, reach_m=600)
    assert near[1].isEmpty() and near[0].where("id <> component").isEmpty()


def test_nearest_region_without_a_cap(spark):
    edges = spark.createDataFrame([("A", 27.0, 38.0, 27.1, 38.0), ("B", 27.0, 39.0, 27.1, 39.0)], "region string, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 38.0001, 27.05), (2, 38.7, 27.05), (3, 30.0, 27.0), (4, None, 27.0)], "id int, latitude double, longitude double")
    found = {x["id"]: (x["region"], x["distance_m"]) for x in R.nearest_region_any(points, edges, 50).collect()}
    assert found[1] == ("A", 11) and found[2][0] == "B" and found[3] == ("A", round(8 * 110540)) and 4 not in found
    assert R.nearest_region_any(points, edges.limit(0)).collect() == [] and R.nearest_region_any(points.limit(0), edges).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_never_broadcast(spark):
    rows = spark.range(50).selectExpr("id", "38 + id * 1e-4 as latitude", "27d as longitude")
    assert "Broadcast" not in plan_of(S.within_radius(rows, rows, 100)) and S.self_pairs(rows, 12).count() == 49


def test_rows_in_the_middle_of_a_cell_find_their_own_cell(spark):
    """A radius south and north of such a row lie on the cell's borders, where rounding may put both outside of it."""
    high, wide = lat_step(700), lon_step(700)
    rows = [(i, (2 * k + 1) * high, 27.0) for i, k in enumerate(range(2750, 3350))] + [(1000 + i, 38.0, (2 * k + 1) * wide) for i, k in enumerate(range(1350, 2250))]
    df = spark.createDataFrame([*rows, (5000, 38.15, 27.3674)], "id int, latitude double, longitude double")
    own = S.within_radius(df, df, 700).where("a.id = b.id and distance_m = 0")
    assert own.count() == len(rows) + 1
    park = spark.createDataFrame([(1, 38.14939, 27.36739)], "id int, latitude double, longitude double")
    assert [round(x["distance_m"]) for x in S.within_radius(df.where("id = 5000"), park, 700).collect()] == [68]


def test_parks_broadcast_the_names_alone(spark, tmp_path):
    """Customers by far the smaller file, as compressed keys are: still the 200 names go round, and parks keep their partitions."""
    spark.range(40).selectExpr("id as c_custkey", "cast(id % 25 as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(20000).selectExpr("id as p_partkey", "sha2(cast(id as string), 512) as p_name").write.parquet(f"{tmp_path}/part.parquet")
    parks = V.parks(spark, str(tmp_path))
    assert "BuildRight" in plan_of(parks) and "hashpartitioning(c_custkey" in plan_of(parks) and parks.count() == 40


def test_rings_are_tidied_once(spark):
    df = spark.range(3).select(F.expr("array(array(array(array(27d, 38d), array(27.1d, 38d), array(27.1d, 38.1d), array(27d, 38d))))").alias("polys"))
    told = df.repartition(1).select(P.clean_geometry("polys").alias("p"))
    assert told._jdf.queryExecution().logical().toString().lower().count("round(") <= 4 and told.where("p is not null").count() == 3


def test_duplicate_lists_name_all_others(spark):
    rows = [("1", "Gazi Parkı", 38.0, 27.0), ("2", "Gazi Parkı", 38.0001, 27.0), ("3", "Gazi Parkı", 38.0, 27.0), ("4", "Zafer Parkı", 38.0, 27.0), ("5", "Yeni Gazi Parkı", 38.0, 27.0), ("6", "Kavak Parkı", 38.0, 27.0), ("7", "Gazi Parkı", None, 27.0)]
    c = spark.createDataFrame(rows, "external_id string, name string, latitude double, longitude double")
    lists = {x["external_id"]: x["others"] for x in S.duplicate_lists(c, 50).collect()}
    assert lists == {"1": ["2", "3", "5"], "2": ["1", "3", "5"], "3": ["1", "2", "5"], "5": ["1", "2", "3"]}
    assert {k: len(v) for k, v in lists.items()} == {x["external_id"]: x["others"] for x in S.duplicate_guard(c, 50).collect()}


def test_shared_claimants_are_listed(spark):
    from gridloom.operators import tables as T

    pairs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "c string, t int")
    told = {x["c"]: (x["claims"], x["others"]) for x in T.shared_claimants(pairs, "c", "t").collect()}
    assert told == {"a": (3, ["b", "c"]), "b": (3, ["a", "c"]), "c": (3, ["a", "b"]), "d": (1, [])}


def test_far_points_meet_few_edges(spark):
    """What a wide ring leaves of a field of edges for a point is what is about as near as its nearest."""
    edges = spark.range(2500).selectExpr("concat('R', id % 7) as region", "27 + id % 50 * 1e-2 as x1", "38 + id div 50 * 1e-2 as y1", "27.005 + id % 50 * 1e-2 as x2", "38.003 + id div 50 * 1e-2 as y2")
    points = spark.range(40).selectExpr("id", "38.6 + id % 8 * 5e-2 as latitude", "26.7 + id div 8 * 2e-1 as longitude")
    want = {tuple(r) for r in R.nearest_region(points, edges, 64_000).collect()}
    assert len(want) == 40 and {tuple(r) for r in R._nearest_by_parts(points, edges, 64_000, 43.0).collect()} == want
    assert {tuple(r) for r in R.nearest_region_any(points, edges).collect()} == want


def test_regions_far_east_and_west_do_not_meet_points(spark):
    corner = "explode(array(struct(0d as ax, 0d as ay, 1d as bx, 0d as by), struct(1d as ax, 0d as ay, 0d as bx, 1d as by), struct(0d as ax, 1d as ay, 0d as bx, 0d as by))) as e"
    sized = spark.range(300).selectExpr("id as region", "if(id % 60 = 0, 3d, 0.01d) as s", "26 + id * 5e-2 as x", "38 + id % 3 * 5e-3 as y", corner)
    edges = sized.selectExpr("region", "x + s * e.ax as x1", "y + s * e.ay as y1", "x + s * e.bx as x2", "y + s * e.by as y2")
    points = spark.range(900).selectExpr("id", "26.00123 + id * 16e-3 as longitude", "38.00137 + id % 5 * 3e-3 as latitude")
    rows = [tuple(r) for r in sized.select("region", "s", "x", "y").distinct().collect()]
    inside = lambda p, s, x, y: p["longitude"] > x and p["latitude"] > y and (p["longitude"] - x) + (p["latitude"] - y) < s
    want = {(p["id"], r) for p in points.collect() for r, *at in rows if inside(p, *at)}
    found = R.contained_in(points, edges)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 300 and "column" in plan_of(found)


def test_areas_keep_their_digits():
    """A sliver far from the origin: products of whole coordinates are off by some 1e-14 square degrees."""
    from fractions import Fraction

    ring = np.array([[27.123451, 41.234567], [27.123851, 41.234569], [27.123571, 41.234577], [27.123451, 41.234567]])
    x, y = [[Fraction(v) for v in ring[:, k]] for k in (0, 1)]
    exact = sum(x[i] * y[i + 1] - x[i + 1] * y[i] for i in range(3)) / 2
    assert abs(Fraction(P._area(ring)) - exact) < exact / 10**12


def test_a_point_on_a_corner_is_near_but_not_inside(spark):
    """Ray casting is half-open: the corner's distance is 0, yet the triangle does not contain it."""
    from gridloom.plans.consolidate import classify_polygons

    triangle = [[[[27.0, 38.0], [27.02, 38.005], [27.006, 38.02], [27.0, 38.0]]]]
    edges = R.region_edges(spark.createDataFrame([(1, triangle)], f"region long, polys {POLY}"))
    names = spark.createDataFrame([(1, "İsimsiz park")], "region long, name string")
    klass = lambda *at: [r["klass"] for r in classify_polygons(spark.createDataFrame([(7, "a", *at)], "id long, name string, longitude double, latitude double"), edges, names).collect()]
    assert klass(27.0, 38.0) == ["generic_fragment"] and klass(27.008, 38.008) == ["contained_single"]


def test_regions_that_share_a_border_are_equally_near(spark):
    """The sides of a border differ by rounding; the first region wins, not the one that rounding favours."""
    low, high = box(27.0, 38.0, 0.01, 0.01), box(27.0, 38.01 + 1e-12, 0.01, 0.01)
    for names in ("ab", "ba"):
        regions = spark.createDataFrame([(names[0], low), (names[1], high)], f"region string, polys {POLY}")
        point = spark.createDataFrame([(1, "p", 27.005, 38.01 - 1e-10)], "id long, name string, longitude double, latitude double")
        ranked = R.polygon_candidates(point, R.region_edges(regions), regions.select("region", F.lit("q").alias("name"))).orderBy("rank").collect()
        assert [r["region"] for r in ranked] == ["a", "b"]


def test_pairs_of_shapes_are_dealt_to_all_cores(spark):
    """A few kilobytes of pairs, but each is measured: one task would do them one by one."""
    rows = [(i, 38.0, 27.0 + i * 1e-4, box(27.0 + i * 1e-4, 38.0, 1e-4, 1e-4)) for i in range(120)]
    pairs = P.near_pairs(spark.createDataFrame(rows, f"id long, latitude double, longitude double, polys {POLY}"), 100)
    tasks = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 8 and sum(t["count"] for t in tasks) > 1000
    assert max(t["count"] for t in tasks) < sum(t["count"] for t in tasks) / 3


def test_polygons_of_pairs_are_measured_once(spark, capsys):
    """A filter on a measured distance must not measure below the projection too, and pairs that boxes tell apart reach no Python."""
    from gridloom.operators.cover import with_box

    rng = random.Random(4)
    rows = []
    for i in range(60):
        x, y, s = 27 + rng.random() / 50, 38 + rng.random() / 50, rng.choice([6e-4, 4e-3])
        rows.append((i, y, x, None if i % 5 == 0 else [[[[x, y], [x + s, y + s / 4], [x + s / 3, y + s], [x, y]]]]))
    records = with_box(spark.createDataFrame(rows, "id int, latitude double, longitude double, polys array<array<array<array<double>>>>"))
    pairs = P.near_pairs(records, 800)
    point = G.haversine_m("a.latitude", "a.longitude", "b.latitude", "b.longitude")
    both = F.col("a.polys").isNotNull() & F.col("b.polys").isNotNull()
    gap = F.when(both, P.polygon_relation("a.polys", "b.polys")["boundary_gap_m"]).otherwise(
        F.coalesce(P.point_polygon_m("b.longitude", "b.latitude", "a.polys"), P.point_polygon_m("a.longitude", "a.latitude", "b.polys"), point))
    told = pairs.select(P.least_gap_m("a", "b", point).alias("least"), gap.alias("gap"), both.alias("both")).where("gap < 500")
    told.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython [") == 1
    found = told.collect()
    assert {r["both"] for r in found} == {True, False} and max(r["least"] for r in found) > 100
    assert all(r["least"] <= r["gap"] + 0.01 for r in found)


def test_point_to_polygon_of_several_parts(spark, monkeypatch):
    """Holes, parts, and no polygon, in pieces of any size, against one pair at a time."""
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    polys = [[[square(27.0, 38.0, 0.01), square(27.002, 38.002, 0.006)], [square(27.004, 38.004, 0.001)]], None, [[square(27.0, 38.0, 0.002)]]]
    points = [(27.001, 38.001), (27.0045, 38.0045), (27.003, 38.005), (27.02, 38.0), (27.0, 38.02)]
    rows = [(x, y, p) for p in polys for x, y in points]
    for held in (1, 200_000):
        monkeypatch.setattr(P, "EDGES_HELD", held)
        got = P._point_polygon.func(*(pd.Series(c) for c in zip(*((x, y, None if p is None else json.dumps(p)) for x, y, p in rows))))
        for d, (x, y, p) in zip(got, rows):
            if p is None:
                assert d != d
                continue
            parts = P._parts(p)
            k = np.array([G.LON_M * np.cos(np.radians(y)), G.LAT_M])
            edges = np.concatenate([np.concatenate([r[:-1] * k, r[1:] * k], axis=1) for part in parts for r in part])
            want = 0.0 if P.inside(np.array([[x, y]]), parts)[0] else P._point_gap(np.array([[x, y]]) * k, edges)
            assert abs(d - want) < 1e-6


def test_dealt_rows_stay_dealt(spark):
    """Also where rows are partitioned by the key already, in fewer tasks than there are cores."""
    from gridloom.functions.session import dealt

    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.range(100).repartition(most, "id").withColumn("x", F.col("id") + 1)
    plan = dealt(rows, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    shapes = spark.range(64).select("id", F.lit("c").alias("component"), F.array(F.array(F.array(*(F.array(F.col("id") + x, F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)))))).alias("polys"))
    assert [round(r["area_m2"] / P.LON_M / P.LAT_M) for r in P.shape_metrics(shapes).collect()] == [32]


def test_cells_of_a_distance_join(spark):
    """Four copies of a place at most, and no pair lost at any place within a cell."""
    from gridloom.operators.spatial import _celled, within_radius

    at = spark.range(400).select("id", (F.lit(38.0) + F.expr("id div 20") * 0.0007).alias("latitude"), (F.lit(27.0) + F.col("id") % 20 * 0.0009).alias("longitude"))
    assert max(r["count"] for r in _celled(at, "a", 150, 43.0, True, []).groupBy("a.id").count().collect()) <= 4
    rows = [(r["id"], r["latitude"], r["longitude"]) for r in at.collect()]
    told = {(r["a"], r["b"]) for r in within_radius(at, at, 150).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect()}

    def metres(p, q):
        (y1, x1), (y2, x2) = map(lambda v: (math.radians(v[1]), math.radians(v[2])), (p, q))
        return 2 * 6371000 * math.asin(math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))

    assert told == {(p[0], q[0]) for p in rows for q in rows if metres(p, q) <= 150}


def test_gap_alone_is_that_of_the_relation(spark):
    turn = random.Random(7)
    shape = lambda: [[[[x, y], [x + s, y], [x, y + s], [x, y]]] for x, y, s in [(27 + turn.random() * 0.003, 38 + turn.random() * 0.003, 0.0002 + turn.random() * 0.002)]]
    df = spark.createDataFrame([(shape(), shape()) for _ in range(60)] + [(None, shape())], f"a {POLY}, b {POLY}")
    told = df.select(P.polygon_gap_m("a", "b").alias("gap"), P.polygon_relation("a", "b")["boundary_gap_m"].alias("whole")).collect()
    assert [r["gap"] for r in told] == [r["whole"] for r in told] and told[-1]["gap"] is None and {r["gap"] == 0 for r in told[:-1]} == {True, False}
