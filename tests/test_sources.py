import json
import re

import pytest
from pyspark.sql import functions as F

from gridloom.sources import readers as R
from gridloom.sources import sinks as S

SQUARE = [[[29.0, 41.0], [29.1, 41.0], [29.1, 41.1], [29.0, 41.1], [29.0, 41.0]]]


def collection(features):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": str(i), "properties": p, "geometry": g} for i, (p, g) in enumerate(features)]})


def test_features_and_regions(spark, tmp_path):
    path = tmp_path / "f.geojson"
    path.write_text(collection([({"name": "A", "n": 1}, {"type": "Point", "coordinates": [29.0, 41.0]}), ({"shapeName": "B "}, {"type": "Polygon", "coordinates": SQUARE}), ({"shapeName": "C"}, {"type": "MultiPolygon", "coordinates": [SQUARE, SQUARE]}), ({}, None)]))
    rows = R.read_features(spark, str(path)).orderBy("position").collect()
    assert [r["geom_type"] for r in rows] == ["Point", "Polygon", "MultiPolygon", None]
    assert (rows[0]["longitude"], rows[0]["latitude"], rows[0]["properties"]["n"]) == (29.0, 41.0, "1")
    assert len(rows[2]["polys"]) == 2 and rows[0]["polys"] is None
    edges, boxes = R.read_regions(spark, str(path))
    assert {r["region"] for r in boxes.collect()} == {"B", "C"} and edges.where("region = 'B'").count() == 4


def test_osm_and_arcgis(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 41.0, "lon": 29.0, "tags": {"name": "A", "name:tr": " Ağ "}}, {"type": "way", "id": 2, "center": {"lat": 40.0, "lon": 28.0}, "tags": {"loc_name": "L"}}]}))
    found = {r["osm_id"]: (r["name"], r["latitude"]) for r in R.read_osm_elements(spark, str(tmp_path / "o.json")).collect()}
    assert found == {"node/1": ("Ağ", 41.0), "way/2": ("L", 40.0)}
    (tmp_path / "a.json").write_text(json.dumps({"features": [{"attributes": {"AD": "X"}, "geometry": {"rings": SQUARE}}]}))
    assert R.read_arcgis(spark, str(tmp_path / "a.json")).first()["rings"] == SQUARE
    pts = spark.createDataFrame([(1, "A", 41.0, 29.0)], "osm_id long, name string, latitude double, longitude double")
    polys = spark.createDataFrame([(5, None, "B", 41.0, 29.0), (6, 7, "C", 41.0, 29.0)], "osm_id long, osm_way_id long, name string, latitude double, longitude double")
    assert {r["osm_id"] for r in R.osm_catalog(pts, polys).collect()} == {"node/1", "relation/5", "way/7"}


def test_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('﻿ad,adres\n"Gül, Parkı","satır\nsonu"\n,\n"a ""b""",c\n', encoding="utf-8")
    rows = R.read_municipal_csv(spark, str(p)).collect()
    assert [tuple(r) for r in rows] == [("Gül, Parkı", "satır\nsonu"), ('a "b"', "c")]
    q = tmp_path / "c.csv"
    q.write_text("AD;ENLEM;BOYLAM\nX;41,5;29,25\nY;;\n", encoding="utf-8")
    assert [(r["_latitude"], r["_longitude"]) for r in R.read_coordinate_csv(spark, str(q)).collect()] == [(41.5, 29.25), (None, None)]
    assert R.read_coordinate_csv(spark, str(q), swapped=True).first()["_latitude"] == 29.25
    bad = tmp_path / "b.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        R.read_coordinate_csv(spark, str(bad))


def test_small_readers(spark, tmp_path):
    df = spark.createDataFrame([("12",), ("x",), (" 7 ",)], "s string")
    assert {r[0] for r in R.companion_serials(df, "s").collect()} == {"12", "7"}
    txt = spark.createDataFrame([("no: 1, no: 22",)], "s string")
    assert {r[0] for r in R.companion_serials(txt, "s", r"no: (\d+)").collect()} == {"1", "22"}
    raw = spark.createDataFrame([('[{"id":"a","n":1},{"id":"b","n":null}]',)], "j string")
    assert [tuple(r) for r in R.stage_records(raw, "j", "id: string, n: int").collect()] == [("a", 1), ("b", None)]
    spark.createDataFrame([((0.0, 1.0, 0.0, 1.0), (["sports", "park"],)), ((5.0, 6.0, 5.0, 6.0), (["park"],)), ((0.0, 1.0, 0.0, 1.0), (["shop"],))], "bbox struct<xmin double, xmax double, ymin double, ymax double>, taxonomy struct<hierarchy array<string>>").write.parquet(str(tmp_path / "p"))
    assert R.read_places(spark, str(tmp_path / "p"), (0.5, 0.5, 2, 2), "park").count() == 1


def test_tiles(spark, tmp_path):
    rows = [("b", "way/2", 41.05, 29.05, [SQUARE]), ("a", "way/1", 41.06, 29.06, [SQUARE, SQUARE]), ("c", "way/3", 41.05, 29.05, [[SQUARE[0][:-1]]]), ("d", "way/4", 38.0, 27.0, [SQUARE])]
    df = spark.createDataFrame(rows, "id string, osm_id string, latitude double, longitude double, polys array<array<array<array<double>>>>")
    tiles = {r["tile"]: r for r in S.boundary_tiles(df).collect()}
    assert tiles["116-164"]["boundaries"] == 2 and set(tiles) == {"116-164", "108-152"}
    fc = json.loads(tiles["116-164"]["collection"])
    assert [(f["properties"]["id"], f["geometry"]["type"]) for f in fc["features"]] == [("a", "MultiPolygon"), ("b", "Polygon")]
    assert {r["boundaries"] for r in S.write_boundary_tiles(df, str(tmp_path / "t")).collect()} == {2, 1}
    seen = {r["id"]: r["selected"] for r in S.visible_boundaries(df, 41.0, 41.1, 29.0, 29.1, "d").collect()}
    assert seen == {"a": False, "b": False, "c": False, "d": True}
    assert df.select(F.count("id")).first()[0] == 4


def test_a_large_tile_is_several_documents(spark, tmp_path):
    rows = [(f"{i:03}", f"way/{i}", 41.05, 29.05, [SQUARE]) for i in range(40)] + [("x", "way/ş", 38.0, 27.0, [SQUARE])]
    df = spark.createDataFrame(rows, "id string, osm_id string, latitude double, longitude double, polys array<array<array<array<double>>>>").repartition(4)
    whole = {r["tile"]: r for r in S.boundary_tiles(df).collect()}
    assert all(r["bytes"] == len(r["collection"].encode()) for r in whole.values()) and len(whole) == 2
    parts = sorted(S.boundary_tiles(df, 1000).where("tile = '116-164'").collect(), key=lambda r: r["part"])
    assert len(parts) > 5 and max(len(r["collection"].encode()) for r in parts) <= 1000
    ids = [f["properties"]["id"] for r in parts for f in json.loads(r["collection"])["features"]]
    assert ids == [f"{i:03}" for i in range(40)] and {r["boundaries"] for r in parts} == {40}
    told = S.write_boundary_tiles(df, str(tmp_path / "t"), 1000).collect()
    assert {(r["tile"], r["content_hash"]) for r in told} == {(r["tile"], r["content_hash"]) for r in whole.values()}
    lines = spark.read.text(str(tmp_path / "t")).collect()
    assert sorted(f["properties"]["id"] for r in lines for f in json.loads(r["value"])["features"]) == [*ids, "x"]


def test_tile_query_gathers_no_features(spark, data):
    from gridloom.queries import QUERIES

    plan = QUERIES["tiles"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_features_are_the_same_for_any_split(spark, tmp_path):
    from gridloom.sources import split_json as J

    odd = ['a "quoted" {brace', "back\\slash\\", "] } [ {", "ünïcode ş", "", '{"type":"Feature"}', "\\" * 5]
    features = [
        {"type": "Feature", "id": str(i), "properties": {"name": odd[i % len(odd)], "n": i, "sub": {"type": "Feature", "x": [1, {"y": "}"}]}}, "geometry": {"type": "Point", "coordinates": [27 + i / 100, 38.0]} if i % 3 else {"type": "Polygon", "coordinates": [SQUARE[0]]}}
        for i in range(60)
    ]
    folder = tmp_path / "fc"
    folder.mkdir()
    whole = {"type": "FeatureCollection", "name": 'x"{', "links": [{"type": "self"}], "features": features}
    (folder / "a.json").write_text(json.dumps(whole), encoding="utf-8")
    (folder / "b.json").write_text(json.dumps(whole | {"features": features[:7]}, indent=2, ensure_ascii=False), encoding="utf-8")
    (folder / "c.json").write_text(json.dumps({"features": []}))
    told = lambda df: sorted(map(str, df.collect()))
    want = told(R.read_features(spark, str(folder)))
    assert len(want) == 67
    for size in (97, 1000, 1 << 20):
        got = R.read_features(spark, str(folder), size)
        plain = lambda rows: [re.sub(r"\s|\\n", "", w.replace("file:///", "file:/")) for w in rows]  # noqa: E731  objects within properties may be spaced otherwise
        assert set(plain(told(got))) - set(plain(want)) == set() and len(told(got)) == len(want)
    raw = (folder / "a.json").read_bytes()
    read = lambda at, n: raw[at : at + n]
    for size in (1, 7, 64):
        state, depth, out = J.OUTSIDE, 0, []
        for a in range(0, len(raw), size):
            b = min(a + size, len(raw))
            out += J.elements(read, len(raw), a, b, state, depth, 13)
            state, more = J.passes(raw[a:b], state)
            depth += more
        assert [json.loads(x) for x in out] == [{"type": "self"}, *features] and (state, depth) == (J.OUTSIDE, 0)


def test_places_layout_prunes(spark, tmp_path):
    import pyarrow.dataset as ds

    n = 40_000
    x, y = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)) / 10_000, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10_000)) / 10_000
    df = spark.range(n).select("id", (26 + 18 * x).alias("x"), (36 + 6 * y).alias("y"))
    df = df.select("id", F.struct(F.col("x").alias("xmin"), (F.col("x") + 0.001).alias("xmax"), F.col("y").alias("ymin"), (F.col("y") + 0.001).alias("ymax")).alias("bbox"), F.struct(F.array(F.lit("park")).alias("hierarchy")).alias("taxonomy"))
    S.write_places(df, str(tmp_path / "places"), 16, 500)
    box = (29.0, 39.0, 29.5, 39.5)
    near = lambda d: {r["id"] for r in d.where("bbox.xmin <= 29.5 and bbox.xmax >= 29 and bbox.ymin <= 39.5 and bbox.ymax >= 39").collect()}
    assert {r["id"] for r in R.read_places(spark, str(tmp_path / "places"), box, "park").collect()} == near(df)
    groups = [g for f in ds.dataset(str(tmp_path / "places"), format="parquet").get_fragments() for g in f.split_by_row_group()]

    def spans(g) -> bool:
        s = {c["path_in_schema"]: c["statistics"] for c in g.metadata.row_group(g.row_groups[0].id).to_dict()["columns"] if c["statistics"]}
        return s["bbox.xmin"]["min"] <= 29.5 and s["bbox.xmax"]["max"] >= 29 and s["bbox.ymin"]["min"] <= 39.5 and s["bbox.ymax"]["max"] >= 39

    hit = [g for g in groups if spans(g)]
    assert len(groups) >= 64 and len(hit) <= len(groups) / 10
