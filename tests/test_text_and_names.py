import pytest
from pyspark.sql import functions as F

from gridloom.functions import names as N
from gridloom.functions import text as X
from gridloom.functions.ids import decode_serial, det_uuid, encode_serial


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("name", ["park", "PARK", "parklar", "Kent Parkı", "Park Alanları", "karavan parkı"])
def test_park_word(spark, name):
    assert one(spark, X.has_park_word("n"), n=name)


@pytest.mark.parametrize("name", ["parkomat", "parking", "otopark", "sparkle", "", None])
def test_no_park_word(spark, name):
    assert not one(spark, X.has_park_word(F.col("n").cast("string")), n=name)


def test_folding(spark):
    assert one(spark, X.fold("n"), n="  İSTANBUL  Çağdaş Işık\tÜnlü ") == "istanbul cagdas isik unlu"
    assert one(spark, X.name_key("n"), n="Şht. Âdil-2 Parkı") == "shtadil2parki"
    assert one(spark, X.turkish_title("n"), n="ışık İLİ park") == "Işık İli Park"


@pytest.mark.parametrize("name,placeholder", [("12", True), ("PARK 4", True), ("park  17", True), ("", True), ("Kent Parkı", False), ("PARK 1 Muhtarlık Çevresi", False)])
def test_placeholder(spark, name, placeholder):
    assert one(spark, X.is_placeholder("n"), n=name) is placeholder


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def matches(a, b):
    if a == b:
        return True
    if not a or not b:
        return False
    return 1 - edits(a, b) / max(len(a), len(b)) >= (0.75 if min(len(a), len(b)) >= 6 else 0.85)


def test_matched_count_against_brute_force(spark):
    cases = [(["gazi", "mustafa"], ["mustafa", "gazi", "kemal"]), (["ataturk", "ataturkk"], ["ataturk"]), ([], ["a"]), (["cumhuriyet"], []), (["barbaros", "barboros"], ["barboros", "barbaros"])]
    for a, b in cases:
        used, n = set(), 0
        for x in a:
            hit = next((i for i, y in enumerate(b) if i not in used and matches(x, y)), None)
            if hit is not None:
                used.add(hit)
                n += 1
        df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
        assert df.select(N.matched_count(F.col("a"), F.col("b"))).first()[0] == n


@pytest.mark.parametrize("a,b,kind", [
    ("Gazi Parkı", "GAZİ PARKI", "exact_normalized_name"), ("Gazi Parkı", "Gazi Çocuk Parkı", "core_equal"), ("Sht. Ali Veli Parkı", "Şehit Ali Veli Parkı", "exact_normalized_name"),
    ("Ali Veli Parkı", "Hasan Ali Veli Parkı", "core_contained"), ("Park", "Gazi Parkı", None), ("Cumhuriyet Parkı", "Cumhuriyat Parkı", "high_similarity"), ("Gazi 1 Parkı", "Gazi 2 Parkı", None),
])
def test_relationship(spark, a, b, kind):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(N.parse_name("a").alias("a"), N.parse_name("b").alias("b"))
    r = df.select(N.name_relationship(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert r["kind"] == kind
    assert r["numeric_conflict"] == (a == "Gazi 1 Parkı")


def test_ids(spark):
    import hashlib

    raw = bytearray(hashlib.sha256(b"ns:1").digest()[:16])
    raw[6], raw[8] = raw[6] & 15 | 0x50, raw[8] & 63 | 0x80
    h = raw.hex()
    assert one(spark, det_uuid("n"), n="ns:1") == f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    coded = one(spark, encode_serial("p", "r", "s"), p=u, r=u, s=" A/B 1 ")
    assert coded == f"{u}/{u}/A%2FB%201"
    assert one(spark, decode_serial("c"), c=coded)["serial"] == "A/B 1"
    assert one(spark, encode_serial("p", "r", "s"), p=u, r=u, s="  ") is None
    assert one(spark, encode_serial("p", "r", "s"), p="x", r=u, s="1") is None
    assert one(spark, decode_serial("c"), c="nonsense") is None


def test_sql_functions_equal_the_columns(spark):
    from gridloom.functions import geo, ids, names, sql, text

    assert "gl_fold" in sql.register(spark, "gl_")
    df = spark.createDataFrame([("  İSTANBUL  Çocuk Parkı 1 ",), ("Ağaç-lı Otopark",), ("",), (None,), ("IŞIK parkları",)], "n string")
    pairs = {
        "gl_fold(n)": text.fold("n"), "gl_name_key(n)": text.name_key("n"), "gl_core_key(n)": text.core_key("n"), "gl_has_park_word(n)": text.has_park_word("n"),
        "gl_det_uuid(n)": ids.det_uuid("n"), "gl_name_similarity(n, 'park')": names.similarity(F.col("n"), F.lit("park")),
        "gl_haversine_m(38.0D, 27.0D, 38.1D, 27.2D)": geo.haversine_m(F.lit(38.0), F.lit(27.0), F.lit(38.1), F.lit(27.2)), "gl_cosine_m(38.0D, 27.0D, 38.1D, 27.2D)": geo.cosine_m(F.lit(38.0), F.lit(27.0), F.lit(38.1), F.lit(27.2)),
    }
    for row in df.select(*(F.struct(F.expr(k).alias("a"), c.alias("b")).alias(f"c{i}") for i, (k, c) in enumerate(pairs.items()))).collect():
        for got, call in zip(row, pairs):
            assert got["a"] == pytest.approx(got["b"]), call


def test_sql_functions_of_evidence_and_rings(spark):
    from gridloom.functions import geo as G
    from gridloom.functions.names import name_evidence, parse_name
    from gridloom.functions.sql import register

    register(spark, "gl_")
    names = ["Gazi Parkı", "GAZİ PARKI", "Gazi Çocuk Parkı", "Menekşeler Bahçesi", "Menekşeler Bahcesı", "Menekşelar Bahçesi", "İsimsiz park", "", None, "Zafer 2"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    want = df.withColumn("k", name_evidence(parse_name("a"), parse_name("b"))["kind"])
    told = df.selectExpr("a", "b", "gl_name_evidence(a, b) as k")
    assert sorted(map(str, told.collect())) == sorted(map(str, want.collect()))
    assert {r["k"] for r in told.collect()} == {"exact_normalized_name", "same_core_name", "high_similarity", None}
    rings = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]]
    points = spark.createDataFrame([(x / 2, y / 2, rings) for x in range(-1, 10) for y in range(-1, 10)] + [(1.0, 1.0, []), (1.0, 1.0, [[]])], "lon double, lat double, rings array<array<array<double>>>")
    got = points.select(F.expr("gl_point_in_rings(lon, lat, rings)").alias("s"), G.in_rings_even_odd("lon", "lat", "rings").alias("c")).collect()
    assert all(r["s"] == r["c"] for r in got) and {r["s"] for r in got} == {True, False}
