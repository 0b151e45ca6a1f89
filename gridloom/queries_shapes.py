"""Registered queries over polygons that are not boxes, with the DuckDB text that says the same.

Every park has a triangle at its place, of 60 to 2,000 metres. DuckDB measures corner against edge for all pairs of triangles
whose boxes come near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import views as V
from gridloom.operators import polygons as P
from gridloom.operators import regions as R
from gridloom.plans import consolidate as C
from gridloom.registered import query, tenths

#: Names that no evidence joins to each other.
WORDS = ["Çınar", "Güneş", "Zafer", "Menekşe", "Deniz", "Kavak", "Bülbül"]
SIZE_SQL = "(case when {k} % 10 = 0 then 2e-2 when {k} % 10 < 4 then 3e-3 else 6e-4 end)"


def _size(k: Column) -> Column:
    return F.when(k % 10 == 0, 2e-2).when(k % 10 < 4, 3e-3).otherwise(6e-4)


def _triangle(lon: Column, lat: Column, wide: Column, high: Column) -> Column:
    corners = [(lon, lat), (lon + wide, lat + high * 0.217), (lon + wide * 0.3, lat + high), (lon, lat)]
    return F.array(F.array(F.array(*(F.array(x, y) for x, y in corners))))


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """Parks with a triangle, every seventh with none; every fifth unnamed and every eleventh with a number for a name."""
    k = F.col("id")
    name = F.when(k % 5 == 0, "İsimsiz park").when(k % 11 == 0, F.concat(F.lit("Park "), (k % 4).cast("string"))).otherwise(F.concat(F.get(F.array(*map(F.lit, WORDS)), (k * k % 31 % 7).cast("int")), F.lit(" Parkı")))
    size = _size(k)
    polys = F.when(k % 7 != 3, _triangle(F.col("longitude"), F.col("latitude"), size, size))
    return V.parks(spark, d).select("id", name.alias("name"), "district", "latitude", "longitude", polys.alias("polys"))


def corners_sql(source: str, lon: str, lat: str, wide: str, high: str) -> str:
    """v (id, i, x, y): three corners a shape."""
    return (
        f"v as (select id, i, case i when 0 then {lon} when 1 then {lon} + {wide} else {lon} + {wide} * 3e-1 end as x, "
        f"case i when 0 then {lat} when 1 then {lat} + {high} * 2.17e-1 else {lat} + {high} end as y from {source}, range(0, 3) t(i))"
    )


def _gap_sql(p: str, a: str, b: str, k: str) -> str:
    """Metres from point ``p`` to the segment ``a`` - ``b``, where ``k`` is the metres of a degree of longitude."""
    px, py = f"({p}.x - {a}.x) * {k}", f"({p}.y - {a}.y) * 110540"
    dx, dy = f"({b}.x - {a}.x) * {k}", f"({b}.y - {a}.y) * 110540"
    t = f"least(1e0, greatest(0e0, (({px}) * ({dx}) + ({py}) * ({dy})) / (({dx}) * ({dx}) + ({dy}) * ({dy}))))"
    return f"sqrt(pow(({px}) - {t} * ({dx}), 2) + pow(({py}) - {t} * ({dy}), 2))"


def _side(a: str, b: str, c: str) -> str:
    return f"(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"


def gaps_sql(near: str) -> str:
    """g (a, b, meets, gap): pairs of shapes. Triangles are counterclockwise, so a corner to the left of all edges is inside."""
    e = "e as (select p.id, p.i, p.x as ax, p.y as ay, q.x as cx, q.y as cy from v p join v q on q.id = p.id and q.i = (p.i + 1) % 3)"
    point = "v1"
    seg = "struct_pack(x := ax, y := ay) as ea, struct_pack(x := cx, y := cy) as eb"
    return f"""{e}, es as (select id, i, {seg} from e),
box as (select id, min(x) as w, max(x) as e, min(y) as s, max(y) as n from v group by id),
near as (select p.id as a, q.id as b from box p join box q on p.id < q.id and p.w <= q.e + {near} and q.w <= p.e + {near} and p.s <= q.n + {near} and q.s <= p.n + {near}),
lat as (select id, 111320 * cos(radians(y)) as k from v where i = 0),
pe as (
  select near.a, near.b, {_gap_sql(point, 'es.ea', 'es.eb', 'lat.k')} as gap, {_side('es.ea', 'es.eb', point)} > 0 as left_of, v1.id as owner, v1.i as i
  from near join lat on lat.id = near.a join v v1 on v1.id in (near.a, near.b) join es on es.id in (near.a, near.b) and es.id <> v1.id),
held as (select a, b, bool_and(left_of) as inside, min(gap) as gap from pe group by a, b, owner, i),
cr as (
  select distinct near.a, near.b from near join es m on m.id = near.a join es o on o.id = near.b
  where {_side('m.ea', 'm.eb', 'o.ea')} * {_side('m.ea', 'm.eb', 'o.eb')} < 0 and {_side('o.ea', 'o.eb', 'm.ea')} * {_side('o.ea', 'o.eb', 'm.eb')} < 0),
g as (
  select h.a, h.b, bool_or(inside) or bool_or(cr.a is not null) as meets, case when bool_or(inside) or bool_or(cr.a is not null) then 0e0 else min(gap) end as gap
  from held h left join cr on cr.a = h.a and cr.b = h.b group by h.a, h.b)"""


SHAPES = V.heads("parks") + f""", sh as (select id, district, latitude, longitude, case when id % 5 = 0 then 'İsimsiz park' when id % 11 = 0 then 'Park ' || id % 4 else ({WORDS!r})[id * id % 31 % 7 + 1] || ' Parkı' end as name,
  id % 5 = 0 or id % 11 = 0 as weak, id % 7 <> 3 as has from parks),
""" + corners_sql("sh", "longitude", "latitude", SIZE_SQL.format(k="id"), SIZE_SQL.format(k="id")).replace("from sh,", "from (select * from sh where has) sh,")


@query(SHAPES + f""", {gaps_sql('4e-3')}
select a, b, meets as intersects, cast(floor(gap + 0.5) as bigint) as gap, x.name = y.name and not x.weak as name_evidence, x.district = y.district as same_district
from g join sh x on x.id = a join sh y on y.id = b where round(gap, 3) <= 250""")
def polygon_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of triangles within 250 m, however far apart their reference points are."""
    e = P.pair_evidence(shapes(spark, d), 250)
    return e.select("a", "b", "intersects", F.floor(F.col("boundary_gap_m") + 0.5).cast("long").alias("gap"), "name_evidence", "same_district")


RECURSIVE = SHAPES.replace("with ", "with recursive ", 1)
REACH = "lk as (select a, b from {0} union all select b, a from {0}), reach(id, r) as (select id, id from sh union select reach.id, lk.b from reach join lk on lk.a = reach.r), comp as (select id, min(r) as component from reach group by id)"


@query(RECURSIVE + f""", {gaps_sql('1e-3')}, lg as (select a, b from g join sh x on x.id = a join sh y on y.id = b where x.name = y.name and round(gap, 3) <= 25), {REACH.format('lg')}
select id, component from comp""")
def same_name_clusters(spark: SparkSession, d: str) -> DataFrame:
    return P.name_clusters(shapes(spark, d), 25)


SOURCE_CLUSTERS = f"""{gaps_sql('3e-3')},
pts as (select a.id as a, b.id as b, {V.haversine_sql('a', 'b')} as d from sh a join sh b on a.id < b.id and abs(a.latitude - b.latitude) <= 0.004 and abs(a.longitude - b.longitude) <= 0.006),
one as (
  select p.a, p.b, {_gap_sql('pt', 'es.ea', 'es.eb', 'pt.k')} as gap, {_side('es.ea', 'es.eb', 'pt')} > 0 as left_of
  from pts p join (select id, longitude as x, latitude as y, 111320 * cos(radians(latitude)) as k from sh where not has) pt on pt.id in (p.a, p.b) join es on es.id in (p.a, p.b)),
op as (select a, b, case when bool_and(left_of) then 0e0 else min(gap) end as gap from one group by a, b),
me as (
  select pts.a, pts.b, d, x.has and y.has as two, case when x.has and y.has then round(g.gap, 3) else coalesce(op.gap, d) end as gap, x.name = y.name and not x.weak as agree, x.weak or y.weak as weak
  from pts join sh x on x.id = pts.a join sh y on y.id = pts.b left join g on g.a = pts.a and g.b = pts.b left join op on op.a = pts.a and op.b = pts.b where d <= 600),
ju as (select *, coalesce(case when two then gap = 0 else d <= 60 end, false) as overlap from me),
wh as (select a, b, case when overlap then case when agree or weak then 'one' else 'overlap_with_other_name' end when agree and gap <= 30 then 'one' when agree and gap <= 150 then 'namesake_nearby' end as why from ju),
lw as (select a, b from wh where why = 'one'), {REACH.format('lw')}, am as (select a as id, why from wh where why <> 'one' union all select b, why from wh where why <> 'one')"""

#: The same without a bound on the points of a pair: all pairs whose boxes come near, so that large shapes lose no link.
WHOLE_SOURCE_CLUSTERS = (
    SOURCE_CLUSTERS.replace("pts as (", "bx as (select * from box union all select id, longitude, longitude, latitude, latitude from sh where not has),\npts as (")
    .replace(
        "from sh a join sh b on a.id < b.id and abs(a.latitude - b.latitude) <= 0.004 and abs(a.longitude - b.longitude) <= 0.006",
        "from bx p join bx q on p.id < q.id and p.w <= q.e + 3e-3 and q.w <= p.e + 3e-3 and p.s <= q.n + 3e-3 and q.s <= p.n + 3e-3 join sh a on a.id = p.id join sh b on b.id = q.id",
    )
    .replace(" where d <= 600", "")
)


def _clusters(spark: SparkSession, d: str, reach_m: float | None = None) -> tuple[DataFrame, DataFrame]:
    return P.source_clusters(shapes(spark, d), same_point_m=60, reach_m=reach_m)


@query(RECURSIVE + f""", {WHOLE_SOURCE_CLUSTERS}, sz as (select component, count(*) as size, bool_or(id in (select id from am)) as any_near from comp group by 1)
select id, component, size, case when size < 2 then 'SINGLETON' when any_near then 'AMBIGUOUS' else 'FRAGMENTED' end as cluster_class, id in (select id from am) as ambiguous from comp join sz using (component)""")
def source_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of polygons and points of one source, however far apart their reference points are; points within 60 m count
    as one place here."""
    return P.cluster_classes(*_clusters(spark, d))


@query(RECURSIVE + f", {SOURCE_CLUSTERS} select a, b, why from wh where why <> 'one'")
def ambiguous_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Of records whose points are within 600 m."""
    return _clusters(spark, d, 600)[1]


@query(RECURSIVE + f""", {SOURCE_CLUSTERS}
select {V.key_sql('name')} as key, count(*) as records, case when count(distinct component) = 1 then 'FRAGMENTED' when bool_or(id in (select id from am where why = 'namesake_nearby')) then 'AMBIGUOUS' else 'DISTINCT' end as group_class
from sh join comp using (id) where not weak group by 1 having count(*) > 1""")
def namesakes(spark: SparkSession, d: str) -> DataFrame:
    """By the clusters of records whose points are within 600 m."""
    components, ambiguous = _clusters(spark, d, 600)
    return P.namesake_groups(components, shapes(spark, d), ambiguous)


# Four triangles beside each other make a cluster; those of every other one are thin.
CLUSTERED = V.heads("source") + """, cl as (select m.id, m.id // 4 as c, a.longitude + (m.id % 4) * 4e-4 * (1 + m.id // 4 % 3 * 4) as lon, a.latitude as lat, 5e-4 * (1 + m.id // 4 % 3 * 4) as wide, case when m.id // 4 % 2 = 0 then 1e-5 * (1 + m.id // 4 % 40) else 8e-4 end as high from source m join source a on a.id = m.id // 4 * 4),
""" + corners_sql("cl", "lon", "lat", "wide", "high") + """, vm as (select c, v.*, first_value(y) over (partition by c order by v.id, i) as y0 from v join cl using (id)),
ar as (select c, id, 111320 * cos(radians(any_value(y0))) * 110540 * abs((max(x) filter (i = 1) - max(x) filter (i = 0)) * (max(y) filter (i = 2) - max(y) filter (i = 0)) - (max(x) filter (i = 2) - max(x) filter (i = 0)) * (max(y) filter (i = 1) - max(y) filter (i = 0))) / 2 as area from vm group by c, id),
ex as (select p.c, max(sqrt(pow((p.x - q.x) * 111320 * cos(radians(p.y0)), 2) + pow((p.y - q.y) * 110540, 2))) as extent from vm p join vm q on p.c = q.c group by p.c),
sp as (select c, area, extent, area / (extent * extent) < 1e-2 as linear, area / (extent * extent) < 1e-2 and area / extent < 8 as path_like from (select c, sum(area) as area from ar group by c) join ex using (c))"""


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    m, k = V.source(spark, d), F.col("id")
    at = m.select(F.col("id").alias("_a"), F.col("longitude").alias("_x"), F.col("latitude").alias("_y"))
    c = F.expr("id div 4")
    high = F.when(c % 2 == 0, (1 + c % 40) * 1e-5).otherwise(8e-4)
    placed = m.join(at, F.col("_a") == c * 4)
    return placed.select("id", F.concat(F.lit("c"), c.cast("string")).alias("component"), _triangle(F.col("_x") + (k % 4) * 4e-4 * (1 + c % 3 * 4), F.col("_y"), (1 + c % 3 * 4) * 5e-4, high).alias("polys"))


@query(CLUSTERED + f" select 'c' || c as component, cast(floor(area + 0.5) as bigint) as area, {tenths('extent')} as extent, linear, path_like from sp")
def cluster_shapes(spark: SparkSession, d: str) -> DataFrame:
    s = P.shape_metrics(_clustered(spark, d))
    return s.select("component", F.floor(F.col("area_m2") + 0.5).cast("long").alias("area"), F.floor(F.col("max_extent_m") * 10 + 0.5).cast("long").alias("extent"), "linear", "path_like")


@query(CLUSTERED + """, f as (select id // 4 as c, avg(case when id // 4 % 3 <> 0 and id % 4 < 3 then 1.0 else 0 end) >= 0.5 as park, avg(case when id // 4 % 5 < 3 and id % 4 < 3 then 1.0 else 0 end) >= 0.5 as layer, avg(case when id // 4 % 7 > 3 and id % 4 < 3 then 1.0 else 0 end) >= 0.5 as non, avg(case when id // 4 % 11 > 5 and id % 4 < 3 then 1.0 else 0 end) >= 0.5 as fac from source group by 1),
l as (select f.*, park::int + layer::int as strength, coalesce(linear, false) as linear, coalesce(path_like, false) as path_like from f left join sp using (c))
select 'c' || c as component, case when non and not park then 'NON_PARK' when fac and not park then 'TAXONOMY_AMBIGUOUS' else (['TAXONOMY_AMBIGUOUS', 'PARK_LIKELY', 'PARK_CONFIRMED'])[greatest(0, strength - (path_like or (linear and strength = 1))::int) + 1] end as taxonomy_class from l""")
def gated_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The gate over shapes measured from the clusters' polygons."""
    c, most = F.expr("id div 4"), F.col("id") % 4 < 3
    m = V.source(spark, d).select(
        F.concat(F.lit("c"), c.cast("string")).alias("component"), ((c % 3 != 0) & most).alias("name_park_word"), ((c % 5 < 3) & most).alias("layer_park_token"),
        ((c % 7 > 3) & most).alias("non_park_keyword"), ((c % 11 > 5) & most).alias("facility_name"), F.lit(False).alias("green_space_name"),
    )
    return C.taxonomy_gate(m, P.shape_metrics(_clustered(spark, d))).select("component", "taxonomy_class")


@query(V.heads("parks", "edges") + """, far as (select id, latitude + id % 3 * 5e-1 as lat, longitude + id % 4 * 3e-1 as lon from parks),
m as (select far.id, region, (x1 - lon) * 111320 * cos(radians(lat)) as ax, (y1 - lat) * 110540 as ay, (x2 - x1) * 111320 * cos(radians(lat)) as dx, (y2 - y1) * 110540 as dy from far, edges),
s as (select *, least(1e0, greatest(0e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) as t from m),
b as (select id, region, cast(floor(min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) + 0.5) as bigint) as metre from s group by id, region)
select id, (min(struct_pack(m := metre, r := region))).r as region, min(metre) as distance_m from b group by id""")
def nearest_regions_far(spark: SparkSession, d: str) -> DataFrame:
    """Parks moved up to a degree away from every region."""
    k = F.col("id")
    far = V.parks(spark, d).select("id", (F.col("latitude") + k % 3 * 0.5).alias("latitude"), (F.col("longitude") + k % 4 * 0.3).alias("longitude"))
    return R.nearest_region_any(far, V.region_edges(spark, d))


# Every third park has a box of its own, every twelfth of them two; every other park has a named point 11 m north of it.
ENRICH = V.heads("parks") + f""", pk as (select id, name, case when id % 4 = 0 then '' else district end as district, latitude, longitude, id % 5 = 0 as unnamed, case when id % 9 = 0 then 'Eski adres' else '' end as label from parks),
bx as (select id, 'Poly ' || id % 50 as name, longitude as x, latitude as y from parks where id % 3 = 1 union all select id + 10000000, 'Ikinci ' || id % 50, longitude, latitude from parks where id % 12 = 1),
inb as (select pk.id, bx.id as box, bx.name from pk join bx on abs(pk.longitude - x) < 5e-4 and abs(pk.latitude - y) < 5e-4),
sole as (select id, name as poly from (select *, count(*) over (partition by id) as p, count(*) over (partition by box) as b from inb) where p = 1 and b = 1),
pt as (select id, case when id % 8 = 1 then 'Poly ' || id % 50 else 'Nokta ' || id % 30 end as name, case when id % 5 <> 2 then 'Mah' || id % 6 else '' end as hood, latitude + 1e-4 as latitude, longitude from parks where id % 2 = 1),
pp as (select a.id as pid, b.id as id, a.name as point, a.hood from pt a join parks b on {V.haversine_sql('a', 'b')} <= 25 and abs(a.latitude - b.latitude) < 1e-3),
rp as (select id, point, hood from (select *, count(*) over (partition by pid) as p, count(*) over (partition by id) as b from pp) where p = 1 and b = 1),
ds as (select * from (values ('Kuzey', 38e0, 38.1e0), ('Güney', 38.1e0, 39e0), ('Üst', 38.15e0, 39e0)) t(district, low, high)),
di as (select pk.id, min(ds.district) as found from pk join ds on latitude >= low and latitude < high and longitude > 26 and longitude < 44 group by pk.id having count(*) = 1),
en as (
  select pk.id, label, unnamed, point, hood, pk.name as old, case when district = '' then coalesce(di.found, '') else district end as district,
    case when unnamed then coalesce(case when poly is not null and (point is null or {V.key_sql('point')} = {V.key_sql('poly')}) then poly when pk.id not in (select id from inb) then point end, pk.name) else pk.name end as name
  from pk left join sole using (id) left join rp using (id) left join di using (id)),
ad as (select {V.key_sql('name')} as k, {V.key_sql('district')} as e, 'Adres ' || id as address from en where id % 7 = 2),
ak as (select k, e, min(address) as address from ad group by k, e having count(*) = 1),
ek as (select {V.key_sql('name')} as k, {V.key_sql('district')} as e, min(id) as id from en group by 1, 2 having count(*) = 1)"""


@query(ENRICH + f""" select en.id, en.name, en.district, case when en.name <> old then 'municipal' else 'source' end as name_status,
  coalesce(nullif(label, ''), case when hood <> '' and (unnamed or {V.key_sql('old')} = {V.key_sql('point')}) then hood || ' Mahallesi' end, ak.address) as address_label
from en left join ek using (id) left join ak on ak.k = ek.k and ak.e = ek.e and ek.k <> ''""")
def enriched_catalog(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    base = V.parks(spark, d)
    parks = base.select("id", "name", F.when(k % 4 == 0, "").otherwise(F.col("district")).alias("district"), "latitude", "longitude", F.lit("source").alias("name_status"), F.when(k % 9 == 0, "Eski adres").otherwise("").alias("address_label"))
    boxes = base.where("id % 3 = 1").select(k.alias("region"), F.concat(F.lit("Poly "), (k % 50).cast("string")).alias("name"), "latitude", "longitude")
    boxes = boxes.union(base.where("id % 12 = 1").select(k + 10_000_000, F.concat(F.lit("Ikinci "), (k % 50).cast("string")), "latitude", "longitude"))
    west, south = F.col("longitude") - 5e-4, F.col("latitude") - 5e-4
    ring = F.array(*(F.array(west + x, south + y) for x, y in ((0.0, 0.0), (1e-3, 0.0), (1e-3, 1e-3), (0.0, 1e-3), (0.0, 0.0))))
    edges = R.region_edges(boxes.select("region", F.array(F.array(ring)).alias("polys")))
    point = F.when(k % 8 == 1, F.concat(F.lit("Poly "), (k % 50).cast("string"))).otherwise(F.concat(F.lit("Nokta "), (k % 30).cast("string")))
    points = base.where("id % 2 = 1").select("id", point.alias("name"), F.when(k % 5 != 2, F.concat(F.lit("Mah"), (k % 6).cast("string"))).otherwise("").alias("neighborhood"), (F.col("latitude") + 1e-4).alias("latitude"), "longitude")
    bands = [("Kuzey", 38.0, 38.1), ("Güney", 38.1, 39.0), ("Üst", 38.15, 39.0)]
    corners = lambda low, high: [(26.0, low), (44.0, low), (44.0, high), (26.0, high), (26.0, low)]
    districts = spark.createDataFrame([(n, *a, *b) for n, low, high in bands for a, b in zip(corners(low, high), corners(low, high)[1:])], "region string, x1 double, y1 double, x2 double, y2 double")
    named = C.enrich_catalog(parks, edges, boxes.select("region", "name"), points, districts, parks.select("name", "district", F.lit("").alias("address")).limit(0))
    addresses = named.where("id % 7 = 2").select("name", "district", F.concat(F.lit("Adres "), k.cast("string")).alias("address"))
    return C.enrich_catalog(parks, edges, boxes.select("region", "name"), points, districts, addresses).select("id", "name", "district", "name_status", "address_label")


# Records of the source as points against the triangles of the parks.
POINTS = f"""e as (select p.id, p.i, p.x as ax, p.y as ay, q.x as cx, q.y as cy from v p join v q on q.id = p.id and q.i = (p.i + 1) % 3),
es as (select id, i, struct_pack(x := ax, y := ay) as ea, struct_pack(x := cx, y := cy) as eb from e),
box as (select id, min(x) as w, max(x) as e, min(y) as s, max(y) as n from v group by id),
pt as (select id, longitude as x, latitude as y, 111320 * cos(radians(latitude)) as k from source),
pn as (
  select pt.id, box.id as region, bool_and({_side('es.ea', 'es.eb', 'pt')} > 0) as held, min({_gap_sql('pt', 'es.ea', 'es.eb', 'pt.k')}) as gap
  from pt join box on pt.x between w - 5e-3 and e + 5e-3 and pt.y between s - 5e-3 and n + 5e-3 join es on es.id = box.id group by 1, 2)"""


@query(SHAPES.replace("parks as (", V.SQL["source"] + ", parks as (", 1) + f""", {POINTS}, h as (select id, region, count(*) over (partition by id) as p, count(*) over (partition by region) as r from pn where held)
select id, region from h where p = 1 and r = 1""")
def uniquely_contained(spark: SparkSession, d: str) -> DataFrame:
    edges = R.region_edges(shapes(spark, d).where("polys is not null").select(F.col("id").alias("region"), "polys"))
    return R.unique_containment(V.source(spark, d), edges)


@query(SHAPES.replace("parks as (", V.SQL["source"] + ", parks as (", 1) + f""", {POINTS},
f as (select region, count(*) filter (held) as inside, count(*) filter (held or gap <= 30) as close, count(*) filter (held or gap <= 300) as near from pn group by region)
select sh.id as region, case when inside = 1 then 'contained_single' when inside > 1 then 'multiple_contained' when id % 5 = 0 and close = 1 then 'generic_fragment' when id % 5 = 0 and close > 1 then 'generic_multiple'
  when id % 5 <> 0 and near > 0 then 'named_near' else 'unanchored' end as klass from sh left join f on f.region = sh.id where has""")
def classified_polygons(spark: SparkSession, d: str) -> DataFrame:
    t = shapes(spark, d).where("polys is not null").withColumnRenamed("id", "region")
    return C.classify_polygons(V.source(spark, d), R.region_edges(t.select("region", "polys")), t.select("region", "name"))
