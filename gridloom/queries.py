"""The registered queries over the registry, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import views as V
from gridloom.functions.ids import decode_serial, det_uuid, encode_serial
from gridloom.functions.names import name_evidence, name_relationship
from gridloom.functions.rules import feeding_error
from gridloom.functions.text import core_key, fold, has_park_word, name_key, turkish_title
from gridloom.operators import activity as A
from gridloom.operators import regions as R
from gridloom.operators import spatial as S
from gridloom.operators import tables as T
from gridloom.operators.polygons import connected_components
from gridloom.plans import ingest as I
from gridloom.plans import readiness, registry, serials
from gridloom.registered import KEY, NEAR, NOW, ORACLE_SQL, QUERIES, H, metres, query, tenths
from gridloom.sources.sinks import tile_features, tile_list
from gridloom.streaming.events import rate_limited_batch

# --- activity ---------------------------------------------------------------------------------------------------------

SUMMARY = """f as (select park_id, count(*) as records,
  arg_max(struct_pack(t := occurred_at, g := food_grams), struct_pack(t := occurred_at, i := id)) filter (food_grams > 0) as f,
  arg_max(struct_pack(t := occurred_at, g := water_ml), struct_pack(t := occurred_at, i := id)) filter (water_ml > 0) as w
  from feedings where status = 'published' group by park_id)"""


@query(V.heads("parks", "feedings") + f""", {SUMMARY}
select parks.id, name, city, coalesce(records, 0) as records, f.t as last_food_at, f.g as food_grams, w.t as last_water_at, w.g as water_ml from parks left join f on f.park_id = parks.id""")
def park_summaries(spark: SparkSession, d: str) -> DataFrame:
    return A.park_summaries(V.parks(spark, d).select("id", "name", "city"), V.feedings(spark, d))


@query(V.heads("parks", "feedings") + f""", {SUMMARY},
p as (select * from parks where active and latitude between 38.05 and 38.15 and longitude between 27.05 and 27.15
  order by pow(latitude - (38.05e0 + 38.15e0) / 2, 2) + pow(longitude - (27.05e0 + 27.15e0) / 2, 2), id limit 200)
select p.id, name, coalesce(records, 0) as records, f.t as last_food_at, w.t as last_water_at from p left join f on f.park_id = p.id""")
def viewport_parks(spark: SparkSession, d: str) -> DataFrame:
    return A.viewport_parks(V.parks(spark, d), V.feedings(spark, d), (38.05, 38.15, 27.05, 27.15)).select("id", "name", "records", "last_food_at", "last_water_at")


@query(V.heads("parks") + f""" select parks.id, {tenths(H('parks', 'c'))} as dm from parks, (select 38.1e0 as latitude, 27.1e0 as longitude) c order by {H('parks', 'c')}, parks.id limit 200""")
def nearest_parks(spark: SparkSession, d: str) -> DataFrame:
    return A.nearest(V.parks(spark, d), 38.1, 27.1).select("id", metres("distance_m").alias("dm"))


@query(V.heads("feedings") + """ select id, user_id, park_id, occurred_at from feedings where status = 'published' and (occurred_at, id) < (timestamp '2024-01-15 00:00:00', 5000) order by occurred_at desc, id desc limit 30""")
def feed_page(spark: SparkSession, d: str) -> DataFrame:
    return A.feed_page(V.feedings(spark, d), ("2024-01-15 00:00:00", 5000)).select("id", "user_id", "park_id", "occurred_at")


LEDGER = """ledger as (select user_id, 'feeding' as t, id, 10 as points from feedings where status = 'published' union all select user_id, 'observation', id, 2 from observations)"""


@query(V.heads("feedings", "observations") + f""", {LEDGER} select user_id, cast(sum(points) as bigint) as points from ledger group by user_id""")
def user_points(spark: SparkSession, d: str) -> DataFrame:
    f, o = V.feedings(spark, d), V.observations(spark, d)
    ledger = A.points_active(A.post_points(f, o), f)
    return ledger.groupBy("user_id").agg(F.sum("points").alias("points"))


@query(V.heads("feedings", "observations") + f""", {LEDGER} select user_id, cast(sum(points) as bigint) as points, concat('U', cast(user_id % 10 as varchar)) as display_name from ledger group by user_id order by 2 desc, 1 limit 100""")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    f, o = V.feedings(spark, d), V.observations(spark, d)
    profiles = f.select("user_id", F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("display_name")).distinct()
    return A.leaderboard(A.points_active(A.post_points(f, o), f), profiles, 1000)


@query(V.heads("feedings") + f""" select id, user_id, count(*) over (partition by user_id order by occurred_at range between interval 24 hours preceding and current row) as in_window,
  count(*) over (partition by user_id order by occurred_at range between interval 24 hours preceding and current row) > 5 as over_limit from feedings""")
def trailing_audit(spark: SparkSession, d: str) -> DataFrame:
    return T.trailing_count_audit(V.feedings(spark, d), ["user_id"], "occurred_at", 86_400, 5).select("id", "user_id", "in_window", "over_limit")


@query(V.heads("observations") + """ select id, coalesce(observed_at < lag(observed_at) over (partition by user_id, point_id order by observed_at) + interval 720 minutes, false) as too_soon from observations""")
def cooldown_audit(spark: SparkSession, d: str) -> DataFrame:
    return T.cooldown_audit(V.observations(spark, d), ["user_id", "point_id"], "observed_at", 720).select("id", "too_soon")


@query()
def accepted_events(spark: SparkSession, d: str) -> DataFrame:
    """Rate limits that count accepted events only: a fold, which SQL can't say; tested against brute force."""
    return rate_limited_batch(V.observations(spark, d).withColumnRenamed("observed_at", "at"), 6, 3, 3600)


@query(V.heads("feedings") + f""" select id, case when food_grams = 0 and water_ml = 0 then 'nothing_given'
  when occurred_at > timestamp '{NOW}' + interval 5 minutes then 'in_the_future' when occurred_at < timestamp '{NOW}' - interval 90 days then 'too_old' end as error from feedings""")
def feeding_errors(spark: SparkSession, d: str) -> DataFrame:
    f = V.feedings(spark, d).withColumn("food_type", F.lit("dry")).withColumn("note", F.lit("")).withColumn("photo_path", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".jpg")))
    return f.select("id", feeding_error(F.lit(NOW).cast("timestamp")).alias("error"))


@query(V.heads("parks", "feedings", "observations") + f""", l as (select park_id, max(occurred_at) as t from feedings where status = 'published' and food_grams > 0 group by 1),
o as (select park_id, arg_max(struct_pack(f := food_status, w := water_status, t := observed_at), struct_pack(t := observed_at, i := id)) as o from observations group by 1)
select parks.id, case when o.o.t > timestamp '2024-01-30 12:00:00' - interval 24 hours and (o.o.f = 'empty' or o.o.w = 'empty') then 'check'
  when l.t is null then 'unknown' when l.t < timestamp '2024-01-30 12:00:00' - interval 7 days then 'old' else 'recent' end as state
from parks left join l on l.park_id = parks.id left join o on o.park_id = parks.id""")
def park_states(spark: SparkSession, d: str) -> DataFrame:
    summaries = A.park_summaries(V.parks(spark, d).select("id"), V.feedings(spark, d), V.observations(spark, d))
    return A.summary_status(summaries, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("id", "state")


def _lifecycle(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = V.parks(spark, d)
    aliases = p.where("id % 13 = 1 and id % 17 <> 2").select(F.col("id").alias("retired_id"), (F.col("id") - 1).alias("survivor_id"))
    return aliases, p.where("id % 17 = 2").select(F.col("id").alias("retired_id"), F.lit("non_park").alias("kind"))


LIFECYCLE = """aliases as (select id as retired_id, id - 1 as survivor_id from parks where id % 13 = 1 and id % 17 <> 2), tombs as (select id as retired_id from parks where id % 17 = 2)"""


@query(V.heads("parks", "feedings") + f""", {LIFECYCLE} select i.id, case when a.retired_id is not null then 'alias' when t.retired_id is not null then 'tombstone_non_park' when p.active then 'live' when p.id is not null then 'inactive' else 'not_found' end as status,
  coalesce(a.survivor_id, case when p.active and t.retired_id is null then p.id end) as survivor_id
from (select distinct id from feedings) i left join aliases a on a.retired_id = i.id left join tombs t on t.retired_id = i.id left join parks p on p.id = i.id""")
def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    return A.resolve_ids(V.feedings(spark, d), V.parks(spark, d), *_lifecycle(spark, d))


@query(V.heads("parks", "feedings") + f""", {LIFECYCLE}, fav as (select user_id, park_id, min(occurred_at) as created_at from feedings group by 1, 2)
select user_id, coalesce(a.survivor_id, park_id) as park_id, min(created_at) as created_at from fav left join aliases a on a.retired_id = park_id group by 1, 2""")
def rekeyed_favorites(spark: SparkSession, d: str) -> DataFrame:
    return _rekeyed_lists(spark, d)[0]


def _rekeyed_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Favorites and suggestions: one of either a user and park; every third suggestion is pending."""
    f = V.feedings(spark, d)
    fav = f.groupBy("user_id", "park_id").agg(F.min("occurred_at").alias("created_at"))
    made = f.select("user_id", "park_id").distinct().withColumn("status", F.when((F.col("user_id") + F.col("park_id")) % 3 == 0, "pending").otherwise("approved"))
    return A.rekey_favorites(fav, made, _lifecycle(spark, d)[0])


@query(V.heads("parks", "feedings") + f""", {LIFECYCLE}, sug as (select distinct user_id, park_id as was, case when (user_id + park_id) % 3 = 0 then 'pending' else 'approved' end as status from feedings),
mv as (select sug.*, coalesce(a.survivor_id, was) as goes from sug left join aliases a on a.retired_id = was)
select user_id, case when status = 'pending' and not exists (select 1 from sug o where o.status = 'pending' and o.user_id = mv.user_id and o.was = goes) then goes else was end as park_id, status from mv""")
def rekeyed_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return _rekeyed_lists(spark, d)[1].select("user_id", "park_id", "status")


# --- text and ids -----------------------------------------------------------------------------------------------------


@query(f"""select p_partkey, {KEY("concat(replace(p_name, 'i', 'I'), ' ÇOCUK Parkı')")} as name_key, regexp_replace({KEY("concat(replace(p_name, 'i', 'I'), ' ÇOCUK Parkı')")}, 'cocukparki$', '') as core from part""")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit("i"), F.lit("I")), F.lit(" ÇOCUK Parkı")).alias("n"))
    return p.select("p_partkey", name_key("n").alias("name_key"), core_key("n").alias("core"))


@query(f"""select lang, count(*) as docs, count(*) filter ({V.plain_sql("text")} like '%que%') as hits, cast(sum(length({KEY("text")})) as bigint) as folded from documents group by lang""")
def folded_search(spark: SparkSession, d: str) -> DataFrame:
    t = V.table(spark, d, "documents").select("lang", F.contains(fold("text"), F.lit("que")).alias("hit"), F.length(name_key("text")).alias("n"))
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if("hit").alias("hits"), F.sum("n").alias("folded"))


@query("""select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: case when w[1] = 'i' then 'İ' else upper(w[1]) end || w[2:]), ' ') as title from part""")
def titles(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "part").select("p_partkey", turkish_title("p_name").alias("title"))


@query(V.heads("parks", "source") + """ select name, count(*) as n, regexp_matches(lower(name), '(^|[^a-zçğıöşü0-9])park(lar)?[ıi]?($|[^a-zçğıöşü0-9])') as park_word from (select name from source union all select name || 'mat' from source union all select name from parks) group by name""")
def park_words(spark: SparkSession, d: str) -> DataFrame:
    s = V.source(spark, d).select("name")
    names = s.union(s.select(F.concat("name", F.lit("mat")))).union(V.parks(spark, d).select("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("park_word", has_park_word("name"))


@query("""with h as (select p_partkey, sha256('ns:' || cast(p_partkey as varchar)) as h from part)
select p_partkey, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || substr('89ab89ab89ab89ab', cast('0x' || substr(h,17,1) as int) + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12) as uuid from h""")
def uuids(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "part").select("p_partkey", det_uuid(F.concat(F.lit("ns:"), F.col("p_partkey").cast("string"))).alias("uuid"))


PACKAGE = "0f8fad5b-d9cb-469f-a165-70867728950e"


@query(f"""select p_partkey, '{PACKAGE}/7c9e6679-7425-40de-944b-e07fc1f90ae7/' || replace(p_name, ' ', '%20') || '%2F' || cast(p_partkey as varchar) as external_id, p_name || '/' || cast(p_partkey as varchar) as serial from part""")
def scoped_serials(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part").withColumn("s", F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")))
    coded = p.withColumn("external_id", encode_serial(F.lit(PACKAGE.upper()), F.lit("7c9e6679-7425-40de-944b-e07fc1f90ae7"), "s"))
    return coded.select("p_partkey", "external_id", decode_serial("external_id")["serial"].alias("serial"))


@query(V.heads("parks") + f""", w as (select id, unnest(list_distinct(regexp_split_to_array({V.plain_sql('name')}, '[^a-z0-9]+'))) as token from parks)
select token, count(*) as n from w where token <> '' group by token having count(*) >= 15""")
def common_tokens(spark: SparkSession, d: str) -> DataFrame:
    return T.common_tokens(V.parks(spark, d))


# --- distance joins ---------------------------------------------------------------------------------------------------

@query(V.heads("parks", "source") + f""" select a.id as source_id, b.id as park_id, {tenths(H('a', 'b'))} as dm, {KEY('a.name')} = {KEY('b.name')} as same_name from source a join parks b on {NEAR} where {H('a', 'b')} <= 150""")
def within_radius(spark: SparkSession, d: str) -> DataFrame:
    pairs = S.within_radius(V.source(spark, d), V.parks(spark, d), 150)
    return pairs.select(F.col("a.id").alias("source_id"), F.col("b.id").alias("park_id"), metres("distance_m").alias("dm"), (name_key("a.name") == name_key("b.name")).alias("same_name"))


@query(V.heads("parks", "source") + f""", p as (select a.id as source_id, b.id as park_id, {H('a', 'b')} as m from source a join parks b on {NEAR} where {H('a', 'b')} <= 300)
select source_id, park_id, {tenths('m')} as dm from (select *, min(m) over (partition by source_id) as least from p) where least > 100 or m <= 100""")
def tiered_match(spark: SparkSession, d: str) -> DataFrame:
    pairs = S.tiered_match(V.source(spark, d), V.parks(spark, d), (100, 300))
    return pairs.select(F.col("a.id").alias("source_id"), F.col("b.id").alias("park_id"), metres("distance_m").alias("dm"))


@query(V.heads("parks", "source") + f""", p as (select a.id as source_id, b.id as park_id from source a join parks b on {NEAR} where {H('a', 'b')} <= 60)
select source_id, park_id from (select *, count(*) over (partition by source_id) as s, count(*) over (partition by park_id) as p from p) where s = 1 and p = 1""")
def unique_points(spark: SparkSession, d: str) -> DataFrame:
    return S.unique_point_match(V.source(spark, d), V.parks(spark, d), 60).select(F.col("a.id").alias("source_id"), F.col("b.id").alias("park_id"))


@query(V.heads("parks") + f""", p as (select a.id as x, b.id as y from parks a join parks b on a.id < b.id and {NEAR} and {KEY('a.name')} = {KEY('b.name')} where {KEY('a.name')} <> '' and {H('a', 'b')} <= 500)
select id, name from parks where id in (select x from p union select y from p)""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return S.near_duplicates(V.parks(spark, d).select("id", "name", "latitude", "longitude"), 500).select("id", "name")


@query(V.heads("parks") + f""" select a.id as id_a, b.id as id_b, {tenths(H('a', 'b'))} as dm, 'osm-osm' as pair_type, {KEY('a.name')} = {KEY('b.name')} as same_name from parks a join parks b on a.id < b.id and {NEAR} where {H('a', 'b')} <= 400""")
def possible_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return S.possible_duplicates(V.parks(spark, d), 400).select("id_a", "id_b", metres("distance_m").alias("dm"), "pair_type", "same_name")


@query(V.heads("parks", "source") + f""", p as (select a.id, min({H('a', 'b')}) as m from source a join parks b on {NEAR} where {H('a', 'b')} <= 400 group by 1),
m as (select source.id, m from source left join p using (id))
select case when m is null then 'none' when m <= 30 then '<=30' when m <= 100 then '30-100' when m <= 150 then '100-150' when m <= 250 then '150-250' else '>250' end as band, count(*) as n from m group by 1""")
def distance_bands(spark: SparkSession, d: str) -> DataFrame:
    s = V.source(spark, d)
    best = S.best_candidate(S.within_radius(s, V.parks(spark, d), 400), "a.id").select("a.id", "distance_m")
    return T.distance_bands(s.select("id").join(best, "id", "left"), "distance_m")


def _edit(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::double)"


@query(V.heads("parks", "source") + f""", p as (select a.id as source_id, b.id as park_id, {KEY('a.name')} as ka, {KEY('b.name')} as kb, regexp_replace({KEY('a.name')}, 'parki$', '') as ca, regexp_replace({KEY('b.name')}, 'parki$', '') as cb
  from source a join parks b on {NEAR} where {H('a', 'b')} <= 400)
select source_id, park_id, case when ca in ('', 'isimsizpark') or cb in ('', 'isimsizpark') then null when ka = kb then 'exact_normalized_name' when ca = cb then 'same_core_name' when {_edit('ka', 'kb')} >= 0.88 then 'high_similarity' end as kind from p""")
def name_evidences(spark: SparkSession, d: str) -> DataFrame:
    pairs = S.within_radius(S.with_parsed(V.source(spark, d)), S.with_parsed(V.parks(spark, d)), 400)
    return pairs.select(F.col("a.id").alias("source_id"), F.col("b.id").alias("park_id"), name_evidence(F.col("a.parsed"), F.col("b.parsed"))["kind"].alias("kind"))


@query()
def name_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Greedy word matching isn't SQL; tested against brute force."""
    pairs = S.within_radius(S.with_parsed(V.source(spark, d)), S.with_parsed(V.parks(spark, d)), 400)
    return pairs.select(F.col("a.id").alias("source_id"), F.col("b.id").alias("park_id"), name_relationship(F.col("a.parsed"), F.col("b.parsed")).alias("r")).select("source_id", "park_id", "r.*")


@query(V.heads("parks", recursive=True) + f""", e as (select a.id as a, b.id as b from parks a join parks b on a.id <> b.id and {NEAR} where {H('a', 'b')} <= 400),
reach(id, r) as (select id, id from parks union select reach.id, e.b from reach join e on e.a = reach.r)
select id, min(r) as component from reach group by id""")
def park_components(spark: SparkSession, d: str) -> DataFrame:
    p = V.parks(spark, d)
    return connected_components(p, S.proximity_edges(p, 400))


@query(V.heads("parks") + """, z as (select unnest([10, 13, 16]) as zoom), c as (select z.zoom, cast(floor((longitude / 360 + 0.5) * pow(2e0, zoom) * 256 / 62) as bigint) as cx,
  cast(floor((0.5 - ln((1 + sin(radians(latitude))) / (1 - sin(radians(latitude)))) / (4 * 3.141592653589793e0)) * pow(2e0, zoom) * 256 / 62) as bigint) as cy from parks, z)
select zoom, cx, cy, count(*) as n from c group by 1, 2, 3""")
def map_clusters(spark: SparkSession, d: str) -> DataFrame:
    return T.map_clusters(V.parks(spark, d), [10, 13, 16]).select("zoom", "cx", "cy", "n")


# --- regions ----------------------------------------------------------------------------------------------------------

INSIDE = """hit as (select p.id, e.region from parks p join edges e on (e.y1 > p.latitude) <> (e.y2 > p.latitude) and p.longitude < (e.x2 - e.x1) * (p.latitude - e.y1) / (e.y2 - e.y1) + e.x1),
inside as (select id, region from hit group by id, region having count(*) % 2 = 1)"""
SEGMENT = """seg as (select p.id, e.region, (e.x1 - p.longitude) * 111320 * cos(radians(p.latitude)) as px, (e.y1 - p.latitude) * 110540 as py, (e.x2 - p.longitude) * 111320 * cos(radians(p.latitude)) as qx, (e.y2 - p.latitude) * 110540 as qy from parks p, edges e),
seg2 as (select *, case when pow(qx-px,2)+pow(qy-py,2) = 0 then 0e0 else greatest(0, least(1, (0 - (px*(qx-px)+py*(qy-py)))/(pow(qx-px,2)+pow(qy-py,2)))) end as t from seg),
dist as (select id, region, cast(floor(min(sqrt(pow(px+t*(qx-px),2)+pow(py+t*(qy-py),2))) + 0.5) as bigint) as m, min(sqrt(pow(px+t*(qx-px),2)+pow(py+t*(qy-py),2))) as raw from seg2 group by 1, 2)"""


@query(V.heads("parks", "edges") + f""", {INSIDE} select id, region from inside""")
def parks_in_regions(spark: SparkSession, d: str) -> DataFrame:
    return R.contained_in(V.parks(spark, d), V.region_edges(spark, d))


@query(V.heads("parks", "edges") + f""", {INSIDE}, {SEGMENT}, near as (select id, min(struct_pack(m := m, r := region)) as b from dist where raw <= 2000 group by id)
select p.id, coalesce(i.region, b.r) as region, case when i.region is not null then 'contained' when b is not null then 'nearest' else 'unresolved' end as method
from parks p left join inside i using (id) left join near using (id)""")
def assigned_regions(spark: SparkSession, d: str) -> DataFrame:
    return R.assign_region(V.parks(spark, d), V.region_edges(spark, d))


@query(V.heads("parks", "edges") + f""", {SEGMENT}, near as (select id, min(struct_pack(m := m, r := region)) as b from dist where raw <= 800 group by id) select id, b.r as region, b.m as distance_m from near""")
def nearest_regions(spark: SparkSession, d: str) -> DataFrame:
    return R.nearest_region(V.parks(spark, d), V.region_edges(spark, d), 800)


@query(V.heads("parks", "edges") + f""", {INSIDE}, {SEGMENT}, near as (select id, min(struct_pack(m := m, r := region)) as b from dist where raw <= 2000 group by id)
select p.id, coalesce(i.region = p.city, false) or (i.region is null and coalesce(b.r = p.city, false)) as verified from parks p left join inside i using (id) left join near using (id)""")
def verified_regions(spark: SparkSession, d: str) -> DataFrame:
    return R.verify_region(V.parks(spark, d), V.region_edges(spark, d)).select("id", "verified")


@query(V.heads("parks") + """ select region, count(osm_id) as osm, count(id) as canonical from (select concat('R', cast(n_nationkey as varchar)) as region from nation) r left join parks on city = region group by region""")
def region_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = V.parks(spark, d).withColumn("source_refs", F.array().cast(f"array<{registry.REF}>"))
    regions = V.table(spark, d, "nation").select(F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("region"))
    return registry.region_coverage(p, regions).select("region", "osm", "canonical")


# --- registry ---------------------------------------------------------------------------------------------------------


def _next_version(p: DataFrame) -> DataFrame:
    """The registry a release later: some parks gone, new, renamed or moved."""
    kept = p.where("id % 19 <> 3")
    renamed = kept.withColumn("name", F.when(F.col("id") % 23 == 4, F.concat("name", F.lit(" 2"))).otherwise(F.col("name")))
    moved = renamed.withColumn("latitude", F.when(F.col("id") % 29 == 5, F.col("latitude") + 0.001).otherwise(F.col("latitude")))
    fresh = p.where("id % 31 = 6").withColumn("id", F.col("id") + 1_000_000_000).withColumn("osm_id", F.concat(F.lit("way/"), F.col("id").cast("string")))
    return moved.unionByName(fresh)


@query(V.heads("parks") + """, o as (select osm_id, id, 'unchanged' as s from parks) select osm_id, case when id % 19 = 3 then 'removed' else 'unchanged' end as state,
  id % 19 <> 3 and id % 23 = 4 as name_changed, id % 19 <> 3 and id % 29 = 5 as moved, id % 19 <> 3 as id_stable from parks
union all select concat('way/', cast(id + 1000000000 as varchar)), 'new', false, false, false from parks where id % 31 = 6""")
def catalog_diff(spark: SparkSession, d: str) -> DataFrame:
    p = V.parks(spark, d)
    return registry.diff_catalog(p, _next_version(p)).select("osm_id", "state", "name_changed", "moved", "id_stable")


@query(V.heads("parks") + """ select 'lost_park' as rule, cast(id as varchar) as id from parks where id % 19 = 3
union all select 'mutated', cast(id as varchar) from parks where id % 19 <> 3 and (id % 23 = 4 or id % 29 = 5)""")
def invariant_violations(spark: SparkSession, d: str) -> DataFrame:
    p = V.parks(spark, d).withColumn("source_refs", F.array().cast(f"array<{registry.REF}>"))
    return registry.check_invariants(p, _next_version(p))


@query(V.heads("parks") + """ select id, case when id % 19 = 3 or id % 6 = 0 then name when id % 23 = 4 then name || ' 2' else name end as name, id % 11 <> 0 as active, case when id % 6 = 0 then 'community' else 'source' end as name_status from parks
union all select id + 1000000000, name, true, 'source' from parks where id % 31 = 6""")
def upserted_parks(spark: SparkSession, d: str) -> DataFrame:
    now = V.parks(spark, d).select("id", "name", F.when(F.col("id") % 6 == 0, "community").otherwise("source").alias("name_status"), "active")
    incoming = _next_version(V.parks(spark, d)).select("id", "name", F.lit("source").alias("name_status"))
    return registry.upsert_parks(now, incoming)


@query(V.heads("parks", "source", "edges") + f""", p as (select a.id as sid, b.id as pid, {KEY('a.name')} as ka, {KEY('b.name')} as kb, {H('a', 'b')} as m from source a join parks b on {NEAR} where {H('a', 'b')} <= 300 and b.osm_id is not null),
t as (select *, min(m) over (partition by sid) as least from p), u as (select *, count(*) over (partition by sid) as n from t where least > 100 or m <= 100),
one as (select *, kb <> 'isimsizpark' and ka <> kb as conflict from u where n = 1), ask as (select *, count(*) over (partition by pid) as claims from one where not conflict)
select external_id, 'REVIEW' as outcome, 'multiple_osm_candidates' as reason from source where id in (select sid from u where n > 1)
union all select external_id, 'REVIEW', 'name_conflict_at_same_location' from source where id in (select sid from one where conflict)
union all select external_id, 'REVIEW', 'shared_osm_target_conflict' from source where id in (select sid from ask where claims > 1)
union all select external_id, 'MATCHED', null from source where id in (select sid from ask where claims = 1)
union all select external_id, 'NEW', null from source where id not in (select sid from u)""")
def ingested(spark: SparkSession, d: str) -> DataFrame:
    """One province around everything, so that all records pass to the matching rules."""
    box = [(0.0, 0.0, 20.0, 0.0), (20.0, 0.0, 20.0, 8.0), (20.0, 8.0, 0.0, 8.0), (0.0, 8.0, 0.0, 0.0)]
    e = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(b, ("ax", "ay", "bx", "by")))) for b in box)))
    province = V.table(spark, d, "nation").where("n_nationkey = 0").select(e.alias("e")).select(F.lit("P").alias("region"), *((F.lit(o) + F.col(f"e.{c}")).alias(n) for o, c, n in ((25.0, "ax", "x1"), (35.0, "ay", "y1"), (25.0, "bx", "x2"), (35.0, "by", "y2"))))
    parks = V.parks(spark, d).withColumn("city", F.lit("P")).withColumn("source_refs", F.array().cast(f"array<{registry.REF}>"))
    cfg = I.SourceConfig("src", "Source", "https://example.org/d", "ns", "P", tiers_m=(100, 300), extended_m=None)
    return I.ingest(V.source(spark, d), parks, province, cfg).select("external_id", "outcome", "reason")


@query()
def gap_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth place repeats the id before it, every fourteenth has no valid place, every eighth no name."""
    k = F.col("position")
    places = V.source(spark, d).withColumn("id", (k - F.when(k % 9 == 1, 1).otherwise(0)).cast("string"))
    places = places.withColumn("latitude", F.when(k % 14 != 3, F.col("latitude"))).withColumn("name", F.when(k % 8 == 0, "İsimsiz park").otherwise(F.col("name")))
    return I.gap_analysis(places, V.parks(spark, d).withColumn("id", F.col("id").cast("string")), V.region_edges(spark, d), [f"Brand#{k}" for k in range(1, 13)])


# --- serials and data quality -----------------------------------------------------------------------------------------


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = V.source(spark, d)
    return s.select(F.lit("p").alias("package_uuid"), F.concat(F.lit("r"), (F.col("id") % 4).cast("string")).alias("resource_uuid"), F.col("external_id").alias("serial"), "name", "latitude", "longitude", "id")


@query(V.heads("source") + """ select 'r' || cast(id % 4 as varchar) as resource_uuid, external_id as serial, case when id % 7 = 1 then 'REMOVED' when id % 7 = 2 then 'NORMAL_ATTRIBUTE_CHANGE' when id % 7 = 3 then 'SERIAL_REUSED' else 'UNCHANGED' end as status from source
union all select 'r' || cast(id % 4 as varchar), 'n' || external_id, 'ADDED' from source where id % 7 = 4""")
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Some serials go, are renamed, move by a degree, or appear far off; nothing lands where another serial was."""
    before = _snapshot(spark, d)
    after = before.where("id % 7 <> 1").withColumn("name", F.when(F.col("id") % 7 == 2, F.concat("name", F.lit(" X"))).otherwise(F.col("name"))).withColumn("latitude", F.when(F.col("id") % 7 == 3, F.col("latitude") + 1).otherwise(F.col("latitude")))
    fresh = before.where("id % 7 = 4").withColumn("serial", F.concat(F.lit("n"), "serial")).withColumn("latitude", F.col("latitude") + 2)
    return serials.compare_snapshots(before.drop("id"), after.unionByName(fresh).drop("id")).select("resource_uuid", "serial", "status")


@query(V.heads("source") + """ select count(*) as feature_count, count(*) filter (id % 10 <> 0) as joined_count, count(*) filter (id % 10 = 0) as missing, (select count(*) from source where id % 21 = 0) as orphans from source""")
def companion_share(spark: SparkSession, d: str) -> DataFrame:
    s = V.source(spark, d)
    other = s.where("id % 10 <> 0").select(F.col("external_id").alias("serial")).union(s.where("id % 21 = 0").select(F.concat(F.lit("x"), "external_id")))
    return serials.companion_coverage(s.select(F.col("external_id").alias("serial")), other).select("feature_count", "joined_count", "missing", "orphans")


@query("""select 'p_name' as field, count(p_name) as non_null, count(distinct p_name) as distinct_values from part union all select 'p_brand', count(p_brand), count(distinct p_brand) from part union all select 'p_partkey', count(p_partkey), count(distinct p_partkey) from part""")
def field_profile(spark: SparkSession, d: str) -> DataFrame:
    return T.profile_fields(V.table(spark, d, "part"), ["p_name", "p_brand", "p_partkey"]).select("field", "non_null", "distinct_values")


@query(V.heads("source") + """ select taxonomy as dataset_id, case when taxonomy = 'Brand#3' then 'BLOCKED_LICENSE' when taxonomy = 'Brand#4' then 'BLOCKED_IDENTITY' else 'READY_FOR_RECONCILIATION' end as status from source group by taxonomy""")
def dataset_states(spark: SparkSession, d: str) -> DataFrame:
    s = V.source(spark, d)
    features = s.select(F.col("taxonomy").alias("dataset_id"), F.when(F.col("taxonomy") == "Brand#4", F.lit(None)).otherwise(F.col("external_id")).alias("external_id"), "name", F.lit(None).cast("string").alias("taxonomy"), "latitude", "longitude")
    sets = s.select(F.col("taxonomy").alias("dataset_id")).distinct().withColumn("license_status", F.when(F.col("dataset_id") == "Brand#3", "UNCLEAR").otherwise("SAFE_OPEN")).withColumn("needs_parser", F.lit(False))
    return readiness.dataset_readiness(sets, features).select("dataset_id", "status")


@query(V.heads("parks") + """ select concat(cast(floor(longitude / 0.25) as int), '-', cast(floor(latitude / 0.25) as int)) as tile, count(*) as boundaries from parks group by 1""")
def tiles(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("longitude"), F.col("latitude")
    ring = F.array(*(F.array(x + a * 1e-4, y + b * 1e-4) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    return tile_list(tile_features(V.parks(spark, d).withColumn("polys", F.array(F.array(ring))))).select("tile", "boundaries")


@query()
def sampled_parks(spark: SparkSession, d: str) -> DataFrame:
    """A reproducible stratified draw in hash order; tested for its quotas."""
    return T.stratified_sample(V.parks(spark, d), "city", "id", 5, 150).select("id", "city")


from gridloom import queries_jobs  # noqa: E402, F401 (registers the queries of jobs and rules)
from gridloom import queries_shapes  # noqa: E402, F401 (registers the queries over polygons)
from gridloom import queries_review  # noqa: E402, F401 (registers the review of a backlog)
