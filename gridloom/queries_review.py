"""The review of a whole backlog: every record of a source against every park, with polygons, clusters and accepted mates.

The DuckDB text says the rules on its own, one step a table. Names are made of words that resemble no other, so that SQL can
tell their relation: equal names, equal cores, another number, one word shared, generic or placeholder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import views as V
from gridloom.functions.session import saved
from gridloom.plans import ingest as I
from gridloom.plans import review as B
from gridloom.plans.registry import REF
from gridloom.queries_shapes import WORDS
from gridloom.registered import NEAR, H, metres, query, tenths

REVIEW_SQL = V.heads("parks", "source") + f""",
placed as (
  select id, case when id % 5 < 2 and id // 10 % 3 = 0 then id // 10 * 10 else id end as g, case when id // 10 % 2 = 0 then id // 10 * 10 else id end as h from source),
rec as (
  select id, latitude, longitude, g * g % 31 % 7 as w, (case when id % 5 < 2 and id // 10 % 3 = 0 then h else id end) % 6 as variant,
    g % 8 = 0 or g % 17 = 0 as weak, case when id % 5 < 2 then 'c' || id // 10 else 's:' || id end as component,
    case when id % 2 = 0 or id <> g then null else id % 7 end as district, id % 7 <> 1 as trustworthy, id % 21 in (1, 8) as about, id % 9 = 0 as ambiguous,
    case id // 10 % 11 when 3 then 'NON_PARK' when 5 then 'TAXONOMY_AMBIGUOUS' else 'PARK_CONFIRMED' end as gate,
    case when id % 5 < 2 and ((id % 10 = 5 and id // 10 % 3 = 1) or (id % 10 in (5, 6) and id // 10 % 3 = 2)) then 'accepted'
      when id % 10 = 0 and id // 10 % 5 = 0 then 'other' else 'review' end as status
  from placed p join (select id as g, latitude, longitude from source) s using (g)),
named as (select *, case when variant in (4, 5) then (w + 3) % 7 end as x, not weak and variant = 3 as numbered, weak or variant <> 2 as park_word from rec),
sized as (select *, count(*) over (partition by component) as size, min(id) over (partition by component) as first_id from named),
pk as (select id, latitude, longitude, id % 5 = 3 as weak, id * id % 31 % 7 as w, id % 2 = 0 as has, id % 7 as district, id % 10 = 7 as same_source from parks),
pairs as (
  select a.id, b.id as park_id, {H('a', 'b')} as d, greatest(0e0, abs(a.longitude - b.longitude) - 6.1e-4) * 111320 * cos(radians(a.latitude)) as dx, greatest(0e0, abs(a.latitude - b.latitude) - 4.1e-4) * 110540 as dy
  from sized a join pk b on {NEAR} where {H('a', 'b')} <= 700),
eff as (select pairs.*, case when pk.has then sqrt(dx * dx + dy * dy) else d end as m, pk.has from pairs join pk on pk.id = park_id),
rel as (
  select e.id, e.park_id, e.m, case when not e.has then 'POINT_DISTANCE' when e.m = 0 then 'OVERLAP' when e.m <= 15 then 'ADJACENT' else 'GAP' end as relation,
    b.same_source, b.weak as park_weak, coalesce(a.district <> b.district, false) as conflict,
    not a.weak and not b.weak and not a.numbered and a.w = b.w and a.x is null as strong,
    not a.weak and not b.weak and a.numbered and a.w = b.w as other_number,
    not a.weak and not b.weak and a.x is not null and (a.w = b.w or a.x = b.w) as shares
  from eff e join sized a on a.id = e.id join pk b on b.id = e.park_id where e.m <= 250),
cand as (select *, not conflict and (relation in ('OVERLAP', 'ADJACENT') or m <= 100 or strong) as plausible, relation = 'OVERLAP' or m <= 30 as close from rel),
falls as (
  select pk.id as park_id, a.id, a.component from sized a join pk on abs(a.longitude - pk.longitude) <= 2e-3 and abs(a.latitude - pk.latitude) <= 2e-3
  where case when pk.has then abs(a.longitude - pk.longitude) < 6.1e-4 and abs(a.latitude - pk.latitude) < 4.1e-4 else {H('a', 'pk')} <= 30 end),
flags as (
  select a.id, count(*) filter (plausible) as plausible, count(*) filter (plausible and strong) as n_strong, count(*) filter (plausible and relation = 'OVERLAP') as n_over,
    count(*) filter (plausible and m <= 30) as n_very, count(*) filter (plausible and close) as n_close,
    count(*) filter (plausible and shares and close and not same_source) as n_part,
    coalesce(bool_or(strong and not conflict), false) as namesake, coalesce(bool_or(relation in ('OVERLAP', 'ADJACENT')), false) as touches, coalesce(bool_or(m <= 30), false) as very_close,
    coalesce(bool_or(plausible and other_number), false) as variant_near, coalesce(bool_or(plausible and shares), false) as shared,
    coalesce(bool_or(plausible and relation = 'POINT_DISTANCE' and park_weak and m <= 100), false) as unseparated, min(m) as nearest
  from sized a left join cand c on c.id = a.id group by a.id),
choice as (
  select a.id, f.*exclude (id), a.weak, a.ambiguous, c.park_id, c.same_source, c.park_weak,
    exists (select 1 from falls r where r.park_id = c.park_id and r.component <> a.component) as contested,
    case when f.n_strong = 1 then c.strong when f.n_strong > 1 then false
      when a.weak then case when f.n_over = 1 then c.relation = 'OVERLAP' when f.n_over = 0 and f.n_very = 1 and f.plausible = 1 then c.m <= 30 else false end
      when f.n_part = 1 and f.n_close = 1 and not a.ambiguous then c.shares and c.close and not c.same_source
      else f.n_close = 1 and c.close end as it
  from sized a join flags f on f.id = a.id join cand c on c.id = a.id and c.plausible),
target as (
  select id, park_id, n_strong = 1 as by_name, case when n_strong = 1 then 'NAME_DRIVEN' when weak then 'SPATIAL_DRIVEN' when n_part = 1 and n_close = 1 and not ambiguous then 'NAME_PARTIAL_SPATIAL' else 'NAME_UPGRADE_SPATIAL' end as mode
  from choice
  where it and case when n_strong = 1 then not same_source when weak then not ambiguous and not contested when n_part = 1 and n_close = 1 and not ambiguous then true
    else park_weak and not ambiguous and not contested end),
back as (
  select a.*, t.park_id as target, t.mode, coalesce(t.by_name, false) as by_name, f.nearest,
    concat_ws(',', case when not a.trustworthy then 'no_park_evidence' end, case when a.gate <> 'PARK_CONFIRMED' then 'taxonomy_gate' end, case when a.weak then 'generic_name' end,
      case when namesake then 'namesake_nearby' end, case when touches then 'geometry_touches_park' end, case when very_close then 'very_close_park' end, case when variant_near then 'numeric_variant' end,
      case when a.ambiguous then 'ambiguous_neighbour' end, case when shared then 'shared_token' end, case when unseparated then 'unseparated_generic' end) as unsafe, unsafe = '' as safe
  from sized a join flags f on f.id = a.id left join target t on t.id = a.id where a.status = 'review'),
mates as (select component, count(distinct id) as parks, min(cast(id as varchar)) as park from sized where status = 'accepted' group by component),
mated as (
  select b.*, coalesce(parks, 0) as parks, mates.park, count(*) over c as members, count(target) over c as with_target, min(target) over c = max(target) over c as same, bool_and(safe) over c as all_safe
  from back b left join mates on mates.component = b.component window c as (partition by b.component)),
said as (
  select *, case
    when gate = 'NON_PARK' and not park_word then 'REJECT_NON_PARK/taxonomy_gate'
    when gate = 'TAXONOMY_AMBIGUOUS' and not by_name then 'KEEP_REVIEW/taxonomy_gate'
    when not trustworthy and not by_name then case when about and not park_word then 'REJECT_NON_PARK/source_text' else 'KEEP_REVIEW/no_park_evidence' end
    when size < 2 then case when target is not null then 'MATCH_EXISTING/target' when safe then 'NEW_CANONICAL_SAFE/safe' else 'KEEP_REVIEW/not_safe' end
    when id // 10 % 8 = 0 and not by_name then 'KEEP_REVIEW/ambiguous_cluster'
    when parks > 1 then 'KEEP_REVIEW/mates_on_several_parks'
    when parks = 1 then case when cast(target as varchar) <> park then 'KEEP_REVIEW/target_conflicts_with_mate' else 'REJECT_DUPLICATE/mate_is_accepted' end
    when with_target = members and same then case when id = first_id then 'MATCH_EXISTING/representative' else 'REJECT_DUPLICATE/representative_matches' end
    when with_target = 0 and all_safe then case when id = first_id then 'NEW_CANONICAL_SAFE/representative' else 'REJECT_DUPLICATE/representative_is_new' end
    else 'KEEP_REVIEW/members_disagree' end as said
  from mated)
"""


def _word(k: Column) -> Column:
    return F.get(F.array(*map(F.lit, WORDS)), k.cast("int"))


def review_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of one source, parks and clusters, by the formulas of ``REVIEW_SQL``."""
    k = F.col("id")
    group, clustered = F.expr("id div 10"), k % 5 < 2
    moved = clustered & (group % 3 == 0)
    s = V.source(spark, d)
    rows = s.select("id", F.when(moved, group * 10).otherwise(k).alias("g"), F.when(group % 2 == 0, group * 10).otherwise(k).alias("h"))
    rows = rows.join(s.select(F.col("id").alias("g"), "latitude", "longitude"), "g")
    g, variant = F.col("g"), F.when(moved, F.col("h")).otherwise(k) % 6
    word = g * g % 31 % 7
    ending = F.when(variant == 1, " Çocuk Parkı").when(variant == 2, " Bahçesi").when(variant == 3, " 2 Parkı").when(variant > 3, F.concat(F.lit(" "), _word((word + 3) % 7), F.lit(" Parkı"))).otherwise(" Parkı")
    name = F.when(g % 8 == 0, "İsimsiz park").when(g % 17 == 0, "Park 3").otherwise(F.concat(_word(word), ending))
    accepted = clustered & (((k % 10 == 5) & (group % 3 == 1)) | (k % 10).isin(5, 6) & (group % 3 == 2))
    gate = F.when(group % 11 == 3, "NON_PARK").when(group % 11 == 5, "TAXONOMY_AMBIGUOUS").otherwise("PARK_CONFIRMED")
    records = rows.select(
        F.concat(F.lit("s:"), k.cast("string")).alias("key"), F.lit("s").alias("source_code"), k.cast("string").alias("external_id"), name.alias("name"), F.lit("P").alias("city"),
        F.when((k % 2 == 0) | (k != g), "").otherwise(F.concat(F.lit("D"), (k % 7).cast("string"))).alias("district"), "latitude", "longitude", F.lit(100.0).alias("tier2_m"), k.alias("order_id"),
        (k % 7 != 1).alias("trustworthy"), F.when((k % 21).isin(1, 8), "otopark").otherwise("").alias("texts"), gate.alias("taxonomy_class"), F.lit(None).cast("array<array<array<array<double>>>>").alias("polys"),
        F.when(accepted, "accepted").when((k % 10 == 0) & (group % 5 == 0), "other").otherwise("review").alias("status"), F.when(accepted, k.cast("string")).alias("canonical_id"),
        F.when(clustered, F.concat(F.lit("c"), group.cast("string"))).otherwise(F.concat(F.lit("s:"), k.cast("string"))).alias("component"), (k % 9 == 0).alias("ambiguous"),
    )
    records = saved(records, "review-source")
    west, south = F.col("longitude") - 6.1e-4, F.col("latitude") - 4.1e-4
    ring = F.array(*(F.array(west + x, south + y) for x, y in ((0.0, 0.0), (1.22e-3, 0.0), (1.22e-3, 8.2e-4), (0.0, 8.2e-4), (0.0, 0.0))))
    refs = F.when(k % 10 == 7, F.array(F.struct(F.lit("s").alias("source_code"), F.lit("x").alias("external_id"), F.lit(None).cast("string").alias("source_url")))).otherwise(F.array()).cast(f"array<{REF}>")
    parks = V.parks(spark, d).select(
        k.cast("string").alias("id"), F.when(k % 5 == 3, "İsimsiz park").otherwise(F.concat(_word(k * k % 31 % 7), F.lit(" Parkı"))).alias("name"), F.lit("P").alias("city"),
        F.concat(F.lit("D"), (k % 7).cast("string")).alias("district"), "latitude", "longitude", F.when(k % 2 == 0, F.array(F.array(ring))).alias("polys"), refs.alias("source_refs"),
    )
    sizes = records.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("order_id").alias("first_id"))
    clusters = records.select("key", "component", "order_id", "ambiguous").join(sizes, "component")
    clusters = clusters.withColumn("ambiguous_cluster", (F.col("size") > 1) & (F.expr("order_id div 80 * 8 = order_id div 10"))).drop("order_id")
    return records, parks, clusters


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(all records, parks, clusters, the backlog, its candidates)."""
    records, parks, clusters = review_tables(spark, d)
    backlog = B.parsed_records(records.where("status = 'review'").drop("component", "ambiguous", "status", "canonical_id"))
    return records, parks, clusters, backlog, B.review_candidates(backlog, parks)


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(all records, parks, clusters, evidence of the backlog, its candidates)."""
    records, parks, clusters, backlog, candidates = _candidates(spark, d)
    return records, parks, clusters, B.new_safe(B.review_evidence(backlog, candidates, clusters)), candidates


def _targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all records, evidence of the backlog, its targets)."""
    records, parks, clusters, evidence, candidates = _evidence(spark, d)
    return records, evidence, B.record_targets(evidence, candidates, B.park_rivals(records, parks, clusters))


@query(REVIEW_SQL + f"""select 's:' || rel.id as key, cast(park_id as varchar) as park_id, relation, {tenths('m')} as dm, strong, shares as shares_token, other_number, plausible
from cand rel join back on back.id = rel.id""")
def review_distances(spark: SparkSession, d: str) -> DataFrame:
    """Records and parks with the distance between point and polygon where the park has one."""
    c = _candidates(spark, d)[4]
    return c.select("key", "park_id", "relation", metres("distance_m").alias("dm"), "strong", F.col("rel.shares_distinctive_token").alias("shares_token"), F.col("rel.numeric_conflict").alias("other_number"), "plausible")


@query(REVIEW_SQL + "select 's:' || id as key, cast(target as varchar) as target_id, mode from back")
def review_targets(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d)[2].select("key", "target_id", "mode")


@query(REVIEW_SQL + "select 's:' || id as key, unsafe from back")
def review_safety(spark: SparkSession, d: str) -> DataFrame:
    """Why a record may not become a new park, in the order of the rules."""
    return _evidence(spark, d)[3].select("key", F.array_join("unsafe", ",").alias("unsafe"))


@query(REVIEW_SQL + """select split_part(said, '/', 1) as outcome, count(*) as n, cast(floor(floor(avg(nearest) * 10 + 0.5) / 10 + 0.5) as bigint) as nearest from said group by 1""")
def review_report(spark: SparkSession, d: str) -> DataFrame:
    records, evidence, targets = _targets(spark, d)
    targets = saved(targets, "review-targets")
    told = B.decision_report(B.resolve_reviews(evidence, targets, B.accepted_mates(records)), evidence)
    return told.select("outcome", "n", F.floor(F.col("nearest_m") + 0.5).cast("bigint").alias("nearest"))


@query(REVIEW_SQL + """select 's:' || id as key, split_part(said, '/', 1) as outcome, split_part(said, '/', 2) as reason,
  case when said like 'MATCH%' or said like '%DUPLICATE%' then case when size > 1 and parks = 1 then park else cast(target as varchar) end end as target_id, case when size > 1 then first_id end as representative from said""")
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    records, evidence, targets = _targets(spark, d)
    targets = saved(targets, "review-targets")
    return B.resolve_reviews(evidence, targets, B.accepted_mates(records))


# Features of one source with every fault: ids that are missing or come again, no geometry, places outside the country and
# outside the province, another taxonomy. Names of parks and features are words that resemble no other.
INGEST_SQL = V.heads("parks", "source") + f""",
fe as (
  select position, case when id % 23 = 3 then null when id % 29 = 5 then cast(id - 1 as varchar) else cast(id as varchar) end as eid,
    case when id % 31 = 7 then null when id % 37 = 8 then 5e0 when id % 41 = 9 then 42.5e0 else latitude end as latitude, longitude, taxonomy = 'Brand#11' as shop,
    case when id % 5 = 0 then 'İsimsiz park' when id % 3 = 1 then 'Bülbül Parkı' else ({WORDS!r})[id * id % 31 % 7 + 1] || ' Parkı' end as name from source),
marked as (
  select *, case when eid is null then 'missing_id' when coalesce(bool_or(latitude is not null) over (partition by eid order by position rows between unbounded preceding and 1 preceding), false) then 'duplicate_id'
    when latitude is null then 'invalid_geometry' end as reject from fe),
good as (select * from marked where reject is null and not shop and latitude between 35 and 42),
pk as (select id, latitude, longitude, case when id % 7 = 2 then 'İsimsiz park' else ({WORDS!r})[(id * id % 31 + case when id % 10 = 4 then 1 else 0 end) % 7 + 1] || ' Parkı' end as name from parks),
pairs as (select a.eid, b.id as pid, a.name, b.name as park, {H('a', 'b')} as m from good a join pk b on {NEAR} where {H('a', 'b')} <= 310),
tier as (select *, count(*) over (partition by eid) as n from (select *, min(m) over (partition by eid) as least from pairs where m <= 300) where least > 100 or m <= 100),
single as (select *, name <> 'İsimsiz park' and park <> 'İsimsiz park' and name <> park as conflict from tier where n = 1),
ask as (select *, count(*) over (partition by pid) as claims from single where not conflict),
far as (select eid, arg_min(pid, struct_pack(m := m, p := cast(pid as varchar))) as pid from pairs where eid not in (select eid from tier) and name <> 'İsimsiz park' and name = park group by eid),
rest as (select * from good where eid not in (select eid from tier) and eid not in (select eid from far)),
twin as (select a.eid, count(*) as others from rest a join rest b on a.eid <> b.eid and a.name = b.name and {NEAR} where a.name <> 'İsimsiz park' and {H('a', 'b')} <= 800 group by a.eid)
select eid as external_id, 'INVALID' as outcome, reject as reason, null as target_id, cast(null as bigint) as others from marked where reject is not null
union all select eid, 'REJECTED_NON_PARK', 'taxonomy', null, null from marked where reject is null and shop
union all select eid, 'INVALID', 'invalid_coordinate', null, null from marked where reject is null and not shop and latitude < 35
union all select eid, 'PROVINCE_MISMATCH', null, null, null from marked where reject is null and not shop and latitude > 42
union all select distinct eid, 'REVIEW', 'multiple_osm_candidates', null, null from tier where n > 1
union all select eid, 'REVIEW', 'name_conflict_at_same_location', cast(pid as varchar), null from single where conflict
union all select eid, 'REVIEW', 'shared_osm_target_conflict', cast(pid as varchar), claims - 1 from ask where claims > 1
union all select eid, 'MATCHED', null, cast(pid as varchar), null from ask where claims = 1
union all select eid, 'REVIEW', 'possible_match_outside_primary_radius', cast(pid as varchar), null from far
union all select eid, 'REVIEW', 'possible_duplicate_within_source', null, others from twin
union all select eid, 'NEW', null, null, null from rest where eid not in (select eid from twin)"""


@query(INGEST_SQL)
def ingested_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Ingestion with both guards on, every outcome and reason."""
    k, lat = F.col("id"), F.col("latitude")
    eid = F.when(k % 23 == 3, None).when(k % 29 == 5, (k - 1).cast("string")).otherwise(k.cast("string"))
    place = F.when(k % 31 == 7, None).when(k % 37 == 8, 5.0).when(k % 41 == 9, 42.5).otherwise(lat)
    name = F.when(k % 5 == 0, "İsimsiz park").when(k % 3 == 1, "Bülbül Parkı").otherwise(F.concat(_word(k * k % 31 % 7), F.lit(" Parkı")))
    features = V.source(spark, d).select(eid.alias("external_id"), name.alias("name"), F.when(F.col("taxonomy") == "Brand#11", "shop").otherwise("park").alias("taxonomy"), place.alias("latitude"), "longitude", "position")
    called = F.when(k % 7 == 2, "İsimsiz park").otherwise(F.concat(_word((k * k % 31 + F.when(k % 10 == 4, 1).otherwise(0)) % 7), F.lit(" Parkı")))
    parks = V.parks(spark, d).select(k.cast("string").alias("id"), "osm_id", called.alias("name"), F.lit("P").alias("city"), "district", "latitude", "longitude", F.array().cast(f"array<{REF}>").alias("source_refs"))
    corners = [(25.0, 36.0), (45.0, 36.0), (45.0, 42.0), (25.0, 42.0), (25.0, 36.0)]
    province = spark.createDataFrame([("P", *a, *b) for a, b in zip(corners, corners[1:])], "region string, x1 double, y1 double, x2 double, y2 double")
    cfg = I.SourceConfig("src", "Source", "https://example.org/d", "ns", "P", allowed_taxonomy=("park",), tiers_m=(100, 300), extended_m=310, duplicate_guard_m=800)
    return I.ingest(features, parks, province, cfg)
