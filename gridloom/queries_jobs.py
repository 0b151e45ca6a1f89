"""Registered queries of jobs, rules and small operators, each with the DuckDB text that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import views as V
from gridloom.functions import geo, names, rules, text
from gridloom.functions.session import saved
from gridloom.operators import activity as A
from gridloom.operators import polygons as P
from gridloom.operators import regions as R
from gridloom.operators import spatial as S
from gridloom.operators import tables as T
from gridloom.plans import consolidate as C
from gridloom.plans import readiness as Y
from gridloom.plans import registry as G
from gridloom.plans import release as L
from gridloom.plans import review as B
from gridloom.plans import serials as Z
from gridloom.registered import KEY, NEAR, ORACLE_SQL, H, metres, query, tenths
from gridloom.sources import readers, sinks
from gridloom.views import plain_sql

AT = "2024-01-30 12:00:00"
def no_refs() -> Column:
    return F.array().cast(f"array<{G.REF}>")



def s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def tag(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), s(c))


def ref(code, external) -> Column:
    return F.struct(code.alias("source_code"), external.alias("external_id"), F.lit(None).cast("string").alias("source_url"))


def pick(values: list[str], c: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), c.cast("int"))


def texts(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- activity ---------------------------------------------------------------------------------------------------------


@query(V.heads("feedings") + " select id, user_id, case when user_id % 3 <> 0 then 'U' || user_id else 'Hayvansever' end as display_name from feedings")
def named_feedings(spark: SparkSession, d: str) -> DataFrame:
    f = V.feedings(spark, d).select("id", "user_id")
    profiles = f.where("user_id % 3 <> 0").select("user_id", tag("U", "user_id").alias("display_name")).distinct()
    return A.with_names(f, profiles)


@query(V.heads("feedings") + " select id from feedings where user_id % 5 <> 2")
def unblocked_feedings(spark: SparkSession, d: str) -> DataFrame:
    f = V.feedings(spark, d)
    blocked = f.where("user_id % 5 = 2").select(F.lit(7).alias("user_id"), F.col("user_id").alias("blocked_id")).distinct()
    return A.hide_blocked(f, blocked, 7).select("id")


@query(V.heads("parks", "feedings") + " select f.id from feedings f join parks p on p.id = f.park_id where f.status = 'published' and p.active")
def visible_feedings(spark: SparkSession, d: str) -> DataFrame:
    return A.visible_events(V.feedings(spark, d), V.parks(spark, d)).select("id")


STATES = A.CASE_STATES


def _cases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    volunteer = F.when((k % 7 >= 2) & (k % 3 != 0), tag("v", k % 10))
    hidden = F.when(k % 13 == 5, F.lit(AT).cast("timestamp"))
    return V.parks(spark, d).select(tag("c", k).alias("id"), "latitude", "longitude", pick(STATES, k % 7).alias("status"), volunteer.alias("assigned_volunteer_id"), F.lit(None).cast("string").alias("assigned_vet_id"), hidden.alias("hidden_at"))


CASES = f"""cases as (select 'c' || id as id, latitude, longitude, ({texts(STATES)})[id % 7 + 1] as status, case when id % 7 >= 2 and id % 3 <> 0 then 'v' || id % 10 end as volunteer,
  cast(null as varchar) as vet, id % 13 = 5 as hidden from parks)"""


@query(V.heads("parks") + f", {CASES} select id from cases where not hidden and status <> 'resolved'")
def visible_cases(spark: SparkSession, d: str) -> DataFrame:
    return A.visible_cases(_cases(spark, d)).select("id")


@query(V.heads("parks", "feedings", recursive=True) + f""", {CASES},
log as (select 'c' || park_id as case_id, row_number() over (partition by park_id order by occurred_at, id) as n, case when id % 4 = 0 then 'claim' else 'advance' end as kind, 'v' || id % 10 as actor,
  id % 9 = 0 as moderator, ({texts(STATES[3:])})[id // 4 % 4 + 1] as target, ({texts(STATES[2:-1])})[id // 4 % 4 + 1] as before, case when id % 5 = 1 then id % 8 end as vet_id from feedings),
st(id, n, status, volunteer, vet, hidden, refused) as (select id, cast(0 as bigint), status, volunteer, vet, hidden, cast(0 as bigint) from cases union all
  select id, n, case when c and status in ('reported', 'verifying') then 'claimed' when a then target else status end, case when c then actor else volunteer end,
    case when a and vet_id is not null then 'x' || vet_id else vet end, hidden, refused + case when c or a or r then 0 else 1 end
  from (select st.id, l.n, st.status, st.volunteer, st.vet, st.hidden, st.refused, l.target, l.actor, l.vet_id,
      not hidden and kind = 'claim' and volunteer is null and status <> 'resolved' as c,
      not hidden and kind = 'advance' and (vet_id is null or target = 'at_vet') and (moderator or coalesce(volunteer = actor, false)) and status = before and (vet_id is null or vet_id % 2 = 0) as a,
      not hidden and ((kind = 'claim' and coalesce(volunteer = actor, false) and status in ('claimed', 'en_route', 'at_vet', 'treating'))
        or (kind = 'advance' and (vet_id is null or target = 'at_vet') and (moderator or coalesce(volunteer = actor, false)) and status = target)) as r
    from st join log l on l.case_id = st.id and l.n = st.n + 1) x)
select id, arg_max(status, n) as status, arg_max(struct_pack(v := volunteer), n).v as assigned_volunteer_id, arg_max(struct_pack(v := vet), n).v as assigned_vet_id, max(refused) as refused from st group by id""")
def folded_cases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    log = V.feedings(spark, d).select(
        tag("c", "park_id").alias("case_id"), F.col("occurred_at").alias("at"), k.alias("seq"), F.when(k % 4 == 0, "claim").otherwise("advance").alias("kind"), tag("v", k % 10).alias("actor"),
        (k % 9 == 0).alias("moderator"), pick(STATES[3:], F.expr("id div 4 % 4")).alias("target"), F.when(k % 5 == 1, tag("x", k % 8)).alias("vet_id"),
    )
    vets = log.where("vet_id is not null").select(F.col("vet_id").alias("id")).distinct().withColumn("active", F.substring("id", 2, 1).cast("int") % 2 == 0)
    return A.fold_cases(_cases(spark, d), log, vets)


def _suggestions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("id")
    parks = V.parks(spark, d).select(tag("p", "id").alias("id"), "name", F.lit("source").alias("name_status"), F.lit("").alias("name_source"), F.lit("").alias("name_source_url"), "active")
    rows = V.feedings(spark, d).join(parks.select(F.col("id").alias("_p"), F.col("name").alias("_name")), F.col("_p") == tag("p", "park_id"))
    made = rows.select(
        tag("s", k).alias("id"), tag("p", "park_id").alias("park_id"), tag("u", F.col("user_id") % 10).alias("user_id"), F.when(k % 3 == 0, "x").otherwise(F.col("_name")).alias("original_name"),
        tag("N", k).alias("proposed_name"), F.when(k % 10 == 0, "rejected").otherwise("pending").alias("status"), F.lit("").alias("review_note"), F.lit(None).cast("string").alias("reviewed_by"),
        F.lit(None).cast("timestamp").alias("reviewed_at"), F.col("occurred_at").alias("created_at"),
    )
    said = rows.where("id % 2 = 0").select(tag("s", k).alias("id"), F.col("occurred_at").alias("at"), (k % 4 == 0).alias("accept"), F.when(k % 14 == 0, "short").otherwise(" seen on site ").alias("note"), tag("u", k % 10).alias("reviewer_id"))
    return made, parks, said


DECIDED = """sug as (select f.*, p.name as park_name, p.active, case when f.id % 3 = 0 then 'x' else p.name end as original_name from feedings f join parks p on p.id = f.park_id),
o as (select id, park_id, occurred_at, case when id % 14 = 0 then 'note' when not active then 'park' when id % 10 = 0 then 'reviewed' when user_id % 10 = id % 10 then 'own'
  when id % 4 <> 0 then 'rejected' when original_name <> park_name then 'renamed' else 'ask' end as o from sug where id % 2 = 0),
decided as (select id, park_id, occurred_at, case when o <> 'ask' then o when row_number() over (partition by park_id, o order by occurred_at, 's' || id) = 1 then 'approved' else 'renamed' end as outcome from o)"""


@query(V.heads("parks", "feedings") + f", {DECIDED} select 's' || id as id, outcome from decided")
def name_decisions(spark: SparkSession, d: str) -> DataFrame:
    return A.name_decisions(*_suggestions(spark, d)).select("id", "outcome")


@query(V.heads("parks", "feedings") + f""", {DECIDED} select 'p' || p.id as id, coalesce('N' || a.id, p.name) as name, case when a.id is null then 'source' else 'community' end as name_status,
  case when a.id is null then '' else 'Topluluk incelemesi' end as name_source, (select count(*) from decided x where x.park_id = p.id and outcome = 'rejected') as rejected
  from parks p left join decided a on a.park_id = p.id and a.outcome = 'approved'""")
def reviewed_names(spark: SparkSession, d: str) -> DataFrame:
    made, parks, said = _suggestions(spark, d)
    told, renamed = A.apply_name_reviews(made, parks, saved(A.name_decisions(made, parks, said), "name-decisions"))
    n = told.where("reviewed_by is not null and status = 'rejected'").groupBy(F.col("park_id").alias("id")).agg(F.count(F.lit(1)).alias("rejected"))
    return renamed.join(n, "id", "left").select("id", "name", "name_status", "name_source", F.coalesce("rejected", F.lit(0)).alias("rejected"))


@query(V.heads("parks", "feedings") + """ select 's' || f.id as id, p.name as park_name, case when f.id % 10 = 0 then 'rejected' else 'pending' end as status from feedings f join parks p on p.id = f.park_id
  where p.active order by f.id % 10 = 0, f.occurred_at desc, 's' || f.id desc limit 100""")
def suggestions_waiting(spark: SparkSession, d: str) -> DataFrame:
    made, parks, _ = _suggestions(spark, d)
    return A.suggestion_queue(made, parks).select("id", "park_name", "status")


REPORTS = """dec as (select * from feedings where id % 3 = 0),
rep as (select id, case id % 3 when 0 then id - id % 5 end as target, case when id % 4 = 0 then 'resolved' else 'open' end as status from feedings),
res as (select rep.id, rep.target, rep.status as was, dec.id is not null as decided, dec.id % 2 = 0 as hides, dec.occurred_at as "at", dec.user_id as by_user from rep left join dec using (id)),
hid as (select target, min(struct_pack(t := "at", u := by_user)) as h from res where was = 'open' and decided and hides group by target)"""


def _reports(spark: SparkSession, d: str, target: Column) -> tuple[DataFrame, DataFrame]:
    """A report a feeding event, every fourth resolved before; every third is decided on, every sixth by hiding."""
    f, k, none = V.feedings(spark, d), F.col("id"), F.lit(None)
    made = f.select("id", target.alias("target"), F.when(k % 4 == 0, "resolved").otherwise("open").alias("status"), none.cast("timestamp").alias("resolved_at"), none.cast("string").alias("resolution_action"), none.cast("bigint").alias("resolved_by"))
    said = f.where("id % 3 = 0").select(k.alias("report_id"), F.when(k % 2 == 0, "hide").otherwise("dismiss").alias("action"), F.col("occurred_at").alias("decided_at"), F.col("user_id").alias("decided_by"))
    return made, said


def _moderated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("id")
    reports, said = _reports(spark, d, F.when(k % 3 == 0, k - k % 5))
    return A.apply_decisions(V.feedings(spark, d), reports.withColumnRenamed("target", "feeding_id"), said, "feeding_id")


@query(V.heads("feedings") + f", {REPORTS} select id, case when target is not null then 'hidden' else status end as status from feedings left join hid on target = id")
def moderated_feedings(spark: SparkSession, d: str) -> DataFrame:
    return _moderated(spark, d)[0].select("id", "status")


@query(V.heads("feedings") + f""", {REPORTS} select id, case when decided then 'resolved' else was end as status, case when was = 'open' and decided then case when hides then 'hide' else 'dismiss' end end as action,
  case when was = 'open' and decided then "at" end as resolved_at, case when was = 'open' and decided then by_user end as resolved_by from res""")
def resolved_reports(spark: SparkSession, d: str) -> DataFrame:
    return _moderated(spark, d)[1].select("id", "status", F.col("resolution_action").alias("action"), "resolved_at", "resolved_by")


@query(V.heads("feedings") + f", {REPORTS} select id, occurred_at from feedings where status = 'published' and id not in (select target from hid where target is not null) order by occurred_at desc, id desc limit 30")
def moderated_page(spark: SparkSession, d: str) -> DataFrame:
    """The newest page of the feed once hidden feedings are gone from it."""
    return A.feed_page(_moderated(spark, d)[0]).select("id", "occurred_at")


@query(V.heads("parks", "feedings") + f""", {REPORTS}, ph as (select distinct id - id % 5 as park from res where was = 'open' and decided and hides)
select id, active and id not in (select park from ph) as active from parks""")
def moderated_parks(spark: SparkSession, d: str) -> DataFrame:
    reports, said = _reports(spark, d, F.col("id") - F.col("id") % 5)
    return A.apply_decisions(V.parks(spark, d), reports.withColumnRenamed("target", "park_id"), said, "park_id")[0].select("id", "active")


@query(V.heads("parks", "feedings") + f""", {REPORTS}, {CASES}, ph as (select 'c' || (id - id % 5) as id, min(struct_pack(t := "at", u := by_user)) as h from res where was = 'open' and decided and hides group by 1)
select cases.id, status, case when hidden then cast('{AT}' as timestamp) else h.t end as hidden_at, case when not hidden then h.u end as hidden_by from cases left join ph using (id)""")
def moderated_cases(spark: SparkSession, d: str) -> DataFrame:
    """Every thirteenth case was hidden before, by nobody known."""
    reports, said = _reports(spark, d, tag("c", F.col("id") - F.col("id") % 5))
    cases = _cases(spark, d).withColumn("hidden_by", F.lit(None).cast("bigint"))
    return A.apply_decisions(cases, reports.withColumnRenamed("target", "rescue_case_id"), said, "rescue_case_id")[0].select("id", "status", "hidden_at", "hidden_by")


ALIASES = "aliases as (select id as retired_id, id - 1 as survivor_id from parks where id % 13 = 1 and id % 17 <> 2), tombs as (select id as retired_id from parks where id % 17 = 2)"


def _lifecycle(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    aliases = p.where("id % 13 = 1 and id % 17 <> 2").select(F.col("id").alias("retired_id"), (F.col("id") - 1).alias("survivor_id"))
    return aliases, p.where("id % 17 = 2").select(F.col("id").alias("retired_id"), F.lit("non_park").alias("kind"))


def _points(p: DataFrame) -> DataFrame:
    gates = p.where("id % 2 = 0").select(tag("g", "id").alias("id"), F.col("id").alias("park_id"), F.lit("Kapı").alias("name"))
    return p.select(s("id").alias("id"), F.col("id").alias("park_id"), F.lit("Genel").alias("name")).union(gates)


POINTS = "points as (select cast(id as varchar) as id, id as park_id, 'Genel' as name from parks union all select 'g' || id, id, 'Kapı' from parks where id % 2 = 0)"


@query(V.heads("parks") + f""", {ALIASES}, {POINTS} select p.id, coalesce(a.survivor_id, p.park_id) as park_id, name from points p left join aliases a on a.retired_id = p.park_id
  where a.retired_id is null or name <> 'Genel'""")
def rekeyed_points(spark: SparkSession, d: str) -> DataFrame:
    return _rekeyed(spark, d)[0]


@query(V.heads("parks", "observations") + f""", {ALIASES} select o.id, case when o.id % 2 = 0 and park_id % 2 = 0 then 'g' || park_id else cast(coalesce(a.survivor_id, park_id) as varchar) end as point_id
  from observations o left join aliases a on a.retired_id = o.park_id""")
def rekeyed_observations(spark: SparkSession, d: str) -> DataFrame:
    return _rekeyed(spark, d)[2].select("id", "point_id")


def _rekeyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, feedings and observations after rekeying; every other row of an even park is of its second point."""
    p = V.parks(spark, d)
    point = F.when(F.expr("id % 2 = 0 and park_id % 2 = 0"), tag("g", "park_id")).otherwise(s("park_id")).alias("point_id")
    return A.rekey_activity(_points(p), V.feedings(spark, d).select("id", point, "park_id"), V.observations(spark, d).select("id", point), _lifecycle(p)[0])


@query(V.heads("parks", "feedings") + f""", {ALIASES} select f.id, coalesce(a.survivor_id, f.park_id) as park_id, case when f.id % 2 = 0 and f.park_id % 2 = 0 then 'g' || f.park_id else cast(coalesce(a.survivor_id, f.park_id) as varchar) end as point_id
  from feedings f left join aliases a on a.retired_id = f.park_id""")
def rekeyed_feedings(spark: SparkSession, d: str) -> DataFrame:
    return _rekeyed(spark, d)[1]


@query(V.heads("parks", "feedings") + f""", {ALIASES} select f.id, coalesce(a.survivor_id, f.park_id) as park_id, case when f.id % 2 = 1 then -1 else coalesce(a.survivor_id, f.park_id) end as point_id,
  case when a.retired_id is not null then 'rekeyed' when t.retired_id is null and p.active then 'send' else 'blocked' end as action
  from feedings f left join aliases a on a.retired_id = f.park_id left join tombs t on t.retired_id = f.park_id left join parks p on p.id = f.park_id""")
def prepared_queue(spark: SparkSession, d: str) -> DataFrame:
    p, f = V.parks(spark, d), V.feedings(spark, d)
    items = f.select("id", "park_id", F.when(F.col("id") % 2 == 0, F.col("park_id")).otherwise(F.lit(-1)).alias("point_id"))
    return A.prepare_queue(items, A.resolve_ids(f.select(F.col("park_id").alias("id")), p, *_lifecycle(p))).select("id", "park_id", "point_id", "action")


@query(V.heads("parks", "feedings") + f""", {ALIASES}, fav as (select user_id, park_id, min(occurred_at) as created_at from feedings group by 1, 2)
select user_id, coalesce(a.survivor_id, f.park_id) as park_id, min(created_at) as created_at, min(case when a.survivor_id is not null or (t.retired_id is null and p.active) then 'live' else 'retired' end) as status
  from fav f left join aliases a on a.retired_id = f.park_id left join tombs t on t.retired_id = f.park_id left join parks p on p.id = f.park_id group by 1, 2""")
def favorites_shown(spark: SparkSession, d: str) -> DataFrame:
    p, f = V.parks(spark, d), V.feedings(spark, d)
    fav = f.groupBy("user_id", "park_id").agg(F.min("occurred_at").alias("created_at"))
    return A.favorite_view(fav, A.resolve_ids(f.select(F.col("park_id").alias("id")), p, *_lifecycle(p)))


@query(V.heads("feedings", "observations") + """, u as (select distinct user_id from feedings union select distinct user_id + 1000000 from feedings),
l as (select user_id, 10 as points from feedings where status = 'published' union all select user_id, 2 from observations)
select u.user_id, cast(coalesce(sum(points), 0) as bigint) as points from u left join l on l.user_id = u.user_id group by 1""")
def points_of_users(spark: SparkSession, d: str) -> DataFrame:
    f = V.feedings(spark, d)
    users = f.select("user_id").union(f.select(F.col("user_id") + 1_000_000)).distinct()
    ledger = A.points_active(A.post_points(f, V.observations(spark, d)), f)
    return A.points_of(ledger, users)


@query(V.heads("parks", "feedings") + """, e as (select f.id, p.id as pid, case when f.id % 7 = 0 then null when f.id % 7 = 1 then 95e0 else latitude + f.id % 5 * 1e-3 end as lat, longitude as lon, latitude, longitude
  from feedings f left join parks p on p.id = case when f.id % 11 = 0 then -1 else f.park_id end)
select id, case when pid is null then 'unknown_point' when lat is null then 'location_missing' when lat > 90 then 'location_invalid'
  when 6371000 * acos(greatest(-1e0, least(1e0, sin(radians(lat)) * sin(radians(latitude)) + cos(radians(lat)) * cos(radians(latitude)) * cos(radians(longitude) - radians(lon))))) > 200 then 'too_far' end as location_error from e""")
def located_feedings(spark: SparkSession, d: str) -> DataFrame:
    p, k = V.parks(spark, d), F.col("e.id")
    j = V.feedings(spark, d).alias("e").join(p.alias("p"), F.col("p.id") == F.col("e.park_id"), "left")
    events = j.select(
        k.alias("id"), F.when(k % 11 == 0, F.lit(-1)).otherwise(F.col("e.park_id")).alias("point_id"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, 95.0).otherwise(F.col("latitude") + k % 5 * 1e-3).alias("reported_latitude"), F.col("longitude").alias("reported_longitude"),
    )
    return A.verify_location(events, p).select("id", "location_error")


PROPOSALS = ["Gazi Parkı", "12", "1234", "www.park.example", "Park alanı", "PARK", "gazi parkı", "Yeni Bahçe"]


@query(f"""with p as (select p_partkey as id, ({texts(PROPOSALS)})[p_partkey % 8 + 1] as name, case when p_partkey % 5 = 0 then 'short' when p_partkey % 11 = 0 then null else 'a sign at the gate' end as evidence from part)
select id, case when name = '12' then 'length' when name = '1234' then 'no_letter' when name like 'www%' then 'forbidden_text' when name in ('Park alanı', 'PARK') then 'generic'
  when evidence is null or evidence = 'short' then 'evidence' when name = 'gazi parkı' then 'unchanged' when name = 'Gazi Parkı' then 'unchanged' end as error from p""")
def name_proposals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    evidence = F.when(k % 5 == 0, "short").when(k % 11 == 0, None).otherwise("a sign at the gate")
    return V.table(spark, d, "part").select(k.alias("id"), rules.name_proposal_error(pick(PROPOSALS, k % 8), F.lit("Gazi Parkı"), evidence).alias("error"))


@query(V.heads("feedings") + " select id, occurred_at from feedings where status = 'hidden' order by occurred_at desc, id desc limit 50")
def newest_hidden(spark: SparkSession, d: str) -> DataFrame:
    return A.newest(V.feedings(spark, d), F.col("status") == "hidden", "occurred_at", 50).select("id", "occurred_at")


@query(V.heads("parks") + " select city, count(*) as n from parks group by city order by 2 desc, 1 limit 15")
def top_cities(spark: SparkSession, d: str) -> DataFrame:
    return T.top_groups(V.parks(spark, d), "city")


@query(V.heads("observations") + " select park_id, arg_max(id, struct_pack(t := observed_at, i := id)) as id from observations group by 1")
def latest_observations(spark: SparkSession, d: str) -> DataFrame:
    return T.latest_per(V.observations(spark, d), "park_id", "observed_at", "id").select("park_id", "id")


EXPLORED = f"""l as (select park_id, max(occurred_at) filter (food_grams > 0) as fed, max(occurred_at) filter (water_ml > 0) as water from feedings where status = 'published' group by 1),
o as (select park_id, arg_max(struct_pack(f := food_status, w := water_status, t := observed_at), struct_pack(t := observed_at, i := id)) as o from observations group by 1),
x as (select p.id, p.name, p.latitude, p.longitude, l.water, coalesce(o.o.w, 'unknown') as bowl, case when o.o.t > timestamp '{AT}' - interval 24 hours and (o.o.f = 'empty' or o.o.w = 'empty') then 'check'
  when l.fed is null then 'unknown' when l.fed < timestamp '{AT}' - interval 7 days then 'old' else 'recent' end as state from parks p left join l on l.park_id = p.id left join o on o.park_id = p.id)"""


def _explored(spark: SparkSession, d: str) -> DataFrame:
    parks = V.parks(spark, d).select("id", "name", "latitude", "longitude")
    return A.summary_status(A.park_summaries(parks, V.feedings(spark, d), V.observations(spark, d)), F.lit(AT).cast("timestamp"))


@query(V.heads("parks", "feedings", "observations") + f""", {EXPLORED} select 'water' as kind, id from x where water is null or bowl = 'empty' union all select 'check', id from x where state <> 'recent'
  union all select 'all', id from x union all select 'favorites', id from x where id in (select park_id from feedings where user_id = 3)""")
def explored_parks(spark: SparkSession, d: str) -> DataFrame:
    x = saved(_explored(spark, d).select("id", "last_water_at", "water_status", "state"), "explored")
    favorites = V.feedings(spark, d).where("user_id = 3").select("park_id")
    return T.union_branches(*(A.explore_filter(x, kind, favorites).select(F.lit(kind).alias("kind"), "id") for kind in ("all", "water", "check", "favorites")))


PALETTE = {k: v for k, v in A.STATE_LABELS.items()}


@query(V.heads("parks", "feedings", "observations") + f""", {EXPLORED} select id, latitude, longitude, name, case state {' '.join(f"when '{k}' then '{v[1]}'" for k, v in PALETTE.items())} end as color,
  case state {' '.join(f"when '{k}' then '{v[0]}'" for k, v in PALETTE.items())} end as status from x""")
def map_parks(spark: SparkSession, d: str) -> DataFrame:
    return A.map_rows(_explored(spark, d), "parks")


@query(V.heads("parks", "vets") + f""", {CASES} select id, latitude, longitude, case when status in ('reported', 'verifying') then '🚨' else '🙋' end as icon from cases
  union all select 'x' || id, latitude, longitude, '🏥' from vets""")
def map_markers(spark: SparkSession, d: str) -> DataFrame:
    vets = V.vets(spark, d).withColumn("id", tag("x", "id"))
    return A.map_rows(_cases(spark, d), "cases").unionByName(A.map_rows(vets, "vets"))


@query(V.heads("vets") + f""" select a.id, {tenths(H('c', 'a'))} as dm from vets a, (select 38.1e0 as latitude, 27.1e0 as longitude) c where active and {H('c', 'a')} <= 15000""")
def vets_nearby(spark: SparkSession, d: str) -> DataFrame:
    return S.vets_within(V.vets(spark, d), 38.1, 27.1, 15_000).select("id", metres("distance_m").alias("dm"))


@query(V.heads("parks") + """, x as (select *, case when id % 5 = 0 then 'missing' when id % 7 = 0 then 'community' when id % 3 = 0 then null else 'source' end as st, case when id % 4 = 0 then 'Cad. ' || id else '' end as a,
  case when id % 6 = 0 then 'https://x.example/' || id else '' end as u from parks)
select id, case when id % 5 = 0 then 'Park alanı · ' || upper(left(cast(id as varchar), 10)) else name end as name, coalesce(st, 'source') as name_status, 'OpenStreetMap' as name_source,
  case when st = 'community' then '' when u <> '' then u else 'https://www.openstreetmap.org/' || osm_id end as name_source_url, concat_ws(' · ', nullif(a, ''), district, city) as place from x""")
def presented_parks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    status = F.when(k % 5 == 0, "missing").when(k % 7 == 0, "community").when(k % 3 == 0, None).otherwise("source")
    url = F.when(k % 6 == 0, tag("https://x.example/", k)).otherwise("")
    p = V.parks(spark, d).select("id", "name", "osm_id", "city", "district", status.alias("name_status"), F.lit("").alias("name_source"), url.alias("name_source_url"), F.when(k % 4 == 0, tag("Cad. ", k)).otherwise("").alias("address_label"))
    return A.present(p).select("id", "name", "name_status", "name_source", "name_source_url", "place")


@query(V.heads("feedings") + f""", m as (select id, case when id % 50 <> 0 then greatest(0, floor((epoch_us(timestamp '{AT}') - epoch_us(occurred_at)) / 60000000)) end as m from feedings)
select id, case when m is null then 'Henüz kayıt yok' when m < 1 then 'Az önce' when m < 60 then cast(m as bigint) || ' dk önce' when m < 1440 then cast(floor(m / 60) as bigint) || ' saat önce' else cast(floor(m / 1440) as bigint) || ' gün önce' end as age,
  case when id < 1000 then id || ' m' else format('{{:.1f}} km', (id * 10 + 1) / 10000) end as distance from m""")
def labels(spark: SparkSession, d: str) -> DataFrame:
    f = V.feedings(spark, d).withColumn("occurred_at", F.when(F.col("id") % 50 != 0, F.col("occurred_at")))
    return f.select("id", rules.age_label("occurred_at", F.lit(AT).cast("timestamp")).alias("age"), rules.distance_label((F.col("id") * 10 + 1) / 10000).alias("distance"))


# --- names and text ---------------------------------------------------------------------------------------------------

EVIDENCE = f"""(({KEY('a.name')}) <> 'isimsizpark' and ({KEY('b.name')}) <> 'isimsizpark' and ({KEY('a.name')} = {KEY('b.name')} or 1 - levenshtein({KEY('a.name')}, {KEY('b.name')}) / greatest(length({KEY('a.name')}), length({KEY('b.name')}))::double >= 0.88))"""


@query(V.heads("source") + f""", n as (select id, {KEY('name')} as k from source), p as (select a.id as a, b.id as b, a.k as ka, b.k as kb from n a join n b on b.id = a.id + 1)
select a, b, cast(floor((1 - levenshtein(ka, kb) / greatest(length(ka), length(kb))::double) * 1000 + 0.5) as bigint) as s,
  ka = kb or (1 - levenshtein(ka, kb) / greatest(length(ka), length(kb))::double) >= 0.75 as matches from p""")
def similarities(spark: SparkSession, d: str) -> DataFrame:
    n = V.source(spark, d).select("id", text.name_key("name").alias("k"))
    p = n.alias("a").join(n.alias("b"), F.col("b.id") == F.col("a.id") + 1)
    sim = names.similarity(F.col("a.k"), F.col("b.k"))
    return p.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.floor(sim * 1000 + 0.5).cast("long").alias("s"), names.token_match(F.col("a.k"), F.col("b.k")).alias("matches"))


@query("""select p_partkey as id, 'sehit ' || replace(p_name, ' ', ' sehit ') as words from part""")
def expanded_words(spark: SparkSession, d: str) -> DataFrame:
    n = F.concat(F.lit("Şht. "), F.replace("p_name", F.lit(" "), F.lit(" SHT ")))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.tokens(n, expand=True), " ").alias("words"))


@query("""select p_partkey as id, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then 'loc ' || p_name else '' end as name from part""")
def source_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    tags = F.when(k % 3 == 0, F.map_from_arrays(F.array(F.lit("name"), F.lit("loc_name")), F.array(F.col("p_name"), F.lit("x")))).when(
        k % 3 == 1, F.map_from_arrays(F.array(F.lit("name"), F.lit("loc_name")), F.array(F.lit("  "), F.concat(F.lit("loc  "), "p_name")))
    )
    return V.table(spark, d, "part").select(k.alias("id"), text.source_name(F.coalesce(tags, F.map_from_arrays(F.array(F.lit("ref")), F.array(F.lit("1"))))).alias("name"))


@query("""with n as (select p_partkey as id, p_name, p_partkey // 2 % 3 as a, p_partkey % 3 as b from part)
select id, a <> b as conflict from n""")
def numeric_conflicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    n = V.table(spark, d, "part").select(k.alias("id"), names.parse_name(F.concat("p_name", F.lit(" "), s(F.expr("p_partkey div 2 % 3")), F.lit(" Parkı"))).alias("a"), names.parse_name(F.concat("p_name", F.lit(" "), s(k % 3), F.lit(" Parkı"))).alias("b"))
    return n.select("id", names.numeric_conflict(F.col("a"), F.col("b")).alias("conflict"))


@query("""with n as (select p_partkey as id, (['Otopark Girişi', 'Gazi Parkı', 'Mezarlık Parkı', 'Okul Bahçesi', 'Teknoloji Parkı'])[p_partkey % 5 + 1] as name, case when p_partkey % 7 = 0 then 'Refüj' else 'Yeşil Alan' end as layer from part)
select id, layer = 'Refüj' or name in ('Otopark Girişi', 'Okul Bahçesi') as non_park, name in ('Gazi Parkı', 'Mezarlık Parkı') as trustworthy from n""")
def park_evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    n = V.table(spark, d, "part").select(k.alias("id"), pick(["Otopark Girişi", "Gazi Parkı", "Mezarlık Parkı", "Okul Bahçesi", "Teknoloji Parkı"], k % 5).alias("name"), F.when(k % 7 == 0, "Refüj").otherwise("Yeşil Alan").alias("layer"))
    return n.select("id", rules.non_park("layer", "name").alias("non_park"), rules.trustworthy("name").alias("trustworthy"))


# --- distance joins ---------------------------------------------------------------------------------------------------


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """Parks, every third of them municipal with a ref of one of two sources."""
    k = F.col("id")
    own = k % 3 == 0
    return V.parks(spark, d).select(
        s(k).alias("id"), F.when(own, None).otherwise(F.col("osm_id")).alias("osm_id"), "name", "city", "district", "latitude", "longitude", "active",
        F.when(own, F.array(ref(tag("s", k % 2), s(k)))).otherwise(no_refs()).cast(f"array<{G.REF}>").alias("source_refs"),
    )


REGISTRY = "registry as (select cast(id as varchar) as id, id as k, case when id % 3 = 0 then null else osm_id end as osm_id, name, city, district, latitude, longitude, active, case when id % 3 = 0 then 's' || id % 2 end as code from parks)"


@query(V.heads("parks", "source") + f""", bt as (select 'p' || id as id, name, latitude, longitude, null as code from parks union all select 'm' || id, name, latitude, longitude, 's' || id % 2 from source),
p as (select a.id, a.code, b.code as other, {H('a', 'b')} as m, {EVIDENCE} as strong from bt a join bt b on a.id <> b.id and {NEAR} where a.code is not null and {H('a', 'b')} <= 250)
select code as source_code, count(distinct case when strong then id end) as strong_250, count(distinct case when strong and m <= 150 then id end) as strong_150, count(distinct case when m <= 30 then id end) as any_30,
  count(distinct case when m <= 30 and other = code then id end) as same_source_30 from p group by code""")
def near_duplicate_counts(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("id"), ["name", "latitude", "longitude"]
    p = V.parks(spark, d).select(tag("p", k).alias("id"), *at, "osm_id", no_refs().alias("source_refs"))
    m = V.source(spark, d).select(tag("m", k).alias("id"), *at, F.lit(None).cast("string").alias("osm_id"), F.array(ref(tag("s", k % 2), F.col("external_id"))).alias("source_refs"))
    return S.near_duplicate_audit(p.union(m))


@query(V.heads("source") + f""", k as (select *, {KEY('name')} as key from source), p as (select a.external_id as a, b.external_id as b from k a join k b on a.external_id <> b.external_id and {NEAR}
  where {H('a', 'b')} <= 300 and (contains(a.key, b.key) or contains(b.key, a.key))) select a as external_id, string_agg(b, ',' order by b) as others from p group by a""")
def guarded_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return S.duplicate_lists(V.source(spark, d), 300).select("external_id", F.array_join("others", ",").alias("others"))


@query(V.heads("parks", "source") + f""", p as (select a.external_id, b.id as park_id, {H('a', 'b')} as m from source a join parks b on {NEAR} where {H('a', 'b')} <= 250 and {EVIDENCE} and a.id % 7 = b.id % 7)
select external_id, arg_min(park_id, struct_pack(m := m, i := park_id)) as park_id from p group by 1""")
def guarded_matches(spark: SparkSession, d: str) -> DataFrame:
    a = V.source(spark, d).withColumn("city", F.lit("P")).withColumn("district", tag("D", F.col("id") % 7))
    b = V.parks(spark, d).withColumn("city", F.lit("P")).withColumn("source_refs", no_refs())
    return S.extended_guard(a, b, "src").select("a.external_id", F.col("b.id").alias("park_id"))


@query(V.heads("source") + f""", p as (select a.external_id as a, b.external_id as b, {H('a', 'b')} as m, {EVIDENCE} as strong from source a join source b on a.external_id < b.external_id and a.id % 4 <> b.id % 4 and {NEAR} where {H('a', 'b')} <= 500)
select a, b, concat_ws(',', case when m <= 300 then 'very_close' end, case when strong then 'strong_name_nearby' end) as reasons from p where m <= 300 or strong""")
def resource_duplicates(spark: SparkSession, d: str) -> DataFrame:
    records = V.source(spark, d).select(F.col("external_id").alias("key"), tag("r", F.col("id") % 4).alias("resource_uuid"), "name", "latitude", "longitude")
    return S.cross_resource_duplicates(records, 300, 500).select("a", "b", F.array_join("reasons", ",").alias("reasons"))


@query(V.heads("parks", "source") + f""", p as (select a.id, b.id as park_id, {H('a', 'b')} as m from source a join parks b on {NEAR} where {H('a', 'b')} <= 400) select id, arg_min(park_id, struct_pack(m := m, i := park_id)) as park_id from p group by 1""")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    return S.best_candidate(S.within_radius(V.source(spark, d), V.parks(spark, d), 400), "a.id").select("a.id", F.col("b.id").alias("park_id"))


# --- tables -----------------------------------------------------------------------------------------------------------


@query(V.heads("source") + " select taxonomy, min(id) as id from source group by 1")
def first_records(spark: SparkSession, d: str) -> DataFrame:
    return T.first_by(V.source(spark, d), "taxonomy", "position").select("taxonomy", "id")


@query(V.heads("source") + """, x as (select position, case when id % 17 = 0 then '' else cast(id % 700 as varchar) end as eid, id % 9 <> 0 as valid from source)
select position, case when eid = '' then 'missing_id' when coalesce(bool_or(valid) over (partition by eid order by position rows between unbounded preceding and 1 preceding), false) then 'duplicate_id' when not valid then 'invalid_geometry' end as reject from x""")
def valid_records(spark: SparkSession, d: str) -> DataFrame:
    rows = V.source(spark, d).select("position", "id", F.when(F.col("id") % 17 == 0, "").otherwise(s(F.col("id") % 700)).alias("eid"))
    return T.first_valid_by_id(rows, "eid", "position", F.col("id") % 9 != 0).select("position", "reject")


@query(V.heads("source") + """, x as (select external_id as c, id % 700 as t from source) select c, count(*) over (partition by t) as claims, (select coalesce(string_agg(y.c, ',' order by y.c), '') from x y where y.t = x.t and y.c <> x.c) as others from x""")
def shared_targets(spark: SparkSession, d: str) -> DataFrame:
    x = V.source(spark, d).select(F.col("external_id").alias("c"), (F.col("id") % 700).alias("t"))
    return T.shared_claimants(x, "c", "t").select("c", "claims", F.array_join("others", ",").alias("others"))


@query(V.heads("source") + " select taxonomy, arg_min(id, struct_pack(a := -(id * 7919 % 1000), i := id)) as id from source group by 1")
def largest_members(spark: SparkSession, d: str) -> DataFrame:
    return T.largest_member(V.source(spark, d).withColumn("area", F.col("id") * 7919 % 1000), "taxonomy", "area").select("taxonomy", "id")


@query(V.heads("parks", "source") + f""", a as (select {KEY('name')} as k, district as q, min(id) as id from parks group by 1, 2 having count(*) = 1), b as (select {KEY('name')} as k, 'D' || id % 7 as q, min(id) as id from source group by 1, 2 having count(*) = 1)
select a.id as park_id, b.id as source_id from a join b on a.k = b.k and a.q = b.q where a.k <> ''""")
def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    b = V.source(spark, d).select("id", "name", tag("D", F.col("id") % 7).alias("district"))
    return T.unique_key_match(V.parks(spark, d).select("id", "name", "district"), b, ["name", "district"]).select(F.col("a.id").alias("park_id"), F.col("b.id").alias("source_id"))


@query(V.heads("parks", "source") + " select p.id, min(s.position) as position from parks p join source s on p.osm_id = 'node/' || s.id // 2 group by 1")
def matched_boundaries(spark: SparkSession, d: str) -> DataFrame:
    polygons = V.source(spark, d).select(tag("node/", F.expr("id div 2")).alias("osm_id"), "position")
    return T.match_boundaries(V.parks(spark, d), polygons).select("id", "position")


@query(V.heads("parks") + " select id, case when id % 19 = 3 then 'removed' else 'common' end as state from parks union all select id + 1000000, 'new' from parks where id % 31 = 6")
def id_states(spark: SparkSession, d: str) -> DataFrame:
    p = V.parks(spark, d).select("id")
    return T.id_sets(p, p.where("id % 19 <> 3").union(p.where("id % 31 = 6").select(F.col("id") + 1_000_000)))


@query(V.heads("parks", "source") + " select id, name, osm_id, null as taxonomy from parks union all select id, name, null, taxonomy from source")
def united_sources(spark: SparkSession, d: str) -> DataFrame:
    return T.union_sources(V.parks(spark, d).select("id", "name", "osm_id"), V.source(spark, d).select("id", "name", "taxonomy"))


@query(V.heads("parks", "source") + " select id, name from parks union all select id + 1000000, name from source where id % 3 <> 1")
def appended_sources(spark: SparkSession, d: str) -> DataFrame:
    new = V.source(spark, d).select((F.col("id") + 1_000_000).alias("id"), "name", tag("s", F.col("id") % 3).alias("source_code"))
    return T.append_sources(V.parks(spark, d).select("id", "name"), new, new.where("source_code = 's1'").select("source_code").distinct())


@query(V.heads("source") + """, r as (select id % 300 as park_id, 's' || id % 2 as c, cast(id % 4 as varchar) as e, 'u' || max(id) as u from source group by 1, 2, 3) select park_id, string_agg(c || '/' || e || '/' || u, ',' order by c, e) as refs from r group by 1""")
def last_refs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    rows = V.source(spark, d).select((k % 300).alias("park_id"), tag("s", k % 2).alias("source_code"), s(k % 4).alias("external_id"), tag("u", k).alias("source_url"), "position")
    told = F.transform("source_refs", lambda r: F.concat_ws("/", r["source_code"], r["external_id"], r["source_url"]))
    return T.distinct_refs(rows).select("park_id", F.array_join(told, ",").alias("refs"))


@query(V.heads("source") + " select id from source where id % 5 <> 0")
def pending_records(spark: SparkSession, d: str) -> DataFrame:
    x = V.source(spark, d).select("id")
    return T.pending(x, x.where("id % 5 = 0"), "id")


@query(V.heads("parks") + f", {REGISTRY} select id, 's' || k % 2 as source_code, cast(2 as bigint) as refs from registry where k % 3 = 0 and k % 4 = 0")
def multi_refs(spark: SparkSession, d: str) -> DataFrame:
    r = _registry(spark, d)
    more = F.when(F.expr("cast(id as int) % 4 = 0 and cast(id as int) % 3 = 0"), F.concat("source_refs", F.array(ref(F.get("source_refs", F.lit(0))["source_code"], tag("b", "id"))))).otherwise(F.col("source_refs"))
    return T.multi_ref_parks(r.withColumn("source_refs", more))


MEMBERS = "m as (select id, taxonomy as component, case when id % 4 = 0 then 'accepted_osm_matched' else 'accepted_municipal_new' end as status, name from source)"


@query(V.heads("source") + f""", {MEMBERS}, c as (select component, status, count(*) as n from m group by 1, 2)
select component, (select count(*) from m x where x.component = c.component) as size, string_agg(status || '=' || n, ',' order by status) as statuses, (select max(id % 90) from m x where x.component = c.component and id % 2 = 0) as max_gap,
  (select count(distinct name) from m x where x.component = c.component) as names, (select count(distinct id) from m x where x.component = c.component) as targets from c group by component""")
def cluster_facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    m = V.source(spark, d).select("id", F.col("taxonomy").alias("component"), "name", F.when(k % 4 == 0, "accepted_osm_matched").otherwise("accepted_municipal_new").alias("status"), s(k).alias("canonical_id"))
    links = m.where("id % 2 = 0").select(k.alias("a"), k.alias("b"), (k % 90).cast("double").alias("gap_m"))
    told = T.cluster_summary(m, links)
    pairs = F.transform(F.array_sort(F.map_entries("statuses")), lambda e: F.concat_ws("=", e["key"], s(e["value"])))
    return told.select("component", "size", F.array_join(pairs, ",").alias("statuses"), F.col("max_gap_m").cast("long").alias("max_gap"), "names", "targets")


# --- regions ----------------------------------------------------------------------------------------------------------

INSIDE = """hit as (select p.id, e.region from parks p join edges e on (e.y1 > p.latitude) <> (e.y2 > p.latitude) and p.longitude < (e.x2 - e.x1) * (p.latitude - e.y1) / (e.y2 - e.y1) + e.x1 and abs(e.x1 - p.longitude) < 1 and abs(e.y1 - p.latitude) < 1),
inside as (select id, region from hit group by id, region having count(*) % 2 = 1)"""
SEGMENT = """seg as (select p.id, e.region, (e.x1 - p.longitude) * 111320 * cos(radians(p.latitude)) as px, (e.y1 - p.latitude) * 110540 as py, (e.x2 - p.longitude) * 111320 * cos(radians(p.latitude)) as qx, (e.y2 - p.latitude) * 110540 as qy
  from parks p join edges e on abs(e.x1 - p.longitude) < 0.2 and abs(e.y1 - p.latitude) < 0.2),
seg2 as (select *, case when pow(qx-px,2)+pow(qy-py,2) = 0 then 0e0 else greatest(0, least(1, (0 - (px*(qx-px)+py*(qy-py)))/(pow(qx-px,2)+pow(qy-py,2)))) end as t from seg),
dist as (select id, region, cast(floor(min(sqrt(pow(px+t*(qx-px),2)+pow(py+t*(qy-py),2))) + 0.5) as bigint) as m, min(sqrt(pow(px+t*(qx-px),2)+pow(py+t*(qy-py),2))) as raw from seg2 group by 1, 2)"""
#: The same for any number of blocks: a ring lies in one quarter degree, and those of other ones cross a point's ray evenly.
#: A bound in degrees would cut rings in two.
WHOLE_INSIDE = INSIDE.replace(
    "abs(e.x1 - p.longitude) < 1 and abs(e.y1 - p.latitude) < 1",
    "floor((e.x1 - 27 + 1e-9) / 25e-2) = floor((p.longitude - 27 + 1e-9) / 25e-2) and floor((e.y1 - 38 + 1e-9) / 25e-2) = floor((p.latitude - 38 + 1e-9) / 25e-2)",
)
ASSIGNED = f"""{WHOLE_INSIDE}, {SEGMENT}, near as (select id, min(struct_pack(m := m, r := region)) as b from dist where raw <= 3000 group by id),
assigned as (select p.id, coalesce(i.region, b.r) as region, case when i.region is not null then 'contained' when b is not null then 'nearest' else 'unresolved' end as method from parks p left join inside i using (id) left join near using (id))"""


@query(V.heads("parks", "edges") + f", {ASSIGNED} select id, region as district, method from assigned")
def resolved_districts(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_district(V.parks(spark, d), V.region_edges(spark, d))


@query(V.heads("parks", "edges") + f""", {ASSIGNED} select p.id, case when p.id % 10 <> 0 then city else coalesce(region, 'X') end as city from parks p left join assigned using (id)""")
def normalized_regions(spark: SparkSession, d: str) -> DataFrame:
    p, e = V.parks(spark, d), V.region_edges(spark, d)
    strange = p.withColumn("city", F.when(F.col("id") % 10 == 0, "X").otherwise(F.col("city")))
    return R.normalize_region(strange, e, e.select("region").distinct(), 3000)[0].select("id", "city")


@query(V.heads("parks", "edges") + f""", {INSIDE}, {SEGMENT}, c as (select id, region, min(raw) as raw from (select id, region, 0e0 as raw from inside union all select id, region, raw from dist where raw <= 300) group by 1, 2)
select id, region, {tenths('raw')} as dm, row_number() over (partition by id order by floor(raw * 1000 + 0.5), region) as rank from c""")
def region_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = V.region_edges(spark, d)
    same = e.select("region", F.lit("Aynı").alias("name")).distinct()
    return R.polygon_candidates(V.parks(spark, d), e, same).select("id", "region", metres("distance_m").alias("dm"), F.col("rank").cast("long").alias("rank"))


@query(V.heads("edges") + """ select distinct 'd' || name as district, name as province from (
  select region || '/' || cast(floor((x1 - 27 + 1e-9) / 25e-2) as bigint) || '/' || cast(floor((y1 - 38 + 1e-9) / 25e-2) as bigint) as name from edges) r""")
def districts_in_provinces(spark: SparkSession, d: str) -> DataFrame:
    """The lower left quarter of each region of each block."""
    block = lambda c, low: F.floor((F.col(c) - low + 1e-9) / 0.25).cast("string")
    e = V.region_edges(spark, d).withColumn("region", F.concat_ws("/", "region", block("x1", 27), block("y1", 38)))
    lower = R.region_boxes(e)
    x, y = F.col("west") + 0.01, F.col("south") + 0.01
    corners = [(F.col("west"), F.col("south")), (x, F.col("south")), (x, y), (F.col("west"), y)]
    ring = F.array(*(F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(corners, corners[1:] + corners[:1])))
    return R.districts_of(e, lower.select(tag("d", "region").alias("region"), F.inline(ring)))


# --- registry ---------------------------------------------------------------------------------------------------------


@query(V.heads("parks") + f""", {REGISTRY} select id, case when osm_id is null then 'municipal' else 'OpenStreetMap' end as source, case when k % 5 = 0 then 'missing' else 'source' end as name_status, case when k % 6 = 0 then 'Belediye' end as name_source from registry""")
def export_defaults(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    r = _registry(spark, d).select("id", "osm_id", "name", *(none.alias(c) for c in ("source", "name_status", "name_source", "name_source_url")))
    details = r.where("cast(id as int) % 6 = 0").select("id", F.lit("Belediye").alias("name_source"), F.lit("u").alias("name_source_url"))
    return G.with_export_defaults(r, details).select("id", "source", "name_status", "name_source")


@query(V.heads("parks") + f", {REGISTRY} select id, case when k % 10 = 5 then 'Yeni Park ' || k else name end as name, case when k % 10 = 5 then 'municipal' else 'source' end as name_status from registry")
def upgraded_names(spark: SparkSession, d: str) -> DataFrame:
    r = _registry(spark, d).withColumn("name_status", F.lit("source"))
    one = r.select("id", tag("Yeni Park ", "id").alias("official_name"))
    return G.upgrade_names(r, one.union(r.where("cast(id as int) % 10 = 0").select("id", F.lit("Öteki Bahçe")))).select("id", "name", "name_status")


@query(V.heads("parks") + " select cast(id as varchar) as id, name, case when id % 2 = 0 then id else -1 end as total_records from parks")
def restored_activity(spark: SparkSession, d: str) -> DataFrame:
    r = _registry(spark, d).select("id", "name", F.lit(-1).cast("long").alias("total_records"))
    old = r.where("cast(id as int) % 2 = 0").select("id", F.lit("old").alias("name"), F.col("id").cast("long").alias("total_records"))
    return G.restore_activity(r, old, ["total_records"])


@query(V.heads("parks") + f""", {REGISTRY} select 'osm_id' as kind, 'n' || k as incoming_id, id as held_by from registry where k % 8 = 1 and osm_id is not null union all select 'id', id, id from registry where k % 8 = 2
  union all select 'source_ref', 'n' || k, id from registry where k % 8 = 1 and k % 3 = 0""")
def identity_conflicts(spark: SparkSession, d: str) -> DataFrame:
    r, k = _registry(spark, d), F.col("id").cast("int")
    other = r.where(k % 8 == 1).withColumn("id", tag("n", "id"))
    return G.identity_conflicts(other.union(r.where(k % 8 == 2).withColumn("osm_id", tag("way/", "id")).withColumn("source_refs", no_refs())), r)


@query(V.heads("parks") + f""", {REGISTRY} select id, case when k % 10 = 5 and k % 4 < 2 then 'Kalan Ad' else name end as name, case when code is null then 0 else 1 end as refs from registry where k % 19 <> 3 or osm_id is null""")
def refreshed_registry(spark: SparkSession, d: str) -> DataFrame:
    """Some OSM parks are gone; unnamed ones keep an upgraded name."""
    r, k = _registry(spark, d), F.col("id").cast("int")
    up = (k % 10 == 5) & (k % 4 < 2)
    old = r.withColumn("name_status", F.when(up, "municipal").otherwise("source")).withColumn("name", F.when(up, "Kalan Ad").otherwise(F.col("name")))
    fresh = r.where(F.col("osm_id").isNotNull() & (k % 19 != 3)).withColumn("name_status", F.lit("source"))
    return G.refresh_reconcile(old, fresh)[0].select("id", "name", F.size("source_refs").cast("long").alias("refs"))


@query(V.heads("parks") + f""", {REGISTRY} select code as source_code, count(*) as before, count(*) filter (k % 4 <> 0) as after, count(*) filter (k % 8 = 0) as queued, count(*) filter (k % 8 = 4) as lost from registry where code is not null group by 1""")
def conserved_refs(spark: SparkSession, d: str) -> DataFrame:
    r, k = _registry(spark, d), F.col("id").cast("int")
    return G.ref_conservation(r, r.where(k % 4 != 0), G.exploded_refs(r.where(k % 8 == 0)))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    return V.source(spark, d).select(tag("s", k % 2).alias("source_code"), "external_id", s(k % 100).alias("park_id"), tag("u", k).alias("source_url"))


@query(V.heads("source") + """ select 's' || id % 2 as source_code, external_id, case when id % 5 = 1 then 'moved' else cast(id % 100 as varchar) end as park_id from source where id % 4 <> 3 or id % 5 = 1""")
def upserted_refs(spark: SparkSession, d: str) -> DataFrame:
    x, k = _refs(spark, d), F.col("external_id").cast("int")
    return G.upsert_refs(x.where(k % 4 != 3), x.where(k % 5 == 1).withColumn("park_id", F.lit("moved")))[0].select("source_code", "external_id", "park_id")


@query(V.heads("source") + " select count(*) filter (id % 4 = 3) as inserted, count(*) filter (id % 4 <> 3) as updated from source where id % 5 = 1")
def upserted_counts(spark: SparkSession, d: str) -> DataFrame:
    x, k = _refs(spark, d), F.col("external_id").cast("int")
    return G.upsert_refs(x.where(k % 4 != 3), x.where(k % 5 == 1).withColumn("park_id", F.lit("moved")))[1]


@query(V.heads("parks", "source") + """ select 'park' as kind, cast(id as varchar) as id from parks where id % 6 = 0 union all select 'ref', 's' || id % 2 || '/' || external_id from source where id % 9 = 0""")
def registry_only(spark: SparkSession, d: str) -> DataFrame:
    r, x = _registry(spark, d), _refs(spark, d)
    return G.inventory({"parks": r, "refs": x}, r.where("cast(id as int) % 6 <> 0").select("id"), x.where("cast(external_id as int) % 9 <> 0"))[1]


@query(V.heads("parks") + f""", {REGISTRY} select city, case when osm_id is null then 'municipal' else 'node' end as kind, count(*) as parks, count(*) filter (k % 5 = 0) as missing_names, count(*) filter (k % 7 = 3) as missing_districts from registry group by 1, 2""")
def audited_registry(spark: SparkSession, d: str) -> DataFrame:
    r = _registry(spark, d).withColumn("district", F.when(F.col("id").cast("int") % 7 == 3, " ").otherwise(F.col("district")))
    return G.audit_registry(r)[0]


@query(V.heads("parks", "source") + f""", {REGISTRY} select id, case when code is null then 0 else 1 end + (select count(*) from source s where s.id % 100 = k and s.id % 2 = 0) as refs from registry union all select 'n' || id, 0 from source where id % 2 = 1""")
def merged_registry(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d).where("cast(external_id as int) % 2 = 0").select(F.col("park_id").alias("id"), F.lit("new").alias("source_code"), "external_id", "source_url")
    fresh = V.source(spark, d).where("id % 2 = 1").select(tag("n", "id").alias("id"), "name", "latitude", "longitude", no_refs().alias("source_refs"))
    return G.merge(_registry(spark, d), refs, fresh).select("id", F.size("source_refs").cast("long").alias("refs"))


@query(V.heads("parks", "source") + f""" select a.external_id, {tenths(H('a', 'b'))} as dm, case when {KEY('b.name')} <> '' then cast(floor((1 - levenshtein({KEY('a.name')}, {KEY('b.name')}) / greatest(length({KEY('a.name')}), length({KEY('b.name')}))::double) * 1000 + 0.5) as bigint) end as s
  from source a left join parks b on b.id = a.id""")
def enriched_backlog(spark: SparkSession, d: str) -> DataFrame:
    x = V.source(spark, d)
    reviews = x.select("external_id", s("id").alias("target_id"))
    told = G.enrich_backlog(reviews, x, V.parks(spark, d).withColumn("id", s("id")))
    return told.select("external_id", metres("distance_m").alias("dm"), F.floor(F.col("name_similarity") * 1000 + 0.5).cast("long").alias("s"))


# --- consolidation and lifecycle --------------------------------------------------------------------------------------


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of four records; in every third one or two are matched to OSM parks."""
    k = F.col("id")
    c = F.expr("id div 4")
    osm = (c % 3 == 0) & ((k % 4 == 0) | ((k % 4 == 1) & (c % 2 == 0)))
    return V.source(spark, d).select(s(k).alias("id"), tag("c", c).alias("component"), F.when(osm, "accepted_osm_matched").otherwise("accepted_municipal_new").alias("status"), F.when(osm, tag("o", k)).otherwise(tag("m", k)).alias("canonical_id"), k.alias("order_id"))


JOINED = """j as (select id // 4 as c, count(*) as size, count(*) filter (id // 4 % 3 = 0 and (id % 4 = 0 or (id % 4 = 1 and id // 4 % 2 = 0))) as osm, min(id) as first_id from source group by 1)"""


@query(V.heads("source") + f""", {JOINED} select 'c' || c as component, case when osm > 1 then 'no_consolidation' else 'consolidate' end as action, case when osm = 0 then 'm' || first_id when osm = 1 then 'o' || first_id end as survivor_id,
  cast(case when osm > 1 then 0 else size - 1 end as bigint) as retired from j""")
def survivors(spark: SparkSession, d: str) -> DataFrame:
    return C.survivors(_members(spark, d)).select("component", "action", "survivor_id", F.size("retired").cast("long").alias("retired"))


@query(V.heads("source") + f""", {JOINED} select case when osm = 1 then 'o' else 'm' end || first_id as id, cast(size as bigint) as refs from j where osm <= 1
  union all select case when id % 4 < 2 then 'o' else 'm' end || id, 1 from source join j on c = id // 4 where osm > 1""")
def consolidated(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    r = m.select(F.col("canonical_id").alias("id"), F.when(F.col("status") == "accepted_osm_matched", tag("node/", "id")).alias("osm_id"), F.array(ref(F.lit("s"), F.col("id"))).cast(f"array<{G.REF}>").alias("source_refs"))
    return C.consolidate(r, m, C.survivors(m), "s")[0].select("id", F.size("source_refs").cast("long").alias("refs"))


CHAIN = "ch as (select id from parks where id % 8 <> 0)"


@query(V.heads("parks") + f""", {CHAIN} select 'p' || id as retired_id, case when id // 8 % 5 = 0 then 'TOMBSTONE_NON_PARK' when id // 8 % 5 = 1 then 'TOMBSTONE_TAXONOMY_REVIEW' else 'ALIAS_REDIRECT' end as action, case when id // 8 % 5 > 1 then 'p' || id // 8 * 8 end as survivor_id from ch
  union all select 'p' || id, case when id // 8 % 5 = 0 then 'TOMBSTONE_NON_PARK' else 'TOMBSTONE_TAXONOMY_REVIEW' end, null from parks where id % 8 = 0 and id // 8 % 5 < 2""")
def lifecycle_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chains of seven aliases, each on the one before; some ends are demoted."""
    p, k = V.parks(spark, d).select("id"), F.col("id")
    retired = p.where("id % 8 <> 0").select(tag("p", k).alias("retired_id"), tag("p", k - 1).alias("survivor_id"))
    demoted = p.where("id % 8 = 0 and id div 8 % 5 < 2").select(tag("p", k).alias("id"), F.when(F.expr("id div 8 % 5 = 0"), "NON_PARK").otherwise("TAXONOMY_AMBIGUOUS").alias("taxonomy_class"))
    return C.lifecycle_manifest(retired, demoted).select("retired_id", "action", "survivor_id")


@query(V.heads("parks") + f", {CHAIN} select 'p' || id as retired_id, 'p' || id // 8 * 8 as survivor_id from ch")
def flat_aliases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    return P.flatten_aliases(V.parks(spark, d).where("id % 8 <> 0").select(tag("p", k).alias("retired_id"), tag("p", k - 1).alias("survivor_id")))


ANCHORS = "an as (select id // 5 as c, case when id % 3 = 0 then 'o' || id % 2 end as a, id % 40 = 7 as review, id from source)"


@query(V.heads("source") + f""", {ANCHORS} select 'c' || c as component, case when bool_or(review) or count(distinct a) > 1 then 'review' when count(distinct a) = 1 then 'attach' else 'official_only' end as decision from an group by c""")
def anchored_clusters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    m = V.source(spark, d).select(tag("c", F.expr("id div 5")).alias("component"), F.when(k % 3 == 0, tag("o", k % 2)).alias("anchor_id"), (k % 40 == 7).alias("needs_review"))
    return C.anchor_clusters(m).select("component", "decision")


@query(V.heads("source") + " select 'o' || id % 97 as anchor_id, count(*) as polygons from source where id % 3 = 0 group by 1 having count(*) > 1")
def multi_anchors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    return C.multi_anchor_groups(V.source(spark, d).select(F.when(k % 3 == 0, tag("o", k % 97)).alias("anchor_id"), s(k).alias("region")))


@query(V.heads("parks", "source") + f""", p as (select a.id, b.id as anchor from source a join parks b on {NEAR} and {KEY('a.name')} = {KEY('b.name')} where {H('a', 'b')} <= 150 and {KEY('a.name')} <> '') select 'c' || id as component, min(anchor) as anchor_id from p group by 1 having count(*) = 1""")
def rescued_clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.rescue_by_name(V.source(spark, d).withColumn("component", tag("c", "id")), V.parks(spark, d)).select("component", "anchor_id")


# --- edges and components ---------------------------------------------------------------------------------------------

PAIRS = f"""pr as (select a.id as a, b.id as b, {H('a', 'b')} as m, {KEY('a.name')} = {KEY('b.name')} as named, a.district = b.district or (a.id + b.id) % 3 > 0 as same, a.id % 6 = 1 or b.id % 6 = 1 as strict from parks a join parks b on a.id < b.id and {NEAR} where {H('a', 'b')} <= 600),
ed as (select *, case when not same then null when not named then case when m < 60 then 'conflict' end when m <= case when strict then 200 else 300 end then 'link' when m <= 600 then 'gray' end as edge from pr)"""
REACH = "lk as (select a, b from ed where edge = 'link' union all select b, a from ed where edge = 'link'), reach(id, r) as (select id, id from parks union select reach.id, lk.b from reach join lk on lk.a = reach.r), comp as (select id, min(r) as component from reach group by id)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    p = V.parks(spark, d)
    pairs = S.self_pairs(p, 600)
    told = pairs.select(
        F.col("a.id").alias("_a"), F.col("b.id").alias("_b"), F.col("distance_m").alias("boundary_gap_m"), (text.name_key("a.name") == text.name_key("b.name")).alias("name_evidence"),
        ((F.col("a.district") == F.col("b.district")) | ((F.col("a.id") + F.col("b.id")) % 3 > 0)).alias("same_district"), (F.col("distance_m") < 10).alias("intersects"), F.lit(False).alias("touches"),
        F.when(F.col("distance_m") < 60, 1.0).otherwise(0.0).alias("overlap_fraction_a"), F.lit(0.0).alias("overlap_fraction_b"),
    ).withColumnsRenamed({"_a": "a", "_b": "b"})
    return saved(P.classify_edges(told, p.where("id % 6 = 1").select("id"), 300, 200, 600), "edges")


@query(V.heads("parks") + f", {PAIRS} select a, b, edge from ed")
def classified_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("a", "b", "edge")


@query(V.heads("parks", recursive=True) + f""", {PAIRS}, {REACH}, li as (select x.component as ca, y.component as cb, edge from ed join comp x on x.id = a join comp y on y.id = b where edge in ('gray', 'conflict')),
gl as (select ca as a, cb as b from li where edge = 'gray' union all select cb, ca from li where edge = 'gray'), gr(c, r) as (select component, component from comp union select gr.c, gl.b from gr join gl on gl.a = gr.r), grp as (select c as component, min(r) as group_id from gr group by c),
sz as (select component, count(*) as size from comp group by 1), cf as (select distinct group_id from grp join (select ca as component from li where edge = 'conflict' union select cb from li where edge = 'conflict') using (component)), gn as (select group_id, count(*) as n from grp group by 1)
select component, group_id, size, case when n > 1 or group_id in (select group_id from cf) then 'AMBIGUOUS_CLUSTER' when size >= 2 then 'ONE_PHYSICAL_PARK_CONFIDENT' else 'STANDALONE_PHYSICAL_PARK' end as group_class from grp join sz using (component) join gn using (group_id)""")
def component_groups(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    components = P.connected_components(V.parks(spark, d), e.where("edge = 'link'"))
    return P.component_groups(components, e)


@query(V.heads("parks", recursive=True) + f", {PAIRS}, {REACH} select id, case when id % 9 = 2 then -1 else component end as component, component as rederived from comp where id % 9 = 2")
def connectivity_audit(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    told = P.connected_components(V.parks(spark, d), e.where("edge = 'link'"))
    return P.audit_connectivity(told.withColumn("component", F.when(F.col("id") % 9 == 2, F.lit(-1)).otherwise(F.col("component"))), e)


@query(V.heads("parks", recursive=True) + f""", {PAIRS}, {REACH}, o as (select a, b, m from ed join comp x on x.id = a join comp y on y.id = b where named and x.component <> y.component) select id, {tenths('min(m)')} as dm from (select a as id, m from o union all select b, m from o) group by 1""")
def nearest_components(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return P.nearest_other_component(e, P.connected_components(V.parks(spark, d), e.where("edge = 'link'"))).select("id", metres("gap_m").alias("dm"))


# --- polygons ---------------------------------------------------------------------------------------------------------


def _box(x, y, w: float, h: float) -> Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    at = [(0, 0), (w, 0), (w, h), (0, h), (0, 0)]
    return F.array(F.array(F.array(*(F.array((x + a).cast("double"), (y + b).cast("double")) for a, b in at))))


@query(V.heads("parks") + """ select id, cast(round(longitude * 1000000) as bigint) as west, cast(round((latitude + 0.002) * 1000000) as bigint) as north, cast(2000 as bigint) as area, true as centre, false as outside, id % 4 <> 0 as sound from parks""")
def box_facts(spark: SparkSession, d: str) -> DataFrame:
    p = V.parks(spark, d).select("id", "longitude", "latitude", _box("longitude", "latitude", 0.001, 0.002).alias("polys"))
    ring = F.get(F.get(F.col("polys"), F.lit(0)), F.lit(0))
    micro = lambda c: F.round(c * 1_000_000).cast("long")
    b, mid = geo.bbox("polys"), geo.ring_centroid(ring)
    broken = F.when(F.col("id") % 4 == 0, F.array(F.array(F.slice(ring, 1, 4)))).otherwise(F.col("polys"))
    p = p.withColumn("surface", P.point_on_surface("polys"))
    surface = F.col("surface")
    inside = geo.in_rings_even_odd(mid["lon"], mid["lat"], F.get(F.col("polys"), F.lit(0))) & geo.in_rings_even_odd(surface["lon"], surface["lat"], F.get(F.col("polys"), F.lit(0)))
    return p.select("id", micro(b["west"]).alias("west"), micro(b["north"]).alias("north"), F.round(F.abs(geo.ring_area(ring)) * 1e9).cast("long").alias("area"), inside.alias("centre"),
                    geo.in_rings_even_odd(F.col("longitude") - 0.001, "latitude", F.get(F.col("polys"), F.lit(0))).alias("outside"), P.clean_geometry(broken).isNotNull().alias("sound"))


@query(V.heads("parks") + f""", g as (select a.id as a, b.id as b, greatest(0, greatest(a.longitude, b.longitude) - least(a.longitude, b.longitude) - 1e-3) * 111320 * cos(radians(a.latitude)) as dx, greatest(0, greatest(a.latitude, b.latitude) - least(a.latitude, b.latitude) - 1e-3) * 110540 as dy
  from parks a join parks b on a.id < b.id and {NEAR} where {H('a', 'b')} <= 300)
select a, b, dx = 0 and dy = 0 as intersects, cast(floor(sqrt(dx * dx + dy * dy) + 0.5) as bigint) as gap from g""")
def box_relations(spark: SparkSession, d: str) -> DataFrame:
    p = V.parks(spark, d).select("id", "latitude", "longitude", _box("longitude", "latitude", 0.001, 0.001).alias("polys"))
    r = S.self_pairs(p, 300).withColumn("r", P.polygon_relation("a.polys", "b.polys"))
    return r.select(F.col("a.id").alias("_a"), F.col("b.id").alias("_b"), "r.intersects", F.floor(F.col("r.boundary_gap_m") + 0.5).cast("long").alias("gap")).withColumnsRenamed({"_a": "a", "_b": "b"})


@query(V.heads("parks") + """ select id, id % 3 = 0 as polygon from parks""")
def attached_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Two polygons have the park's number; only one holds its point."""
    p = V.parks(spark, d).select("id", "osm_id", "latitude", "longitude")
    some = p.where("id % 3 = 0")
    own = some.select(F.replace("osm_id", F.lit("node"), F.lit("way")).alias("osm_id"), _box(F.col("longitude") - 0.0005, F.col("latitude") - 0.0005, 0.001, 0.001).alias("polys"))
    far = some.select(F.replace("osm_id", F.lit("node"), F.lit("relation")).alias("osm_id"), _box(F.col("longitude") + 0.01, "latitude", 0.001, 0.001).alias("polys"))
    told = P.attach_polygons(p, own.union(far))
    return told.select("id", F.coalesce(P.point_polygon_m("longitude", "latitude", "polys") == 0, F.lit(False)).alias("polygon"))


# --- review and release -----------------------------------------------------------------------------------------------


@query(V.heads("parks", "source") + f""", p as (select a.id, b.id as park_id, {H('a', 'b')} as m, {KEY('a.name')} = {KEY('b.name')} as exact from source a join parks b on {NEAR} where {H('a', 'b')} <= 250)
select 's:' || id as key, cast(park_id as varchar) as park_id, {tenths('m')} as dm, exact, id % 7 = park_id % 7 as same_district from p""")
def review_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("key", "park_id", metres("distance_m").alias("dm"), F.col("rel.exact_normalized_name").alias("exact"), (F.col("district") == "SAME_DISTRICT").alias("same_district"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    x = V.source(spark, d).select(tag("s:", "id").alias("key"), F.lit("s").alias("source_code"), "external_id", "name", F.lit("P").alias("city"), tag("D", F.col("id") % 7).alias("district"), "latitude", "longitude", F.lit(100.0).alias("tier2_m"),
                                  F.col("id").alias("order_id"), F.lit(True).alias("trustworthy"), F.lit("").alias("texts"))
    return x.withColumn("polys", F.lit(None).cast("array<array<array<array<double>>>>"))


def _alone(records: DataFrame) -> DataFrame:
    """Clusters of one record each."""
    return records.select("key", F.col("key").alias("component"), F.lit(1).alias("size"), F.lit(False).alias("ambiguous"), F.lit(False).alias("ambiguous_cluster"), F.col("order_id").alias("first_id"))


def _candidates(spark: SparkSession, d: str, records: DataFrame | None = None) -> DataFrame:
    p = V.parks(spark, d).select(s("id").alias("id"), "name", F.lit("P").alias("city"), "district", "latitude", "longitude", F.lit(None).cast("array<array<array<array<double>>>>").alias("polys"), no_refs().alias("source_refs"))
    return B.review_candidates(_records(spark, d) if records is None else records, p)


@query(V.heads("parks", "source") + f""", p as (select a.id, b.id as park_id, {H('a', 'b')} as m from source a join parks b on {NEAR} where {H('a', 'b')} <= 250), f as (select id, min(m) as m, bool_or(id % 7 = park_id % 7) as same, bool_or(id % 7 <> park_id % 7) as other from p group by 1)
select 's:' || source.id as key, {tenths('m')} as dm, coalesce(same, false) as same_district, coalesce(other, false) as district_conflict, coalesce(m <= 30, false) as very_close, coalesce(m <= 100, false) as primary_radius, coalesce(m > 100, false) as extended_radius from source left join f using (id)""")
def review_flags(spark: SparkSession, d: str) -> DataFrame:
    rec = B.parsed_records(_records(spark, d))
    e = B.review_evidence(rec, _candidates(spark, d, rec), _alone(rec))
    return e.select("key", metres("nearest_m").alias("dm"), "same_district", "district_conflict", "very_close", "primary_radius", "extended_radius")


@query(V.heads("parks", "source") + f""", n as (select distinct a.id from source a join parks b on {NEAR} where {H('a', 'b')} <= 250), d as (select * from source where id not in (select id from n)) select 's:' || id as key, 'NEW_CANONICAL_SAFE' as outcome, 'safe' as reason from d""")
def safe_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of the records that have no park near them."""
    rec = B.parsed_records(_records(spark, d))
    cand = _candidates(spark, d, rec)
    e = B.new_safe(B.review_evidence(rec, cand, _alone(rec)))
    targets = B.record_targets(e, cand, cand.select("park_id", F.lit("s").alias("source_code"), F.col("key").alias("component"), F.lit(1).alias("n")))
    mates = B.accepted_mates(rec.select(F.col("key").alias("component"), F.lit("review").alias("status"), F.col("external_id").alias("canonical_id")))
    return B.resolve_reviews(e, targets, mates).join(cand.select("key"), "key", "left_anti").select("key", "outcome", "reason")


def _bundle(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    p, k = V.parks(spark, d), F.col("id")
    live = p.where("id % 13 <> 1 and id % 17 <> 2")
    gone = p.where("id % 13 = 1 and id % 17 <> 2 and (id - 1) % 17 <> 2")
    return {
        "parks": live.select(s(k).alias("id"), "osm_id", F.concat("name", F.lit(" R")).alias("name"), "latitude", "longitude"),
        "refs": live.select(F.lit("s").alias("source_code"), s(k).alias("external_id"), s(k).alias("park_id"), tag("u", k).alias("source_url")),
        "aliases": gone.select(s(k).alias("retired_id"), s(k - 1).alias("survivor_id")),
        "tombstones": p.where("id % 17 = 2").select(s(k).alias("retired_id"), F.lit("non_park").alias("kind")),
        "reviews": p.where("id % 17 = 2").select(F.lit("r").alias("source_code"), s(k).alias("external_id")), "rejections": p.where("id % 34 = 2").select(F.lit("q").alias("source_code"), s(k).alias("external_id")),
    }


@query(V.heads("parks") + """, live as (select id from parks where id % 13 <> 1 and id % 17 <> 2)
select 'repeated_parks' as rule, cast(id as varchar) as id from live where id % 10 = 3 union all select 'review_and_rejection', 'r/' || id from parks where id % 34 = 2
  union all select 'alias_without_survivor', cast(id as varchar) from parks where id % 13 = 1 and id % 17 <> 2 and (id - 1) % 17 <> 2 and id % 3 = 0""")
def bundle_violations(spark: SparkSession, d: str) -> DataFrame:
    f, k = _bundle(spark, d), F.col("id").cast("int")
    parks = f["parks"].union(f["parks"].where(k % 10 == 3))
    lost = F.when(F.col("retired_id").cast("int") % 3 == 0, "nowhere").otherwise(F.col("survivor_id"))
    reviewed = f["rejections"].withColumn("source_code", F.lit("r"))
    return L.validate_bundle(f | {"parks": parks, "aliases": f["aliases"].withColumn("survivor_id", lost), "rejections": reviewed})


def _released(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    p, k = V.parks(spark, d), F.col("id")
    none = F.lit(None).cast("string")
    f = V.feedings(spark, d).join(p.select(k.alias("park_id")), "park_id", "left_semi")
    fav = f.groupBy(tag("u", "user_id").alias("user_id"), s("park_id").alias("park_id")).agg(F.min("occurred_at").alias("created_at"))
    tables = {
        "parks": p.select(s(k).alias("id"), "osm_id", "name", F.lit(True).alias("active"), F.when(k % 6 == 0, "community").otherwise("source").alias("name_status"), F.array(F.lit("s")).alias("source_refs")),
        "refs": p.where("id % 2 = 0").select(F.lit("s").alias("source_code"), s(k).alias("external_id"), s(k).alias("park_id"), tag("u", k).alias("source_url")),
        "points": p.select(s(k).alias("id"), s(k).alias("park_id"), F.lit("Genel").alias("name"), "latitude", "longitude", F.lit(True).alias("active")),
        "events": f.select(s("id").alias("id"), s("park_id").alias("point_id"), s("park_id").alias("park_id")), "observations": f.where("false").select(s("id").alias("id"), s("park_id").alias("point_id"), s("park_id").alias("park_id")),
        "favorites": fav, "suggestions": fav.where("false").select(s("park_id").alias("id"), "user_id", "park_id", F.lit("pending").alias("status")),
        "aliases": p.where("false").select(none.alias("retired_id"), none.alias("survivor_id")), "tombstones": p.where("false").select(none.alias("retired_id"), none.alias("kind")),
    }
    return L.apply_release(tables, _bundle(spark, d), p.where("id % 221 = 53").select(s(k).alias("id")), acknowledged=True)


GONE = "(id % 13 = 1 and id % 17 <> 2 and (id - 1) % 17 <> 2)"


@query(V.heads("parks") + f""" select cast(id as varchar) as id, case when id % 6 = 0 or id % 13 = 1 or id % 17 = 2 then name else name || ' R' end as name, not ({GONE} or id % 17 = 2 or (id % 13 = 1 and id % 17 = 3 and id % 221 <> 53)) as active from parks""")
def released_parks(spark: SparkSession, d: str) -> DataFrame:
    return _released(spark, d)[0]["parks"].select("id", "name", "active")


@query(V.heads("parks", "feedings") + f""" select cast(f.id as varchar) as id, cast(case when {GONE.replace('id', 'p.id')} then p.id - 1 else p.id end as varchar) as park_id from feedings f join parks p on p.id = f.park_id""")
def released_events(spark: SparkSession, d: str) -> DataFrame:
    return _released(spark, d)[0]["events"].select("id", "park_id")


# --- serials and readiness --------------------------------------------------------------------------------------------

PKG = "0f8fad5b-d9cb-469f-a165-70867728950e"
RES = "7c9e6679-7425-40de-944b-e07fc1f90a"


def _serials(spark: SparkSession, d: str) -> DataFrame:
    """Five resources; serials of the second repeat, those of the third are missing in part, the fourth's id is broken."""
    k = F.col("id")
    serial = F.when((k % 5 == 1) & (k % 20 == 1), "1").when((k % 5 == 2) & (k % 15 == 2), None).otherwise(F.col("external_id"))
    return V.source(spark, d).select(F.lit(PKG).alias("package_uuid"), F.when(k % 5 == 3, "broken").otherwise(F.concat(F.lit(RES + "e"), s(k % 5))).alias("resource_uuid"), serial.alias("serial"), "name", "latitude", "longitude", "id")


@query(V.heads("source") + f""" select case id when 3 then 'broken' else '{RES}e' || id end as resource_uuid, case when id = 4 then 'BLOCKED_LICENSE' when id = 0 then 'READY_FOR_RECONCILIATION' else 'BLOCKED_IDENTITY' end as status, case id when 4 then 'I' when 0 then '' when 1 then 'B,G' when 2 then 'A' else 'D,G' end as failed from source where id < 5""")
def serial_resources(spark: SparkSession, d: str) -> DataFrame:
    x = _serials(spark, d)
    res = x.select("package_uuid", "resource_uuid").distinct()
    lic = res.withColumn("license_status", F.when(F.col("resource_uuid").endswith("e4"), "UNCLEAR").otherwise("SAFE_OPEN"))
    told = Z.validate_serial_resource(x, lic, res.withColumn("passes", F.lit(True)))
    return told.select("resource_uuid", "status", F.array_join("failed", ",").alias("failed"))


@query(V.heads("source") + f""" select '{PKG}' as package_uuid, cast(1 as bigint) as missing_resources, (select count(*) - count(distinct external_id) from (select case when id % 20 = 1 then '1' else external_id end as external_id from source where id % 15 <> 2)) as collisions, false as proven""")
def package_scope(spark: SparkSession, d: str) -> DataFrame:
    x = _serials(spark, d)
    upstream = x.select("package_uuid", "resource_uuid").distinct()
    return Z.package_scope_proof(upstream.union(upstream.limit(1).withColumn("resource_uuid", F.lit("absent"))), x)


@query(V.heads("source") + f""" select distinct 'RESOURCE_MOVED' as blocker from source union all select 'SERIAL_REUSED' from source where id = 0""")
def snapshot_blockers(spark: SparkSession, d: str) -> DataFrame:
    """Some serials go to another resource, others turn up far away."""
    k = F.col("id")
    before = _serials(spark, d)
    after = before.withColumn("resource_uuid", F.when(k % 20 == 5, F.lit(RES + "e4")).otherwise(F.col("resource_uuid"))).withColumn("latitude", F.when(k % 20 == 4, F.col("latitude") + 1).otherwise(F.col("latitude")))
    changes = saved(Z.compare_snapshots(before, after), "changes")
    return Z.blockers(changes, Z.snapshot_flags(before, after, changes))


@query(V.heads("source") + f""", res as (select distinct id % 5 as r from source where id % 5 <> 3)
select '{RES}e' || r as resource_uuid, 'RESOURCE_MOVED' as blocker from res where r in (0, 4) and exists (select 1 from source where id % 20 = 5)
union all select '{RES}e4', 'SERIAL_REUSED' from res where r = 4 and exists (select 1 from source where id % 20 = 4)
union all select '{RES}e1', 'SERIAL_REUSED' from res where r = 1 and (select count(*) from source where id % 20 = 1) > 1""")
def resource_blockers(spark: SparkSession, d: str) -> DataFrame:
    """What blocks each resource's part of the comparison of ``snapshot_blockers``."""
    k = F.col("id")
    before = _serials(spark, d)
    after = before.withColumn("resource_uuid", F.when(k % 20 == 5, F.lit(RES + "e4")).otherwise(F.col("resource_uuid"))).withColumn("latitude", F.when(k % 20 == 4, F.col("latitude") + 1).otherwise(F.col("latitude")))
    changes = saved(Z.compare_snapshots(before, after), "changes")
    flags = saved(Z.snapshot_flags(before, after, changes), "flags")
    told = [Z.blockers(changes, flags, RES + f"e{r}").select(F.lit(RES + f"e{r}").alias("resource_uuid"), "blocker") for r in (0, 1, 2, 4)]
    return T.union_branches(*told)


@query(V.heads("parks") + f""" select id from parks where contains(trim(regexp_replace({plain_sql("name || ' ' || city || ' ' || district")}, '[^a-z0-9]+', ' ', 'g')), 'isimsiz park r1')""")
def searched_parks(spark: SparkSession, d: str) -> DataFrame:
    """Accent-free search over name, city and district together."""
    return V.parks(spark, d).where(text.matches_query(["name", "city", "district"], "İSİMSİZ  park-R1")).select("id")


@query(V.heads("parks") + """ select id, id = 7 as selected from parks where id % 4 <> 1 and (id = 7 or (floor(longitude / 25e-2) in (108, 109) and floor(latitude / 25e-2) in (152, 153)))""")
def boundaries_in_view(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries of the viewport's tiles and of the selected park; every fourth park has none."""
    p = V.parks(spark, d).withColumn("polys", F.when(F.col("id") % 4 != 1, _box("longitude", "latitude", 0.001, 0.001)))
    return sinks.visible_boundaries(p, 38.1, 38.4, 27.1, 27.3, 7).select("id", "selected")


@query(V.heads("source") + """ select external_id as serial from source where id % 3 = 0""")
def companion_numbers(spark: SparkSession, d: str) -> DataFrame:
    x = V.source(spark, d).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit(" "), "external_id")).otherwise("n/a").alias("no"))
    return readers.companion_serials(x, "no")


@query(V.heads("source") + """ select taxonomy as org, case when taxonomy = 'Brand#2' then 'UNKNOWN' when taxonomy = 'Brand#3' then 'UNKNOWN' when taxonomy in ('Brand#4', 'Brand#5') then 'SAFE_OPEN' else 'CLOSED' end as status from source group by 1""")
def license_states(spark: SparkSession, d: str) -> DataFrame:
    orgs = V.source(spark, d).select(F.col("taxonomy").alias("org")).distinct()
    o = F.col("org")
    good = o.isin("Brand#4", "Brand#5")
    evidence = orgs.select(F.upper(o).alias("org"), F.when(good, "SAFE_OPEN").otherwise("CLOSED").alias("status"), F.when(o == "Brand#3", "Genel").otherwise("CC-BY").alias("label"), F.lit(1).alias("priority"))
    worse = orgs.select("org", F.lit("CLOSED").alias("status"), F.lit("x").alias("label"), F.lit(2).alias("priority")).where(o != "Brand#3")
    return Y.license_status(orgs, evidence.union(worse), orgs.where(o == "Brand#2"), ("genel",))


@query(V.heads("source") + " select id from source where taxonomy in ('Brand#4', 'Brand#5')")
def licensed_records(spark: SparkSession, d: str) -> DataFrame:
    x = V.source(spark, d).withColumn("org", F.col("taxonomy"))
    return Y.licensed(x, x.select("org").distinct().withColumn("status", F.when(F.col("org").isin("Brand#4", "Brand#5"), "SAFE_OPEN").otherwise("CLOSED"))).select("id")


@query("""select p_partkey as dataset_id, r as resource_id, p_partkey % 3 = 0 or p_partkey % 4 = 0 as park_like from part, unnest(range(p_partkey % 3)) t(r) union all select p_partkey, null, true from part where p_partkey % 3 = 0""")
def resources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    n = (k % 3).cast("int")
    made = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.cast("long").alias("resource_id"), F.lit("CSV").alias("format"), F.lit("u").alias("url")))
    rows = V.table(spark, d, "part").select(k.alias("dataset_id"), F.when(k % 3 == 0, "Kent Parkları").otherwise("Otoparklar").alias("title"), F.when(k % 4 == 0, F.array(F.lit("yeşil"), F.lit("PARK"))).otherwise(F.array(F.lit("yol"))).alias("tags"), made.alias("resources"))
    return Y.catalog_resources(rows).select("dataset_id", "resource_id", "park_like")


FORMATS = [("CSV", "ad;enlem;boylam", "csv_coordinates"), ("csv", "ad;adres", "csv_table"), ("JSON", '{"type": "FeatureCollection"}', "geojson"), ("shp", "", "archive"), ("KMZ", "", "kml"), ("xlsx", "", "spreadsheet"), ("tsv", "", "csv_unknown"), ("", "", "other")]


@query(f"select p_partkey as id, ({texts([c for *_, c in FORMATS])})[p_partkey % 8 + 1] as format_class from part")
def format_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = V.table(spark, d, "part").select(k.alias("id"), pick([f for f, *_ in FORMATS], k % 8).alias("format"), pick([x for _, x, _ in FORMATS], k % 8).alias("sample"))
    return Y.classify_format(rows).select("id", "format_class")


@query(V.heads("parks") + """ select city as dataset_id, district as value, count(*) as n, cast(floor(avg(1.0) * 1000 + 0.5) as bigint) as share from parks group by 1, 2""")
def taxonomy_shares(spark: SparkSession, d: str) -> DataFrame:
    p = V.parks(spark, d).select(F.col("city").alias("dataset_id"), "name", F.col("district").alias("taxonomy"))
    return Y.taxonomy_profile(p).select("dataset_id", "value", "n", F.floor(F.col("park_share") * 1000 + 0.5).cast("long").alias("share"))


@query(V.heads("source") + """ select id, name, latitude > 38.1 as north from source""")
def staged_records(spark: SparkSession, d: str) -> DataFrame:
    """Records as the JSON array of a text column, a hundred each."""
    docs = V.source(spark, d).groupBy(F.expr("id div 100").alias("g")).agg(F.to_json(F.collect_list(F.struct("id", "name", "latitude"))).alias("body"))
    return readers.stage_records(docs, "body", "id bigint, name string, latitude double").select("id", "name", (F.col("latitude") > 38.1).alias("north"))


@query(V.heads("parks", "feedings") + """ select f.id, p.city, f.user_id as author from feedings f left join parks p on p.id = f.park_id""")
def report_contexts(spark: SparkSession, d: str) -> DataFrame:
    f, k = V.feedings(spark, d), F.col("id")
    told = readers.report_context(f.select("id", "park_id", k.alias("feeding_id")), V.parks(spark, d), f)
    return told.select("id", F.get_json_object("context", "$.park.city").alias("city"), F.get_json_object("context", "$.event.user_id").cast("long").alias("author"))


@query(V.heads("parks") + f", {REGISTRY} select id, coalesce(code = 's0', false) as only_s0, coalesce(code = 's0', false) or k % 6 = 3 as has_s0 from registry")
def ref_sources(spark: SparkSession, d: str) -> DataFrame:
    r = _registry(spark, d)
    two = F.when(F.col("id").cast("int") % 6 == 3, F.concat("source_refs", F.array(ref(F.lit("s0"), F.lit("x"))))).otherwise(F.col("source_refs"))
    r = r.withColumn("source_refs", two)
    return r.select("id", rules.only_source("source_refs", "s0").alias("only_s0"), rules.has_source("source_refs", "s0").alias("has_s0"))


# --- SQL of queries registered elsewhere --------------------------------------------------------------------------------

# Every ninth place has the id of the one before, and every fourteenth no valid place, so that ids repeat among the valid and
# the others. Places move to places of their own by position.
GAP = f"""pl as (select *, cast(position - case when position % 9 = 1 then 1 else 0 end as varchar) as place_id, position % 14 <> 3 as sound from source),
ask as (select * from pl where taxonomy in ({', '.join(f"'Brand#{k}'" for k in range(1, 13))})),
cand as (select a.*, coalesce(i.region, b.r) as city from ask a left join inside i using (id) left join near b using (id) where sound),
ok as (select *, {KEY('name')} as key, row_number() over (partition by place_id order by position) as nth, name = 'İsimsiz park' as generic from (
  select * replace (case when position % 8 = 0 then 'İsimsiz park' else name end as name) from cand) where city is not null),
one as (select * from ok where nth = 1),
tw as (select distinct a.id from one a join one b on a.id <> b.id and a.key = b.key and {NEAR} where {H('a', 'b')} <= 30),
p as (select a.id, b.id as park_id, {H('a', 'b')} as m, b.id % 5 = 0 or a.generic or a.key = {KEY('b.name')} as fits, a.generic from one a join parks b on a.city = b.city and {NEAR} where a.id not in (select id from tw) and {H('a', 'b')} <= case when a.generic then 25 else 150 end),
u as (select *, count(*) over (partition by id) as n from (select *, min(m) over (partition by id) as least from p) where least > 25 or m <= 25),
told as (
  select position, 'REJECT_NON_PARK' as outcome, null as target_id from pl where id not in (select id from ask) union all select position, 'INVALID', null from ask where not sound
  union all select position, 'PROVINCE_MISMATCH', null from cand where city is null union all select position, 'DUPLICATE_SOURCE', null from ok where nth > 1 or id in (select id from tw)
  union all select position, 'MATCHED_EXISTING', cast(park_id as varchar) from u join ok using (id) where n = 1 and fits
  union all select distinct position, 'REVIEW', null from u join ok using (id) where n > 1 or not fits
  union all select position, 'STRONG_NEW', null from one where id not in (select id from tw) and id not in (select id from u))"""
ORACLE_SQL["gap_outcomes"] = V.heads("parks", "source", "edges") + f""", {INSIDE.replace('parks p', 'source p')}, {SEGMENT.replace('parks p', 'source p')}, near as (select id, min(struct_pack(m := m, r := region)) as b from dist where raw <= 2000 group by id),
{GAP.replace('b.r)', 'b.b.r)')} select place_id as id, position, outcome, target_id from told join pl using (position)"""

ORACLE_SQL["sampled_parks"] = V.heads("parks") + """, r as (select id, city, md5(cast(id as varchar) || ':42') as h, row_number() over (partition by city order by md5(cast(id as varchar) || ':42'), id) as k from parks),
t as (select *, row_number() over (order by k > 5, h, id) as n from r) select id, city from t where k <= 5 or n <= 150"""
