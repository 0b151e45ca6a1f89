"""Activity over the registry: summaries, pages, points, ids, moderation (JN-3..8, TOP-1..6, AGG-3..5, DML-3..9, FLT-9..15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import haversine_m, in_viewport
from gridloom.functions.rules import display_name, is_unnamed, location_error, needs, park_status, place_label, source_link
from gridloom.functions.text import matches_query
from gridloom.operators.tables import fold_in_order


def _last(holds: Column, *fields: str) -> Column:
    """Fields of the latest row for which ``holds``."""
    return F.max_by(F.when(holds, F.struct(*fields)), F.when(holds, F.struct("occurred_at", "id")))


def event_summaries(events: DataFrame) -> DataFrame:
    """(park_id, records, last_food_at, food_grams, last_water_at, water_ml) over published events, in one pass. Late
    arrivals count but never replace a later state; food and water are apart."""
    shown = events.where("status = 'published'")
    found = shown.groupBy("park_id").agg(
        F.count(F.lit(1)).alias("records"),
        _last(F.col("food_grams") > 0, "occurred_at", "food_grams").alias("f"),
        _last(F.col("water_ml") > 0, "occurred_at", "water_ml").alias("w"),
    )
    return found.select("park_id", "records", F.col("f.occurred_at").alias("last_food_at"), "f.food_grams", F.col("w.occurred_at").alias("last_water_at"), "w.water_ml")


def park_summaries(parks: DataFrame, events: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """Every park with its latest food, water and observation, and its count of records."""
    out = parks.join(event_summaries(events).withColumnRenamed("park_id", "id"), "id", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    if observations is not None:
        last = observations.groupBy(F.col("park_id").alias("id")).agg(
            F.max_by(F.struct("food_status", "water_status", "observed_at"), F.struct("observed_at", "id")).alias("observation")
        )
        out = out.join(last, "id", "left")
    return out


def viewport_parks(parks: DataFrame, events: DataFrame, bounds: tuple[float, float, float, float], query: str = "", limit: int = 200) -> DataFrame:
    """The parks nearest to the viewport's centre, ties by id; a text query searches everywhere. Events are reduced to
    those parks before they are aggregated."""
    south, north, west, east = bounds
    searching = len(query.strip()) >= 2
    holds = matches_query(["name", "city", "district"], query) if searching else in_viewport("latitude", "longitude", *bounds)
    d = F.pow(F.col("latitude") - (south + north) / 2, 2) + F.pow(F.col("longitude") - (west + east) / 2, 2)
    picked = parks.where("active").where(holds).withColumn("_d", d).orderBy("_d", "id").limit(limit).drop("_d")
    few = events.join(F.broadcast(picked.select(F.col("id").alias("park_id"))), "park_id", "left_semi")
    return park_summaries(picked, few)


def nearest(df: DataFrame, lat: float, lon: float, n: int = 200) -> DataFrame:
    return df.withColumn("distance_m", haversine_m(F.lit(lat), F.lit(lon), "latitude", "longitude")).orderBy("distance_m", "id").limit(n)


def feed_page(events: DataFrame, before: tuple | None = None, park_id=None, viewer=None, size: int = 30) -> DataFrame:
    """A page by (occurred_at, id) descending; ``before``: the last key of the page before."""
    page = events.where("status = 'published'")
    if park_id is not None:
        page = page.where(F.col("park_id") == park_id)
    if viewer is not None:
        page = page.where(F.col("user_id") == viewer)
    if before is not None:
        page = page.where(F.struct("occurred_at", "id") < F.struct(F.lit(before[0]).cast("timestamp").alias("occurred_at"), F.lit(before[1]).alias("id")))
    return page.orderBy(F.desc("occurred_at"), F.desc("id")).limit(size)


def with_names(rows: DataFrame, profiles: DataFrame, default: str = "Hayvansever") -> DataFrame:
    return rows.join(profiles.select("user_id", "display_name"), "user_id", "left").withColumn("display_name", F.coalesce("display_name", F.lit(default)))


def hide_blocked(events: DataFrame, blocked: DataFrame, viewer) -> DataFrame:
    own = blocked.where(F.col("user_id") == viewer).select(F.col("blocked_id").alias("user_id"))
    return events.join(own, "user_id", "left_anti")


def visible_events(events: DataFrame, parks: DataFrame) -> DataFrame:
    """Published events of active parks."""
    return events.where("status = 'published'").join(parks.where("active").select(F.col("id").alias("park_id")), "park_id", "left_semi")


def visible_cases(cases: DataFrame, moderator: bool = False) -> DataFrame:
    """Cases that aren't resolved; hidden ones are for moderators only."""
    shown = F.lit(True) if moderator else F.col("hidden_at").isNull()
    return cases.where(shown & (F.col("status") != "resolved"))


def explore_filter(summaries: DataFrame, kind: str, favorites: DataFrame | None = None) -> DataFrame:
    """Park summaries (with last_water_at, water_status, state) of a screen filter: all, water, check, or favorites, which
    takes the viewer's (park_id)."""
    if kind == "favorites":
        return summaries.join(favorites.select(F.col("park_id").alias("id")).distinct(), "id", "left_semi")
    return summaries.where(needs(kind, "last_water_at", "water_status", "state"))


def present(parks: DataFrame) -> DataFrame:
    """Parks as shown: name, name_status, name_source, name_source_url filled in, and ``place`` (PRJ-4)."""
    missing = F.coalesce(F.col("name_status") == "missing", F.lit(False)) | is_unnamed("name")
    url = F.when(F.col("name_status") == "community", "").otherwise(source_link("osm_id", "name_source_url"))
    shown = {
        "name": F.when(missing, display_name(F.lit(""), "id")).otherwise(F.col("name")), "name_status": F.when(missing, "missing").otherwise(F.coalesce("name_status", F.lit("source"))),
        "name_source": F.coalesce(F.nullif("name_source", F.lit("")), F.lit("OpenStreetMap")), "name_source_url": url, "place": place_label("address_label", "district", "city"),
    }
    return parks.select(*(c for c in parks.columns if c not in shown), *(v.alias(k) for k, v in shown.items()))


# Label and colour of a park's state on the map, icons of cases and vets.
STATE_LABELS = {"check": ("Boş kap bildirildi", "#C17840"), "unknown": ("Kayıt bekliyor", "#7B8790"), "old": ("Kayıt güncel değil", "#B57B3A"), "recent": ("Yakın zamanda kayıt var", "#2D7660")}
UNCLAIMED, CLAIMED, VET = "🚨", "🙋", "🏥"


def map_rows(df: DataFrame, kind: str) -> DataFrame:
    """What a map needs of ``parks`` (with ``state``), ``cases`` or ``vets``, and nothing else (PRJ-7)."""
    at = ["id", "latitude", "longitude"]
    if kind == "parks":
        pick = lambda k: F.coalesce(*(F.when(F.col("state") == s, v[k]) for s, v in STATE_LABELS.items()))
        return df.select(*at, "name", pick(1).alias("color"), pick(0).alias("status"))
    icon = F.lit(VET) if kind == "vets" else F.when(F.col("status").isin("reported", "verifying"), UNCLAIMED).otherwise(CLAIMED)
    return df.select(*at, icon.alias("icon"))


def post_points(feedings: DataFrame, observations: DataFrame) -> DataFrame:
    """(user_id, source_type, source_id, points, created_at): ten a feeding, two an observation, once each."""
    def rows(df: DataFrame, kind: str, points: int, time: str) -> DataFrame:
        return df.select("user_id", F.lit(kind).alias("source_type"), F.col("id").alias("source_id"), F.lit(points).alias("points"), F.col(time).alias("created_at"))

    return rows(feedings, "feeding", 10, "occurred_at").union(rows(observations, "observation", 2, "observed_at")).dropDuplicates(["source_type", "source_id"])


def points_active(ledger: DataFrame, feedings: DataFrame) -> DataFrame:
    """Ledger rows that count: observations, and feedings while they are published."""
    shown = feedings.where("status = 'published'").select(F.col("id").alias("source_id"))
    return ledger.where("source_type = 'feeding'").join(shown, "source_id", "left_semi").unionByName(ledger.where("source_type <> 'feeding'"))


def points_of(ledger: DataFrame, users: DataFrame) -> DataFrame:
    sums = ledger.groupBy("user_id").agg(F.sum("points").alias("points"))
    return users.join(sums, "user_id", "left").select("user_id", F.coalesce("points", F.lit(0)).alias("points"))


def leaderboard(ledger: DataFrame, profiles: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The most points, ties by user; the limit is clamped to 1-100."""
    top = ledger.groupBy("user_id").agg(F.sum("points").alias("points")).orderBy(F.desc("points"), "user_id").limit(max(1, min(100, limit)))
    return top if profiles is None else with_names(top, profiles)


def newest(df: DataFrame, holds: Column, time: str, n: int) -> DataFrame:
    return df.where(holds).orderBy(F.desc(time), F.desc("id")).limit(n)


def suggestion_queue(suggestions: DataFrame, parks: DataFrame, viewer=None, park_id=None, n: int = 100) -> DataFrame:
    """Suggestions for active parks: pending first, the newest first, then by id descending. ``viewer``: only their own."""
    rows = suggestions.join(parks.where("active").select(F.col("id").alias("park_id"), F.col("name").alias("park_name")), "park_id")
    if viewer is not None:
        rows = rows.where(F.col("user_id") == viewer)
    if park_id is not None:
        rows = rows.where(F.col("park_id") == park_id)
    return rows.orderBy((F.col("status") != "pending"), F.desc("created_at"), F.desc("id")).limit(n)


def verify_location(events: DataFrame, points: DataFrame, most_m: float = 200) -> DataFrame:
    """Events with ``location_error`` against their point."""
    at = points.select(F.col("id").alias("point_id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    joined = events.join(at, "point_id", "left")
    error = F.when(F.col("_lat").isNull(), "unknown_point").otherwise(location_error("reported_latitude", "reported_longitude", "_lat", "_lon", most_m))
    return joined.withColumn("location_error", error).drop("_lat", "_lon")


def resolve_ids(ids: DataFrame, parks: DataFrame, aliases: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(id, status, survivor_id): alias, tombstone, live, inactive or not_found; lifecycle tables come first."""
    found = (
        ids.select("id").distinct()
        .join(aliases.select(F.col("retired_id").alias("id"), "survivor_id"), "id", "left")
        .join(tombstones.select(F.col("retired_id").alias("id"), F.col("kind").alias("_kind")), "id", "left")
        .join(parks.select("id", F.col("active").alias("_active")), "id", "left")
    )
    status = F.when(F.col("survivor_id").isNotNull(), "alias").when(F.col("_kind").isNotNull(), F.concat(F.lit("tombstone_"), "_kind"))
    status = status.when(F.col("_active"), "live").when(~F.col("_active"), "inactive").otherwise("not_found")
    own = F.when(F.col("_active") & F.col("_kind").isNull(), F.col("id"))
    return found.select("id", status.alias("status"), F.coalesce("survivor_id", own).alias("survivor_id"))


def favorite_view(favorites: DataFrame, resolved: DataFrame) -> DataFrame:
    """(user_id, park_id, status): a survivor once per user; retired ones stay."""
    rows = favorites.withColumnRenamed("park_id", "id").join(resolved, "id").withColumn("park_id", F.coalesce("survivor_id", "id"))
    live = F.when(F.col("survivor_id").isNotNull(), "live").otherwise("retired")
    return rows.groupBy("user_id", "park_id").agg(F.min("created_at").alias("created_at"), F.min(live).alias("status"))


def prepare_queue(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """Queued events before they are sent: live parks as they are; aliases go to the survivor, its general point with
    them (a general point has the park's id); retired parks are blocked."""
    rows = items.join(resolved.select(F.col("id").alias("park_id"), F.col("status").alias("_status"), "survivor_id"), "park_id", "left")
    moved = F.col("_status") == "alias"
    point = F.when(moved & (F.col("point_id") == F.col("park_id")), F.col("survivor_id")).otherwise(F.col("point_id"))
    action = F.when(F.col("_status") == "live", "send").when(moved, "rekeyed").otherwise("blocked")
    return rows.withColumn("point_id", point).withColumn("park_id", F.when(moved, F.col("survivor_id")).otherwise(F.col("park_id"))).withColumn("action", F.coalesce(action, F.lit("blocked"))).drop("_status", "survivor_id")


def rekey_activity(points: DataFrame, events: DataFrame, observations: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, events and observations of retired parks under their survivors. A point whose name the survivor has is
    merged into that point; others change parent."""
    moves = aliases.select(F.col("retired_id").alias("park_id"), "survivor_id")
    moved = points.join(moves, "park_id")
    # two retired parks may bring the same name: the least point id of a (park, name) stays
    kept = points.join(moves, "park_id", "left_anti").select("park_id", "name", "id")
    claims = kept.withColumn("own", F.lit(0)).union(moved.select(F.col("survivor_id").alias("park_id"), "name", "id").withColumn("own", F.lit(1)))
    winner = claims.groupBy("park_id", "name").agg(F.min(F.struct("own", "id")).alias("w")).select("park_id", "name", F.col("w.id").alias("target"))
    mapping = moved.select("id", F.col("survivor_id").alias("park_id"), "name").join(winner, ["park_id", "name"]).select("id", F.col("park_id").alias("new_park"), "target")
    new_points = points.join(mapping, "id", "left").where("target is null or target = id").withColumn("park_id", F.coalesce("new_park", "park_id")).drop("new_park", "target")
    m = mapping.select(F.col("id").alias("point_id"), "target")

    def rekeyed(df: DataFrame) -> DataFrame:
        out = df.join(m, "point_id", "left").withColumn("point_id", F.coalesce("target", "point_id")).drop("target")
        if "park_id" in df.columns:
            out = out.join(moves, "park_id", "left").withColumn("park_id", F.coalesce("survivor_id", "park_id")).drop("survivor_id")
        return out

    return new_points.select(*points.columns), rekeyed(events).select(*events.columns), rekeyed(observations).select(*observations.columns)


def rekey_favorites(favorites: DataFrame, suggestions: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Favorites merged at the survivor, the earliest kept; pending suggestions move unless the user has one there."""
    moves = aliases.select(F.col("retired_id").alias("park_id"), "survivor_id")

    def target(df: DataFrame) -> DataFrame:
        return df.join(moves, "park_id", "left").withColumn("_to", F.coalesce("survivor_id", "park_id")).drop("survivor_id")

    merged = target(favorites).groupBy("user_id", F.col("_to").alias("park_id")).agg(F.min("created_at").alias("created_at"))
    there = suggestions.where("status = 'pending'").select("user_id", F.col("park_id").alias("_to")).distinct().withColumn("_has", F.lit(True))
    rows = target(suggestions).join(there, ["user_id", "_to"], "left")
    move = (F.col("status") == "pending") & F.col("_has").isNull()
    return merged, rows.withColumn("park_id", F.when(move, F.col("_to")).otherwise(F.col("park_id"))).select(*suggestions.columns)


#: What hiding does to a target, by the report's column that names it.
HIDING = ("feeding_id", "park_id", "rescue_case_id")


def resolved_reports(reports: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reports after ``decisions`` (report_id, action: hide or dismiss, decided_at, decided_by): the first decision of an open
    report counts, and a resolved one stays as it is."""
    first = decisions.groupBy(F.col("report_id").alias("id")).agg(F.min(F.struct("decided_at", "action", "decided_by")).alias("_d"))
    takes = (F.col("status") == "open") & F.col("_d").isNotNull()
    new = {"status": F.lit("resolved"), "resolved_at": F.col("_d.decided_at"), "resolution_action": F.col("_d.action"), "resolved_by": F.col("_d.decided_by")}
    told = reports.join(first, "id", "left")
    return told.select(*(F.when(takes, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in reports.columns))


def apply_decisions(targets: DataFrame, reports: DataFrame, decisions: DataFrame, target_col: str) -> tuple[DataFrame, DataFrame]:
    """Targets and reports after moderation. A hidden feeding gets status ``hidden``, a hidden park is no longer active, and a
    hidden rescue case gets ``hidden_at`` and ``hidden_by`` of its first hiding, while its status stays. A report names one
    target; dismissing changes nothing but the report."""
    if target_col not in HIDING:
        raise ValueError(f"{target_col} is no target of reports")
    first = decisions.groupBy(F.col("report_id").alias("id")).agg(F.min(F.struct("decided_at", "action", "decided_by")).alias("_d"))
    hides = reports.where("status = 'open'").join(first.where("_d.action = 'hide'"), "id")
    hides = hides.groupBy(F.col(target_col).alias("id")).agg(F.min(F.struct("_d.decided_at", "_d.decided_by")).alias("_h"))
    hit = F.col("_h").isNotNull()
    new = {
        "feeding_id": {"status": F.when(hit, "hidden").otherwise(F.col("status") if "status" in targets.columns else F.lit(None))},
        "park_id": {"active": ~hit & F.col("active") if "active" in targets.columns else F.lit(None)},
        "rescue_case_id": {c: F.when(F.col("hidden_at").isNull(), F.col(f"_h.{v}")).otherwise(F.col(c)) for c, v in (("hidden_at", "decided_at"), ("hidden_by", "decided_by")) if c in targets.columns},
    }[target_col]
    told = targets.join(hides, "id", "left").select(*(new[c].alias(c) if c in new else F.col(c) for c in targets.columns))
    return told, resolved_reports(reports, decisions)


REVIEWED = "id string, park_id string, outcome string, name string, note string, reviewer_id string, at timestamp"


def name_decisions(suggestions: DataFrame, parks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, park_id, outcome, ...) of every decision (id, at, accept, note, reviewer_id), a park's in order of (at, id):
    approved, rejected, or why it is refused: note, park, reviewed, own, renamed. An approval renames the park at once, so
    one of two for the same name is refused."""
    seen = suggestions.select("id", "park_id", "user_id", "original_name", "proposed_name", "status")
    rows = decisions.select("id", "at", "accept", F.trim("note").alias("note"), "reviewer_id").join(seen, "id")
    rows = rows.join(parks.select(F.col("id").alias("park_id"), F.col("name").alias("now"), "active"), "park_id", "left")

    def step(state, r):
        name, done = state or (r["now"], set())
        outcome = "approved" if r["accept"] else "rejected"
        if r["accept"] is None or not 10 <= len(r["note"] or "") <= 600:
            outcome = "note"
        elif not r["active"]:
            outcome = "park"
        elif r["status"] != "pending" or r["id"] in done:
            outcome = "reviewed"
        elif r["user_id"] == r["reviewer_id"]:
            outcome = "own"
        elif r["accept"] and name != r["original_name"]:
            outcome = "renamed"
        if outcome in ("approved", "rejected"):
            done.add(r["id"])
            name = r["proposed_name"] if r["accept"] else name
        return (name, done), {"id": r["id"], "park_id": r["park_id"], "outcome": outcome, "name": r["proposed_name"], "note": r["note"], "reviewer_id": r["reviewer_id"], "at": r["at"]}

    return fold_in_order(rows, ["park_id"], ["at", "id"], step, REVIEWED)


def apply_name_reviews(suggestions: DataFrame, parks: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suggestions and parks after ``name_decisions`` (stored by the caller): refused decisions change nothing."""
    took = decided.where("outcome in ('approved', 'rejected')").select("id", F.col("outcome").alias("_o"), F.col("note").alias("_n"), F.col("reviewer_id").alias("_r"), F.col("at").alias("_at"))
    new = {"status": "_o", "review_note": "_n", "reviewed_by": "_r", "reviewed_at": "_at"}
    rows = suggestions.join(took, "id", "left")
    told = rows.select(*(F.coalesce(F.col(new[c]), F.col(c)).alias(c) if c in new else F.col(c) for c in suggestions.columns))
    names = decided.where("outcome = 'approved'").groupBy(F.col("park_id").alias("id")).agg(F.max_by("name", F.struct("at", "id")).alias("_name"))
    # What a reviewed name's source is called.
    fresh = {"name": F.col("_name"), "name_status": F.lit("community"), "name_source": F.lit("Topluluk incelemesi"), "name_source_url": F.lit("")}
    renamed = parks.join(names, "id", "left").select(*(F.when(F.col("_name").isNotNull(), fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in parks.columns))
    return told, renamed


# The states of a case in the order of its steps; the first two have no volunteer yet.
CASE_STATES = ["reported", "verifying", "claimed", "en_route", "at_vet", "treating", "resolved"]


def case_step(state: tuple, c: dict) -> tuple[tuple, bool]:
    """(status, volunteer, vet) after a command, and whether it was taken. A claim takes a case without a volunteer at its
    status; steps go one by one, by the volunteer or a moderator; a vet comes with the step to the vet only and must be
    active. A repeat of what is done is taken and changes nothing."""
    status, volunteer, vet = state
    if c["hidden"]:
        return state, False
    own = volunteer is not None and volunteer == c["actor"]
    if c["kind"] == "claim":
        if volunteer is None and status in CASE_STATES[:-1]:
            return ("claimed" if status in CASE_STATES[:2] else status, c["actor"], vet), True
        return state, own and status in CASE_STATES[2:-1]
    if c["kind"] != "advance" or c["target"] not in CASE_STATES[3:] or (c["vet_id"] is not None and c["target"] != "at_vet"):
        return state, False
    allowed = own or bool(c["moderator"])
    if allowed and status == CASE_STATES[CASE_STATES.index(c["target"]) - 1]:
        if c["vet_id"] is not None and not c["vet_active"]:
            return state, False
        return (c["target"], volunteer, c["vet_id"] if c["vet_id"] is not None else vet), True
    return state, allowed and status == c["target"]


def fold_cases(cases: DataFrame, commands: DataFrame, vets: DataFrame) -> DataFrame:
    """(id, status, assigned_volunteer_id, assigned_vet_id, refused) of every case after its commands (case_id, at, seq,
    kind, actor, moderator, target, vet_id) in order of (at, seq); ids are strings. Hidden cases take none."""
    start = cases.select(F.col("id").alias("case_id"), "status", "assigned_volunteer_id", "assigned_vet_id", F.col("hidden_at").isNotNull().alias("hidden"))
    known = vets.where("active").select(F.col("id").alias("vet_id")).distinct().withColumn("vet_active", F.lit(True))
    rows = commands.join(start, "case_id").join(known, "vet_id", "left")

    def step(state, r):
        state, taken = case_step(state or (r["status"], r["assigned_volunteer_id"], r["assigned_vet_id"]), r)
        return state, {"case_id": r["case_id"], "at": r["at"], "seq": r["seq"], "status": state[0], "volunteer": state[1], "vet": state[2], "taken": taken}

    kinds = dict(commands.dtypes)
    told = fold_in_order(rows, ["case_id"], ["at", "seq"], step, f"case_id string, at {kinds['at']}, seq {kinds['seq']}, status string, volunteer string, vet string, taken boolean")
    last = told.groupBy(F.col("case_id").alias("id")).agg(F.max_by(F.struct("status", "volunteer", "vet"), F.struct("at", "seq")).alias("l"), F.count_if(~F.col("taken")).alias("refused"))
    done = F.col("l").isNotNull()
    return cases.join(last, "id", "left").select(
        "id", F.when(done, F.col("l.status")).otherwise(F.col("status")).alias("status"), F.when(done, F.col("l.volunteer")).otherwise(F.col("assigned_volunteer_id")).alias("assigned_volunteer_id"),
        F.when(done, F.col("l.vet")).otherwise(F.col("assigned_vet_id")).alias("assigned_vet_id"), F.coalesce("refused", F.lit(0)).alias("refused"),
    )


def summary_status(summaries: DataFrame, now: Column) -> DataFrame:
    """Park summaries with food_status, water_status, observed_at and ``state`` (PRJ-5)."""
    o = lambda c, t: F.col(f"observation.{c}") if "observation" in summaries.columns else F.lit(None).cast(t)
    rows = summaries.withColumn("food_status", F.coalesce(o("food_status", "string"), F.lit("unknown"))).withColumn("water_status", F.coalesce(o("water_status", "string"), F.lit("unknown"))).withColumn("observed_at", o("observed_at", "timestamp"))
    return rows.withColumn("state", park_status("last_food_at", "food_status", "water_status", "observed_at", now)).drop("observation")
