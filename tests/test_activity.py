import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.rules import feeding_error, name_proposal_error, park_status
from gridloom.operators import activity as A
from gridloom.operators import tables as T

NOW = dt.datetime(2026, 9, 1, 12)
AT = dt.datetime(2026, 9, 1, 12)
FEED = "id string, user_id string, food_type string, food_grams double, water_ml double, note string, photo_path string, occurred_at timestamp"


FEEDINGS = [
    (100.0, 0.0, True, -1, None), (0.0, 250.0, True, -1, None), (0.0, 0.0, True, -1, "nothing_given"), (1.5, 0.0, True, -1, "food_grams"), (-1.0, 0.0, True, -1, "food_grams"),
    (float("nan"), 0.0, True, -1, "food_grams"), (10.0, 0.0, False, -1, "photo_path"), (10.0, 0.0, True, 1, "in_the_future"), (10.0, 0.0, True, -24 * 91, "too_old"),
]


def test_feeding_rules(spark):
    rows = [("e", "u", "dry", food, water, None, "u/e.jpg" if photo else None, NOW + dt.timedelta(hours=hours)) for food, water, photo, hours, _ in FEEDINGS]
    assert [r[0] for r in spark.createDataFrame(rows, FEED).coalesce(1).select(feeding_error(F.lit(AT))).collect()] == [e for *_, e in FEEDINGS]


def test_status(spark):
    ago = lambda **k: NOW - dt.timedelta(**k)
    rows = [
        (None, None, None, None, "unknown"), (ago(days=8), None, None, None, "old"), (NOW, "empty", "full", ago(hours=1), "check"), (NOW, "full", "empty", ago(hours=1), "check"),
        (NOW, "empty", "empty", ago(hours=24), "recent"), (ago(days=7), "full", "full", NOW, "recent"), (None, "full", "unknown", NOW, "unknown"),
    ]
    df = spark.createDataFrame(rows, "fed timestamp, food string, water string, at timestamp, want string").coalesce(1)
    assert [r[0] for r in df.select(park_status("fed", "food", "water", "at", F.lit(AT))).collect()] == [r[-1] for r in rows]


def test_screen_filters(spark):
    df = spark.createDataFrame([("a", None, "full", "recent"), ("b", NOW, "empty", "old"), ("c", NOW, None, "unknown"), ("d", NOW, "full", "check")], "id string, last_water_at timestamp, water_status string, state string")
    fav = spark.createDataFrame([("c",), ("c",)], "park_id string")
    found = {k: sorted(r["id"] for r in A.explore_filter(df, k, fav).collect()) for k in ("all", "water", "check", "favorites")}
    assert found == {"all": ["a", "b", "c", "d"], "water": ["a", "b"], "check": ["b", "c", "d"], "favorites": ["c"]}


def test_late_event_counts_but_does_not_replace(spark):
    e = [("1", "p", 50, 0, NOW), ("2", "p", 70, 0, NOW - dt.timedelta(days=1)), ("3", "p", 0, 200, NOW + dt.timedelta(hours=1))]
    df = spark.createDataFrame(e, "id string, park_id string, food_grams int, water_ml int, occurred_at timestamp").withColumn("status", F.lit("published"))
    r = A.event_summaries(df).first()
    assert (r["records"], r["food_grams"], r["water_ml"]) == (3, 50, 200)


def test_paging_skips_nothing_on_equal_times(spark):
    df = spark.range(70).select(F.col("id"), F.lit("u").alias("user_id"), F.lit("p").alias("park_id"), F.lit(NOW).alias("occurred_at"), F.lit("published").alias("status"))
    seen, before = [], None
    while page := A.feed_page(df, before).collect():
        seen += [r["id"] for r in page]
        before = (page[-1]["occurred_at"], page[-1]["id"])
    assert seen == list(range(69, -1, -1))


def test_leaderboard_clamp_and_ties(spark):
    df = spark.range(150).select(F.col("id").alias("user_id"), (F.col("id") % 3).alias("points"))
    assert A.leaderboard(df, limit=1000).count() == 100
    assert [r["user_id"] for r in A.leaderboard(df, limit=2).collect()] == [2, 5]
    assert A.leaderboard(df, limit=0).count() == 1


def test_location_check(spark):
    e = spark.createDataFrame([("a", "p", None, None), ("b", "p", 95.0, 29.0), ("c", "p", 41.01, 29.0), ("d", "p", 41.001, 29.0), ("e", "q", 41.0, 29.0)], "id string, point_id string, reported_latitude double, reported_longitude double")
    p = spark.createDataFrame([("p", 41.0, 29.0)], "id string, latitude double, longitude double")
    found = {r["id"]: r["location_error"] for r in A.verify_location(e, p).collect()}
    assert found == {"a": "location_missing", "b": "location_invalid", "c": "too_far", "d": None, "e": "unknown_point"}


def test_name_proposals(spark):
    rows = [("Gazi Parkı", "Park", "a good sign there"), ("12", "Park", "a good sign there"), ("123", "Park", "a good sign there"), ("http://x.yz", "Park", "a good sign there"), ("PARK  ALANI", "x", "a good sign there"), ("Gazi Park", "gazi park", "a good sign there"), ("Gazi Parkı", "Park", "short")]
    df = spark.createDataFrame(rows, "p string, c string, e string")
    assert [r[0] for r in df.select(name_proposal_error("p", "c", "e")).collect()] == [None, "length", "no_letter", "forbidden_text", "generic", "unchanged", "evidence"]


def test_resolve_and_favorites_and_queue(spark):
    parks = spark.createDataFrame([("live", True), ("off", False)], "id string, active boolean")
    aliases = spark.createDataFrame([("old", "live")], "retired_id string, survivor_id string")
    tombs = spark.createDataFrame([("gone", "non_park")], "retired_id string, kind string")
    ids = spark.createDataFrame([("live",), ("off",), ("old",), ("gone",), ("what",)], "id string")
    r = A.resolve_ids(ids, parks, aliases, tombs)
    found = {x["id"]: (x["status"], x["survivor_id"]) for x in r.collect()}
    assert found == {"live": ("live", "live"), "off": ("inactive", None), "old": ("alias", "live"), "gone": ("tombstone_non_park", None), "what": ("not_found", None)}
    fav = spark.createDataFrame([("u", "old", 2), ("u", "live", 1), ("u", "gone", 3)], "user_id string, park_id string, created_at int")
    assert {tuple(x) for x in A.favorite_view(fav, r).collect()} == {("u", "live", 1, "live"), ("u", "gone", 3, "retired")}
    items = spark.createDataFrame([("1", "live", "x"), ("2", "old", "old"), ("3", "old", "custom"), ("4", "gone", "gone"), ("5", "nope", "n")], "id string, park_id string, point_id string")
    q = {x["id"]: (x["park_id"], x["point_id"], x["action"]) for x in A.prepare_queue(items, r).collect()}
    assert q == {"1": ("live", "x", "send"), "2": ("live", "live", "rekeyed"), "3": ("live", "custom", "rekeyed"), "4": ("gone", "gone", "blocked"), "5": ("nope", "n", "blocked")}


def test_rekey_activity(spark):
    points = spark.createDataFrame([("live", "live", "Genel"), ("old", "old", "Genel"), ("c", "old", "Kapı")], "id string, park_id string, name string")
    events = spark.createDataFrame([("1", "old", "old"), ("2", "c", "old")], "id string, point_id string, park_id string")
    obs = spark.createDataFrame([("3", "old")], "id string, point_id string")
    aliases = spark.createDataFrame([("old", "live")], "retired_id string, survivor_id string")
    p, e, o = A.rekey_activity(points, events, obs, aliases)
    assert {tuple(r) for r in p.collect()} == {("live", "live", "Genel"), ("c", "live", "Kapı")}
    assert {tuple(r) for r in e.collect()} == {("1", "live", "live"), ("2", "c", "live")}
    assert [tuple(r) for r in o.collect()] == [("3", "live")]


def test_moderation(spark):
    kind = "id string, {0} string, status string, resolved_at int, resolution_action string, resolved_by string"
    said = [("r1", "hide", 5, "m1"), ("r1", "dismiss", 6, "m2"), ("r2", "hide", 7, "m2"), ("r3", "hide", 4, "m9"), ("r4", "dismiss", 1, "m1"), ("r4", "hide", 2, "m1")]
    decisions = spark.createDataFrame(said, "report_id string, action string, decided_at int, decided_by string")

    def after(column, targets):
        reports = spark.createDataFrame([("r1", "e1", "open", None, None, None), ("r2", "e1", "open", None, None, None), ("r3", "e2", "resolved", 3, "dismiss", "m0"), ("r4", "e3", "open", None, None, None), ("r5", "e4", "open", None, None, None)], kind.format(column))
        t, r = A.apply_decisions(targets, reports, decisions, column)
        assert {(x["id"], x["status"], x["resolved_at"], x["resolution_action"], x["resolved_by"]) for x in r.collect()} == {
            ("r1", "resolved", 5, "hide", "m1"), ("r2", "resolved", 7, "hide", "m2"), ("r3", "resolved", 3, "dismiss", "m0"), ("r4", "resolved", 1, "dismiss", "m1"), ("r5", "open", None, None, None),
        }
        return {tuple(x) for x in t.collect()}

    feedings = spark.createDataFrame([("e1", "published"), ("e2", "published"), ("e3", "deleted")], "id string, status string")
    assert after("feeding_id", feedings) == {("e1", "hidden"), ("e2", "published"), ("e3", "deleted")}
    assert after("park_id", spark.createDataFrame([("e1", True), ("e2", True), ("e3", False)], "id string, active boolean")) == {("e1", False), ("e2", True), ("e3", False)}
    cases = spark.createDataFrame([("e1", "claimed", None, None), ("e2", "reported", 1, "m5"), ("e3", "reported", None, None)], "id string, status string, hidden_at int, hidden_by string")
    assert after("rescue_case_id", cases) == {("e1", "claimed", 5, "m1"), ("e2", "reported", 1, "m5"), ("e3", "reported", None, None)}
    with pytest.raises(ValueError):
        A.apply_decisions(feedings, feedings, decisions, "user_id")


def test_name_reviews(spark):
    kind = "id string, park_id string, user_id string, original_name string, proposed_name string, status string, review_note string, reviewed_by string"
    s = spark.createDataFrame([(*r, "pending", "", None) for r in [("s1", "p1", "a", "Park", "Gazi"), ("s2", "p2", "a", "Old", "New"), ("s3", "p1", "b", "Park", "X"), ("s4", "p1", "c", "Gazi", "Gazi II"), ("s5", "p3", "a", "Off", "On"), ("s6", "p2", "a", "Old", "No")]], kind)
    p = spark.createDataFrame([("p1", "Park", "missing", True), ("p2", "Changed", "source", True), ("p3", "Off", "source", False)], "id string, name string, name_status string, active boolean")
    said = [("s1", 1, True, "m"), ("s3", 2, True, "m"), ("s4", 3, True, "m"), ("s1", 4, False, "m"), ("s2", 1, True, "m"), ("s5", 1, True, "m"), ("s6", 1, True, "a"), ("s6", 2, False, "m"), ("s6", 0, True, "m")]
    d = spark.createDataFrame([(i, NOW + dt.timedelta(minutes=m), ok, "" if m == 0 else " seen on site ", who) for i, m, ok, who in said], "id string, at timestamp, accept boolean, note string, reviewer_id string")
    decided = A.name_decisions(s, p, d).cache()
    assert {(r["id"], r["outcome"]) for r in decided.collect()} == {("s1", "approved"), ("s3", "renamed"), ("s4", "approved"), ("s1", "reviewed"), ("s2", "renamed"), ("s5", "park"), ("s6", "own"), ("s6", "rejected"), ("s6", "note")}
    found, parks = A.apply_name_reviews(s, p, decided)
    assert {(r["id"], r["status"], r["review_note"], r["reviewed_by"]) for r in found.collect() if r["status"] != "pending"} == {("s1", "approved", "seen on site", "m"), ("s4", "approved", "seen on site", "m"), ("s6", "rejected", "seen on site", "m")}
    assert {tuple(r) for r in parks.collect()} == {("p1", "Gazi II", "community", True), ("p2", "Changed", "source", True), ("p3", "Off", "source", False)}


def test_cases(spark):
    """The first claimant wins, repeats are taken, an orphan keeps its status, steps don't skip, hidden cases take none."""
    cases = [("c1", "reported", None, None), ("c2", "verifying", None, None), ("c3", "resolved", "v", None), ("c4", "at_vet", None, None), ("c5", "reported", None, NOW), ("c6", "en_route", "v", None), ("c7", "claimed", "w", None)]
    steps = [
        ("c1", "claim", "v"), ("c1", "claim", "w"), ("c1", "claim", "v"), ("c1", "advance", "v", "at_vet"), ("c1", "advance", "w", "en_route"), ("c1", "advance", "v", "en_route"), ("c1", "advance", "v", "en_route"),
        ("c1", "advance", "v", "at_vet", "x"), ("c1", "advance", "v", "at_vet", "y"), ("c1", "advance", "v", "treating", "x"), ("c1", "advance", "m", "treating"), ("c1", "advance", "v", "resolved"), ("c1", "claim", "v"),
        ("c2", "claim", "v"), ("c2", "advance", "v", "claimed"), ("c3", "claim", "v"), ("c4", "claim", "w"), ("c5", "claim", "v"), ("c6", "claim", "w"), ("c6", "advance", "v", "at_vet", "off"), ("c6", "advance", "v", "resolved"),
    ]
    log = [(c, 0, i, k, a, a == "m", *(rest + [None, None])[:2]) for i, (c, k, a, *rest) in enumerate(steps)]
    vets = spark.createDataFrame([("x", True), ("y", True), ("off", False)], "id string, active boolean")
    df = spark.createDataFrame([(i, st, v, None, h) for i, st, v, h in cases], "id string, status string, assigned_volunteer_id string, assigned_vet_id string, hidden_at timestamp")
    commands = spark.createDataFrame(log, "case_id string, at int, seq int, kind string, actor string, moderator boolean, target string, vet_id string")
    found = {r["id"]: tuple(r)[1:] for r in A.fold_cases(df, commands, vets).collect()}
    assert found == {
        "c1": ("resolved", "v", "x", 5), "c2": ("claimed", "v", None, 1), "c3": ("resolved", "v", None, 1), "c4": ("at_vet", "w", None, 0), "c5": ("reported", None, None, 1), "c6": ("en_route", "v", None, 3), "c7": ("claimed", "w", None, 0),
    }


def test_windows(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), (None, 3, "x"), ("z", 4, None)], "id string, pos int, g string")
    found = {r["pos"]: r["reject"] for r in T.first_valid_by_id(df, "id", "pos", F.col("g").isNotNull()).collect()}
    assert found == {1: None, 2: "duplicate_id", 3: "missing_id", 4: "invalid_geometry"}
    bad_first = spark.createDataFrame([("k", 1, None), ("k", 2, "x")], "id string, pos int, g string")
    assert {r["pos"]: r["reject"] for r in T.first_valid_by_id(bad_first, "id", "pos", F.col("g").isNotNull()).collect()} == {1: "invalid_geometry", 2: None}


def test_audits_of_a_hot_user_equal_the_window_form(spark):
    from pyspark.sql import Window

    from gridloom.operators import tables as T

    r = random.Random(6)
    at = lambda m: NOW + dt.timedelta(seconds=m)
    rows = [(i, "hot" if i % 3 == 0 else r.choice(["a", "b", None]), r.choice(["p", "q", None]), at(r.randrange(40_000) * 30)) for i in range(900)]
    rows += [(1000, "hot", "p", None), (1001, "hot", "p", None), (1002, "edge", "p", at(0)), (1003, "edge", "p", at(86_400)), (1004, "edge", "p", at(86_401)), (1005, "edge", "p", at(600)), (1006, "edge", "p", at(600))]
    df = spark.createDataFrame(rows, "id int, user string, point string, at timestamp")
    stamp = F.unix_micros("at")
    w = Window.partitionBy("user").orderBy(stamp).rangeBetween(-86_400_000_000, 0)
    want = {x["id"]: x["n"] for x in df.withColumn("n", F.count(F.lit(1)).over(w)).collect()}
    for slice_s in (900, 6 * 3600, 10**9):
        got = T.trailing_count_audit(df, ["user"], "at", 86_400, 20, slice_s).collect()
        assert {x["id"]: x["in_window"] for x in got} == want and len(got) == len(rows)
        assert all(x["over_limit"] == (x["in_window"] > 20) for x in got)
        v = Window.partitionBy("user", "point").orderBy("at")
        soon = lambda d: sorted((x["user"] or "", x["point"] or "", x["at"] or NOW, x["s"]) for x in d.collect())
        plain = df.withColumn("s", F.coalesce(F.col("at") < F.lag("at").over(v) + F.expr("interval 30 minutes"), F.lit(False)))
        assert soon(T.cooldown_audit(df, ["user", "point"], "at", 30, slice_s).withColumnRenamed("too_soon", "s")) == soon(plain)
