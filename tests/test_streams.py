import datetime as dt
import random

from pyspark.sql import functions as F

from gridloom.operators.activity import event_summaries
from gridloom.operators import activity as A
from gridloom.streaming import events as E
from gridloom.streaming import ordered as O
from gridloom.streaming.store import Store

T0 = dt.datetime(2026, 9, 1)
KIND = "id string, user_id string, point_id string, park_id string, food_grams int, water_ml int, occurred_at timestamp, received_at timestamp, status string"


def rows(n=60, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + dt.timedelta(minutes=r.randrange(600))
        out.append((str(i), f"u{r.randrange(3)}", f"p{r.randrange(4)}", f"k{r.randrange(3)}", r.randrange(2) * 50, r.randrange(2) * 100, at, at + dt.timedelta(minutes=1), "published"))
    return out


def stream(spark, path, batches, kind=KIND):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(spark.createDataFrame([], kind).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def settle(q):
    """Waits for the end; a query with timers goes on with batches without input, so it is stopped at the first of them."""
    for _ in range(240):
        if q.awaitTermination(0.5):
            return
        if q.recentProgress and q.recentProgress[-1]["numInputRows"] == 0:
            break
    q.stop()


def finish(df, name, mode="append"):
    settle(df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start())
    return df.sparkSession.table(name).collect()


def by_hand(events, per_day, per_hour, cooldown):
    taken, out = {}, {}
    for at, i, user, point in sorted(events):
        mine = [(t, p) for t, p in taken.get(user, []) if t > at - 86400]
        if len(mine) >= per_day:
            out[i] = "day_limit"
        elif len([t for t, _ in mine if t > at - 3600]) >= per_hour:
            out[i] = "hour_limit"
        elif [1 for t, p in mine if p == point and t > at - cooldown]:
            out[i] = "cooldown"
        else:
            out[i] = None
            taken.setdefault(user, []).append((at, point))
    return out


def test_rate_limits_batch_and_stream(spark, tmp_path):
    data = sorted(rows(80), key=lambda r: (r[6], r[0]))
    want = by_hand([(r[6].replace(tzinfo=dt.timezone.utc).timestamp(), r[0], r[1], r[2]) for r in data], 12, 4, 1800)
    df = spark.createDataFrame(data, KIND).withColumn("at", F.col("occurred_at"))
    assert {r["id"]: r["reason"] for r in E.rate_limited_batch(df, 12, 4, 1800).collect()} == want
    # any arrival order within the watermark; a last row moves it past all others
    random.Random(4).shuffle(data)
    end = ("end", "nobody", *data[0][2:6], T0 + dt.timedelta(days=9), T0, "published")
    behind = ("behind", "u1", "p1", *data[0][3:6], T0, T0, "published")
    s = stream(spark, str(tmp_path), [data[:30], data[30:55], data[55:], [end], [behind]]).withColumn("at", F.col("occurred_at"))
    told = {r["id"]: r["reason"] for r in finish(O.rate_limited(s, 12, 4, 1800, "1 day"), "limits")}
    assert told == want | {"behind": "late"}


def test_rate_limits_go_on_after_a_restart(spark, tmp_path):
    data = rows(60, 3)
    want = by_hand([(r[6].replace(tzinfo=dt.timezone.utc).timestamp(), r[0], r[1], r[2]) for r in data], 6, 3, 1800)
    end = ("end", "nobody", *data[0][2:6], T0 + dt.timedelta(days=9), T0, "published")
    for batches in ([data[:20], data[20:40]], [data[40:], [end]]):
        s = stream(spark, str(tmp_path), batches).withColumn("at", F.col("occurred_at"))
        q = O.rate_limited(s, 6, 3, 1800, "1 day").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        settle(q.trigger(availableNow=True).start(str(tmp_path / "out")))
    told = [(r["id"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(told) == len(set(told)) and dict(told) == want


def test_deliveries_tell_repeats_conflicts_and_late_rows(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    kind = "id string, user_id string, received_at timestamp"
    batches = [
        [("1", "a", at(0)), ("2", "a", at(1)), ("2", "a", at(2))], [("1", "a", at(30)), ("2", "b", at(31)), ("3", "b", at(31))], [("9", "z", at(600))],
        [("1", "a", at(20)), ("3", "c", at(601)), ("4", "d", at(40)), ("5", "e", at(602))], [("9", "z", at(60 * 24 * 4))], [("1", "a", at(60 * 24 * 4 + 1)), ("2", "b", at(61))],
    ]
    told = finish(O.deliveries(stream(spark, str(tmp_path), batches, kind), delay="1 hour", keep_days=2), "deliveries")
    micros = lambda m: int(at(m).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert {(r["id"], r["user_id"], r["us"]): r["delivery"] for r in told} == {
        ("1", "a", micros(0)): "accepted", ("2", "a", micros(1)): "accepted", ("2", "a", micros(2)): "repeat", ("1", "a", micros(30)): "repeat", ("2", "b", micros(31)): "conflict",
        ("3", "b", micros(31)): "accepted", ("9", "z", micros(600)): "accepted", ("1", "a", micros(20)): "late_repeat", ("3", "c", micros(601)): "conflict", ("4", "d", micros(40)): "late",
        ("5", "e", micros(602)): "accepted", ("9", "z", micros(60 * 24 * 4)): "repeat", ("1", "a", micros(60 * 24 * 4 + 1)): "accepted", ("2", "b", micros(61)): "late",
    }


def test_case_stream_ends_as_the_batch_fold(spark, tmp_path):
    r = random.Random(8)
    cases = spark.createDataFrame([(f"c{i}", A.CASE_STATES[i % 3], None, None, T0 if i == 4 else None) for i in range(6)], "id string, status string, assigned_volunteer_id string, assigned_vet_id string, hidden_at timestamp")
    vets = spark.createDataFrame([("x1", True), ("x2", False)], "id string, active boolean")
    kind = "case_id string, at timestamp, seq bigint, kind string, actor string, moderator boolean, target string, vet_id string"
    log = []
    for k in range(200):
        claim = r.random() < 0.3
        log.append((f"c{r.randrange(6)}", T0 + dt.timedelta(minutes=r.randrange(120)), k, "claim" if claim else "advance", f"v{r.randrange(2)}", r.random() < 0.3, None if claim else r.choice(A.CASE_STATES[3:]), r.choice([None, None, "x1", "x2"])))
    want = A.fold_cases(cases, spark.createDataFrame(log, kind), vets).drop("refused")
    end = ("c9", T0 + dt.timedelta(days=9), 999, "claim", "v0", False, None, None)
    s = stream(spark, str(tmp_path), [log[:70], log[70:150], log[150:], [end]], kind)
    told = O.case_stream(s, cases, vets, "1 day")
    finish(told, "cases")
    assert sorted(map(tuple, O.case_states(spark.table("cases")).collect())) == sorted(tuple(x) for x in want.collect() if x["id"] in {c[0] for c in log})
    assert spark.table("cases").where("late").count() == 0


def test_store_is_bounded_and_replays(spark, tmp_path):
    r = random.Random(9)
    store = Store(spark, str(tmp_path / "s"), "park_id", "id", "n", buckets=3, most=4)
    kind, latest = "id string, park_id string, n int", {}
    for number in range(14):
        batch = [(f"e{r.randrange(30)}", None, number) for _ in range(4)]
        batch = [(i, f"k{i[-1]}", n) for i, _, n in batch]
        for _ in range(2 if number % 5 == 4 else 1):  # some batches come twice
            manifest, touched = store.add(spark.createDataFrame(batch, kind), number)
            assert touched and max(map(len, manifest.values())) <= 4
            if number == 8:
                assert store.manifest() != manifest  # not seen before the commit
            store.commit(manifest, number)
        latest |= {i: n for i, _, n in batch}
    assert {x["id"]: x["n"] for x in store.read().collect()} == latest
    found = [f for f in (tmp_path / "s" / "rows").rglob("*.parquet")]
    assert len(found) <= 2 * 3 * 4  # of two manifests
    assert len(list((tmp_path / "s" / "manifest").iterdir())) == 2


def test_a_hot_user_is_cut_at_gaps(spark):
    r = random.Random(5)
    hot = [T0 + dt.timedelta(days=3 * k, minutes=r.randrange(2000)) for k in range(12) for _ in range(40)]
    exact = [T0 + dt.timedelta(days=k, microseconds=k // 3) for k in range(6)]  # gaps of 24 hours and of a microsecond more
    data = [(str(i), u, f"p{r.randrange(2)}", at) for i, (u, at) in enumerate([("hot", t) for t in hot] + [("exact", t) for t in exact] + [(None, t) for t in exact])]
    df = spark.createDataFrame(data, "id string, user_id string, point_id string, at timestamp")
    want = by_hand([(at.replace(tzinfo=dt.timezone.utc).timestamp(), i, u, p) for i, u, p, at in data], 12, 4, 1800)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = E.rate_limited_batch(df, 12, 4, 1800).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(data) and {x["id"]: x["reason"] for x in got} == want
    assert len({x["task"] for x in got if x["user_id"] == "hot"}) > 1


def test_repeats_and_bounds(spark, tmp_path):
    data = rows(10)
    late = ("99", "u1", "p1", "k1", 50, 0, T0 - dt.timedelta(days=100), T0, "published")
    early = ("98", "u1", "p1", "k1", 50, 0, T0 + dt.timedelta(days=1), T0, "published")
    s = stream(spark, str(tmp_path), [data + [late, early], data[:5]])
    assert sorted(r["id"] for r in finish(E.dedupe_stream(E.time_bounds(s)), "repeats")) == sorted(r[0] for r in data)
    df = spark.createDataFrame(data + [("0", "other", *data[0][2:])], KIND)
    assert [r["id"] for r in E.conflicting_deliveries(df).collect()] == ["0"]


def test_latest_state_equals_batch(spark, tmp_path):
    data = rows(50)
    random.Random(2).shuffle(data)
    found = finish(E.latest_state(stream(spark, str(tmp_path), [data[:25], data[25:]])), "state", "complete")
    assert sorted(map(str, found)) == sorted(map(str, event_summaries(spark.createDataFrame(data, KIND)).collect()))


def test_live_summaries_drop_hidden_events(spark, tmp_path):
    data = rows(20)
    hidden = [(*data[0][:7], data[0][7] + dt.timedelta(hours=1), "hidden")]
    s = stream(spark, str(tmp_path), [data, hidden])
    q = E.live_summaries(s, str(tmp_path / "store"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    settle(q)
    found = E.current_summaries(spark, str(tmp_path / "store"))
    want = event_summaries(spark.createDataFrame(data[1:] + hidden, KIND))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_validation_and_points(spark, tmp_path):
    kind = KIND + ", food_type string, note string, photo_path string, reported_latitude double, reported_longitude double"
    ok = [(*r[:4], 50, *r[5:], "dry", None, f"{r[1]}/{r[0]}.jpg", 41.0, 29.0) for r in rows(4)]
    bad = [(*ok[0][:-2], 42.0, 29.0), (*ok[1][:9], "cake", *ok[1][10:])]
    points = spark.createDataFrame([(f"p{i}", 41.0, 29.0) for i in range(4)], "id string, latitude double, longitude double")
    found = finish(E.validated_stream(stream(spark, str(tmp_path), [ok, bad], kind), points), "valid")
    assert sorted(str(r["error"]) for r in found) == ["None"] * 4 + ["food_type", "too_far"]
    ledger = stream(spark, str(tmp_path / "l"), [[("a", 10), ("b", 2)], [("a", -10), ("b", 10)]], "user_id string, points int")
    assert dict(map(tuple, finish(E.live_points(ledger), "board", "complete"))) == {"a": 0, "b": 12}


def test_leaderboard_takes_back_hidden_events(spark, tmp_path):
    kind = "id string, user_id string, status string, received_at timestamp"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    first = [("1", "a", "published", at(0)), ("2", "a", "published", at(1)), ("3", "b", "published", at(2)), ("3", "b", "published", at(2)), ("4", "c", "hidden", at(3))]
    then = [("2", "a", "hidden", at(9)), ("3", "b", "published", at(8)), ("1", "a", "hidden", at(-5)), ("5", "b", "published", at(9)), ("4", "c", "published", at(9)), ("4", "c", "deleted", at(10))]
    q = E.live_leaderboard(stream(spark, str(tmp_path), [first, then], kind), str(tmp_path / "store"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    settle(q)
    assert [tuple(r) for r in E.current_leaderboard(spark, str(tmp_path / "store")).collect()] == [("b", 20), ("a", 10)]
