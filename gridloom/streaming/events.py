"""Event rules as Structured Streaming (STM-*). Event time is ``occurred_at``, arrival time ``received_at``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.functions.rules import feeding_error, location_error
from gridloom.operators.activity import event_summaries, leaderboard
from gridloom.streaming.store import Store


def dedupe_stream(stream: DataFrame, delay: str = "90 days", time: str = "occurred_at") -> DataFrame:
    """The first delivery of each operation id; repeats within the watermark are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


def conflicting_deliveries(events: DataFrame) -> DataFrame:
    """(id, users): operation ids sent by more than one user. For a table, or a batch of ``foreachBatch``."""
    return events.groupBy("id").agg(F.array_sort(F.collect_set("user_id")).alias("users")).where("size(users) > 1")


def time_bounds(stream: DataFrame, ahead: str = "5 minutes", behind: str = "90 days") -> DataFrame:
    """Events whose time is not later, nor much earlier, than their arrival."""
    at, now = F.col("occurred_at"), F.col("received_at")
    return stream.where((at <= now + F.expr(f"interval {ahead}")) & (at >= now - F.expr(f"interval {behind}")))


def latest_state(stream: DataFrame) -> DataFrame:
    """Latest food and water of each park, apart; late arrivals count but never replace newer state. Update mode."""
    return event_summaries(stream)


def validated_stream(stream: DataFrame, points: DataFrame, most_m: float = 200) -> DataFrame:
    """The stream with ``error``: the first rule an event breaks, of its record or its reported place; null if valid.
    Callers split valid events from rejects by it. ``points`` is a static table."""
    at = points.select(F.col("id").alias("point_id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    joined = stream.join(at, "point_id", "left")
    place = F.when(F.col("_lat").isNull(), "unknown_point").otherwise(location_error("reported_latitude", "reported_longitude", "_lat", "_lon", most_m))
    return joined.withColumn("error", F.coalesce(feeding_error(F.col("received_at")), place)).drop("_lat", "_lon")


def accept(history: list[tuple[float, str]], arrivals: list[tuple[float, str]], per_day: int, per_hour: int, cooldown_s: float) -> tuple[list[tuple[float, str]], list[str | None]]:
    """Reasons (null: accepted) of a user's arrivals (seconds, point) in order; only accepted ones count against limits."""
    reasons: list[str | None] = []
    for at, point in arrivals:
        history = [h for h in history if h[0] > at - 86_400]
        if len(history) >= per_day:
            reasons.append("day_limit")
        elif sum(h[0] > at - 3_600 for h in history) >= per_hour:
            reasons.append("hour_limit")
        elif any(p == point and t > at - cooldown_s for t, p in history):
            reasons.append("cooldown")
        else:
            history.append((at, point))
            reasons.append(None)
    return history, reasons


SCHEMA = "user_id string, id string, point_id string, at double, reason string"


DAY_US = 86_400_000_000


def rate_limited_batch(events: DataFrame, per_day: int = 50, per_hour: int = 20, cooldown_s: float = 1800) -> DataFrame:
    """The table form: a fold over each user's events in order of (time, id). Events come row by row in order, and only the
    accepted ones of the last day are held. A user is cut where no event came for over 24 hours: nothing before counts
    there, so the parts are folded in tasks of their own. A stretch without such a gap is one task's, however long."""
    rows = events.select(F.col("user_id").cast("string").alias("user_id"), F.col("id").cast("string").alias("id"), F.col("point_id").cast("string").alias("point_id"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    rows = rows.withColumn("day", F.expr(f"us div {DAY_US}"))
    # gaps lie between days that have events, so a user's window has a row a day
    days = rows.groupBy("user_id", "day").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    order = Window.partitionBy("user_id").orderBy("day")
    cut = days.withColumn("cut", F.coalesce((F.col("first") - F.lag("last").over(order) > DAY_US).cast("int"), F.lit(0)))
    parts = cut.select(F.col("user_id").alias("_user"), F.col("day").alias("_day"), F.sum("cut").over(order).alias("part"))
    rows = rows.join(parts, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("day").eqNullSafe(F.col("_day")))

    def run(batches):
        now, history = None, []
        for batch in batches:
            users, parts, points, us = (batch.column(c).to_pylist() for c in ("user_id", "part", "point_id", "us"))
            at, told = [x / 1e6 for x in us], []
            for key, some in groupby(zip(users, parts, at, points), key=lambda r: r[:2]):
                if key != now:
                    now, history = key, []
                history, reasons = accept(history, [r[2:] for r in some], per_day, per_hour, cooldown_s)
                told += reasons
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("user_id", "id", "point_id")), pa.array(at, pa.float64()), pa.array(told, pa.string())], ["user_id", "id", "point_id", "at", "reason"])

    rows = rows.select("user_id", "part", "us", "id", "point_id").repartition("user_id", "part")
    return rows.sortWithinPartitions("user_id", "part", "us", "id", "point_id").mapInArrow(run, SCHEMA)


def _stores(spark, path: str, key: str, **shape: int) -> tuple[Store, Store]:
    """The events of a live table, and what is told of each key."""
    return Store(spark, f"{path}/events", key, "id", "received_at", **shape), Store(spark, f"{path}/told", key, key, "batch", **shape)


def _live(stream: DataFrame, path: str, checkpoint: str, key: str, tell: Callable, **shape: int):
    """Keeps a stream's events, the latest row of each id, and ``tell`` of all events of each key that a batch touches."""

    def write(batch: DataFrame, number: int) -> None:
        events, told = _stores(batch.sparkSession, path, key, **shape)
        manifest, touched = events.add(batch, number)
        if touched:
            keys = batch.sparkSession.read.parquet(f"{path}/events/rows/generation={number}").select(key).distinct()
            own = events.read(touched, manifest).join(keys, key, "left_semi")
            rows = keys.join(tell(own), key, "left").withColumn("batch", F.lit(number))
            after, _ = told.add(rows, number)
            told.commit(after, number)
        events.commit(manifest, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def live_summaries(stream: DataFrame, store: str, checkpoint: str, buckets: int = 256, most: int = 8):
    """Keeps the summaries of parks current. A batch reads the buckets of its parks, a bounded number of files each."""
    return _live(stream, store, checkpoint, "park_id", event_summaries, buckets=buckets, most=most)


def current_summaries(spark, store: str, buckets: int = 256, most: int = 8) -> DataFrame:
    """The summary of each park with shown events in a store of ``live_summaries``."""
    return _stores(spark, store, "park_id", buckets=buckets, most=most)[1].read().where("records > 0").drop("batch")


def live_points(stream: DataFrame) -> DataFrame:
    """Points of each user from a stream of ledger rows (user_id, points); hidden events come as rows of negative points.
    Complete or update mode."""
    return stream.groupBy("user_id").agg(F.sum("points").alias("points"))


CHANGES = "user_id string, source_id string, points bigint"


def point_changes(stream: DataFrame, points: int = 10, keep_days: int = 90) -> DataFrame:
    """(user_id, source_id, points): what each arrival of an event (id, user_id, status, received_at) adds to its user's
    points or takes back. An event counts while its latest status is published; a repeat changes nothing. State is one
    number an event, kept for ``keep_days`` after its last arrival."""
    rows = stream.select(F.col("id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), "status", F.unix_micros(F.col("received_at").cast("timestamp")).alias("us"))

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches)).sort_values("us")
        counted, last = state.get if state.exists else (0, -1)
        latest = new.iloc[-1]
        now = counted if latest["us"] < last else points * int(latest["status"] == "published")
        state.update((now, max(last, int(latest["us"]))))
        state.setTimeoutDuration(keep_days * 86_400_000)
        if now != counted:
            yield pd.DataFrame({"user_id": [latest["user_id"]], "source_id": [key[0]], "points": [now - counted]})

    return rows.groupBy("id").applyInPandasWithState(run, CHANGES, "counted bigint, last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_leaderboard(stream: DataFrame, store: str, checkpoint: str, points: int = 10, buckets: int = 256, most: int = 8):
    """Keeps the points of each user current from a stream (id, user_id, status, received_at). Every event's latest row is
    kept, so one that is hidden after years takes its points back."""

    def tell(events: DataFrame) -> DataFrame:
        return events.groupBy("user_id").agg((F.count_if(F.col("status") == "published") * points).alias("points"))

    return _live(stream, store, checkpoint, "user_id", tell, buckets=buckets, most=most)


def current_leaderboard(spark, store: str, profiles: DataFrame | None = None, limit: int = 10, buckets: int = 256, most: int = 8) -> DataFrame:
    """The leaderboard of a store of ``live_leaderboard``; users back at no points are left out."""
    sums = _stores(spark, store, "user_id", buckets=buckets, most=most)[1].read().select("user_id", "points").where("points <> 0")
    return leaderboard(sums, profiles, limit)
