"""Rules that depend on order, over streams that arrive in any order (STM-1, STM-5, DML-6).

State is kept by key with ``transformWithStateInPandas``, in the RocksDB store. Rows wait in a buffer by their time until the
watermark has passed it; an event-time timer then releases them in order, so results are those of the batch forms for any
arrival order within the watermark, and the same after a restart from the checkpoint. A row behind the watermark is told as
late and changes nothing.

Spark drops rows behind the watermark before a processor sees them, if their time column carries it. Here the column is
handed on as plain microseconds, so late rows come through and get their answer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridloom.operators.activity import case_step

DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State by key with timers needs this store. Streams started from now on use it; checkpoints keep the store they began
    with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Releases a key's rows in order of (us, order) and asks ``decide`` about each. Rows have ``us``, microseconds."""

    #: Columns that break ties of time, and those of a row out.
    order: tuple[str, ...] = ()
    out: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # rows of one millisecond, as JSON; an entry goes when its timer fires
        self.waiting = handle.getMapState("waiting", "ms bigint", "rows array<string>")

    def decide(self, rows: list[dict]) -> list[dict]:
        raise NotImplementedError

    def late(self, row: dict) -> dict:
        raise NotImplementedError

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in self.out})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, late, new = timerValues.getCurrentWatermarkInMs(), [], {}
        for frame in rows:
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                ms = -(-int(row["us"]) // 1000)  # the timer must not fire before the row's time is over
                if ms <= mark:
                    late.append(self.late(row))
                else:
                    new.setdefault(ms, []).append(json.dumps(row, default=int))
        for ms, more in new.items():
            if self.waiting.containsKey((ms,)):
                more = [*self.waiting.getValue((ms,))[0], *more]
            else:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), (more,))
        if late:
            yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        rows = []
        if self.waiting.containsKey((ms,)):
            rows = [json.loads(r) for r in self.waiting.getValue((ms,))[0]]
            self.waiting.removeKey((ms,))
        rows.sort(key=lambda r: (r["us"], *((r[c] is not None, r[c]) for c in self.order)))
        if told := self.decide(rows):
            yield self._frame(told)

    def close(self) -> None:
        pass


class RateLimits(InOrder):
    """State beside the buffer: the accepted events of the last day, an entry each, at most ``per_day``."""

    order, out = ("id", "point_id"), ("user_id", "id", "point_id", "at", "reason")

    def __init__(self, per_day: int, per_hour: int, cooldown_us: int):
        self.per_day, self.per_hour, self.cooldown_us = per_day, per_hour, cooldown_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.accepted = handle.getMapState("accepted", "us bigint, id string", "point string")

    def late(self, row: dict) -> dict:
        return row | {"at": row["us"] / 1e6, "reason": "late"}

    def decide(self, rows: list[dict]) -> list[dict]:
        history = [(int(k[0]), k[1], v[0]) for k, v in self.accepted.iterator()]
        told = []
        for row in rows:
            us, point = row["us"], row["point_id"]
            for h in [h for h in history if h[0] <= us - DAY_US]:
                self.accepted.removeKey(h[:2])
                history.remove(h)
            reason = None
            if len(history) >= self.per_day:
                reason = "day_limit"
            elif sum(h[0] > us - HOUR_US for h in history) >= self.per_hour:
                reason = "hour_limit"
            elif any(h[2] == point and h[0] > us - self.cooldown_us for h in history):
                reason = "cooldown"
            else:
                self.accepted.updateValue((us, row["id"]), (point,))
                history.append((us, row["id"], point))
                self.handle.registerTimer(us // 1000 + 86_400_001)  # to leave no entry behind
            told.append(row | {"at": us / 1e6, "reason": reason})
        return told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        limit = expiredTimerInfo.getExpiryTimeInMs() * 1000 - DAY_US
        for k, _ in list(self.accepted.iterator()):
            if int(k[0]) <= limit:
                self.accepted.removeKey((int(k[0]), k[1]))


def rate_limited(stream: DataFrame, per_day: int = 50, per_hour: int = 20, cooldown_s: float = 1800, delay: str = "10 minutes") -> DataFrame:
    """(user_id, id, point_id, at, reason) for a stream (user_id, id, point_id, at): what ``events.rate_limited_batch`` says
    of the whole, told when the watermark has passed an event; ``late`` for events behind it. A user's state is what waits
    and the accepted events of a day, an entry each."""
    use_rocksdb(stream.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = stream.select("user_id", "id", "point_id", F.col("at").cast("timestamp").alias("_at")).withWatermark("_at", delay)
    rows = rows.select(text("user_id"), text("id"), text("point_id"), F.unix_micros("_at").alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(RateLimits(per_day, per_hour, int(cooldown_s * 1e6)), "user_id string, id string, point_id string, at double, reason string", "Append", "EventTime")


class Deliveries(StatefulProcessor):
    """State: an operation id's owner and the time of its first delivery."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owner = handle.getValueState("owner", "user_id string, ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        new = pd.concat(list(rows)).sort_values(["us", "user_id"], kind="stable")
        known = self.owner.get() if self.owner.exists() else None
        if known is not None and known[1] + self.keep_ms <= mark:  # timers fire after the rows of a batch
            known = None
        told = []
        for user, us in zip(new["user_id"], new["us"]):
            late = us // 1000 <= mark
            if known is None and late:
                told.append("late")
                continue
            if known is None:
                known = (user, int(us // 1000))
                self.owner.update(known)
                self.handle.registerTimer(known[1] + self.keep_ms)
                told.append("accepted")
            elif known[0] != user:
                told.append("conflict")
            else:
                told.append("late_repeat" if late else "repeat")
        yield pd.DataFrame({"id": new["id"].to_numpy(), "user_id": new["user_id"].to_numpy(), "us": new["us"].to_numpy(), "delivery": told})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.owner.exists() and self.owner.get()[1] + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.owner.clear()
        yield pd.DataFrame({"id": [], "user_id": [], "us": [], "delivery": []}).astype({"id": object, "user_id": object, "us": "int64", "delivery": object})

    def close(self) -> None:
        pass


def deliveries(stream: DataFrame, time: str = "received_at", delay: str = "1 hour", keep_days: int = 90) -> DataFrame:
    """(id, user_id, us, delivery) of every row of a stream (id, user_id and an arrival time): ``accepted`` for the first
    delivery of an operation id, ``repeat`` if its owner sends it again, ``late_repeat`` if that comes behind the watermark,
    ``conflict`` if another user uses the id, and ``late`` for a row behind the watermark whose id is not, or no longer,
    known. Owners are known for ``keep_days``. Of one batch, the earliest arrival is the first."""
    use_rocksdb(stream.sparkSession)
    rows = stream.select(F.col("id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col(time).alias("_at")).withWatermark("_at", delay)
    rows = rows.select("id", F.coalesce("user_id", F.lit("")).alias("user_id"), F.unix_micros("_at").alias("us"))
    return rows.groupBy("id").transformWithStateInPandas(Deliveries(keep_days * 86_400_000), "id string, user_id string, us bigint, delivery string", "Append", "EventTime")


class Cases(InOrder):
    """State beside the buffer: a case's status, volunteer and vet."""

    order, out = ("seq",), ("case_id", "us", "seq", "status", "volunteer", "vet", "taken", "late")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.case = handle.getValueState("case", "status string, volunteer string, vet string")

    def late(self, row: dict) -> dict:
        return row | {"status": None, "volunteer": None, "vet": None, "taken": False, "late": True}

    def decide(self, rows: list[dict]) -> list[dict]:
        state, told = tuple(self.case.get()) if self.case.exists() else None, []
        for row in rows:
            state, taken = case_step(state or (row["start"], row["start_volunteer"], row["start_vet"]), row)
            told.append(row | {"status": state[0], "volunteer": state[1], "vet": state[2], "taken": bool(taken), "late": False})
        if rows:
            self.case.update(state)
        return told


def case_stream(commands: DataFrame, cases: DataFrame, vets: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(case_id, us, seq, status, volunteer, vet, taken, late): the case after each command of a stream (case_id, at, seq,
    kind, actor, moderator, target, vet_id), in order of (at, seq). ``cases`` and ``vets`` are static tables: how cases began,
    and who is active. The last row of a case is its row of ``activity.fold_cases``."""
    use_rocksdb(commands.sparkSession)
    begun = cases.select(F.col("id").alias("case_id"), F.col("status").alias("start"), F.col("assigned_volunteer_id").alias("start_volunteer"), F.col("assigned_vet_id").alias("start_vet"), F.col("hidden_at").isNotNull().alias("hidden"))
    known = vets.where("active").select(F.col("id").alias("vet_id")).distinct().withColumn("vet_active", F.lit(True))
    rows = commands.withWatermark("at", delay).join(begun, "case_id").join(known, "vet_id", "left")
    fields = ["case_id", "seq", "kind", "actor", "moderator", "target", "vet_id", "vet_active", "hidden", "start", "start_volunteer", "start_vet"]
    rows = rows.select(*fields, F.unix_micros(F.col("at")).alias("us"))
    seq = dict(commands.dtypes)["seq"]
    return rows.groupBy("case_id").transformWithStateInPandas(Cases(), f"case_id string, us bigint, seq {seq}, status string, volunteer string, vet string, taken boolean, late boolean", "Append", "EventTime")


def case_states(told: DataFrame) -> DataFrame:
    """(id, status, assigned_volunteer_id, assigned_vet_id) of the cases in what a ``case_stream`` has written."""
    last = told.where("not late").groupBy(F.col("case_id").alias("id")).agg(F.max_by(F.struct("status", "volunteer", "vet"), F.struct("us", "seq")).alias("l"))
    return last.select("id", F.col("l.status").alias("status"), F.col("l.volunteer").alias("assigned_volunteer_id"), F.col("l.vet").alias("assigned_vet_id"))
