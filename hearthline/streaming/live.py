"""Streaming twins: the same functions over a growing folder of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hearthline.operators.time import windowed
from hearthline.sources import ledger


def event_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 8) -> DataFrame:
    """Parquet events appended to a folder, with the schema of `like`; watermarks need ts with a time zone, the session's."""
    rows = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def health(events: DataFrame, length: str, late: str, by: list[str] | None = None) -> DataFrame:
    """Windowed health with bounded state: windows close when the watermark passes them."""
    return windowed(events.withWatermark("ts", late), length, None, by)


def once_each(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def session_counts(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Streaks(StatefulProcessor):
    """Counts each key's errors in a row over micro-batches; its state is one number."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.streak.get()[0] if self.streak.exists() else 0
        alarms = []
        batch = pd.concat(list(rows))
        for at, kind in batch.sort_values(["ts", "event_id"])[["event_id", "event_type"]].itertuples(index=False):
            n = n + 1 if kind == "error" else 0
            if n == self.limit:
                alarms.append(at)
        self.streak.update((n,))
        yield pd.DataFrame({"user_id": [key[0]] * len(alarms), "event_id": alarms}).astype("int64")

    def close(self) -> None:
        pass


def streak_alarms(events: DataFrame, limit: int) -> DataFrame:
    """(user_id, event_id) of the event with which a user's errors in a row reach the limit; events arrive in order across micro-batches.

    The session's spark.sql.streaming.stateStore.providerClass must name the RocksDB provider, which keeps state beyond memory.
    """
    rows = events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return rows.transformWithStateInPandas(Streaks(limit), "user_id long, event_id long", "Append", "None")


class Loops(StatefulProcessor):
    """Finds each key's repeated blocks over micro-batches; its state is the last `longest` kinds, a number of events and the last miss at each lag."""

    def __init__(self, longest: int, times: int):
        self.longest, self.times = longest, times

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, past array<string>, z array<long>")

    def handleInputRows(self, key, rows, timerValues):
        n, past, z = self.seen.get() if self.seen.exists() else (0, [], [0] * self.longest)
        past, z, alarms = list(past), list(z), []
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for at, kind in batch[["event_id", "event_type"]].itertuples(index=False):
            n, kind = n + 1, None if pd.isna(kind) else kind
            z = [last if p <= len(past) and past[-p] == kind else n for p, last in enumerate(z, 1)]
            past = [*past, kind][-self.longest :]
            alarms += [(at, p) for p, last in enumerate(z, 1) if n - last == (self.times - 1) * p and not any(p % q == 0 and z[q - 1] <= last - p + q for q in range(1, p))]
        self.seen.update((n, past, z))
        yield pd.DataFrame({"user_id": [key[0]] * len(alarms), "period": [p for _, p in alarms], "event_id": [at for at, _ in alarms]}).astype("int64")

    def close(self) -> None:
        pass


def loop_alarms(events: DataFrame, longest: int = 8, times: int = 3) -> DataFrame:
    """(user_id, period, event_id) of the event that completes the `times`th block of a loop: what operators.loops gives as alarms, once each.

    As with streak_alarms, events arrive in order across micro-batches and the provider of state is RocksDB's.
    """
    rows = events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return rows.transformWithStateInPandas(Loops(longest, times), "user_id long, period long, event_id long", "Append", "None")


def followed(left: DataFrame, right: DataFrame, key: str, within: str) -> DataFrame:
    """Each left row with every right row of its key that comes at its time or up to `within` after; a left row without any comes once, with nulls.

    The batch form. Right rows give ts and event_id as next_ts and next_id; all columns of left stay.
    """
    r = right.select(F.col(key).alias("_key"), F.col("ts").alias("next_ts"), F.col("event_id").alias("next_id"))
    near = (F.col(key) == F.col("_key")) & F.col("next_ts").between(F.col("ts"), F.col("ts") + F.expr(f"INTERVAL {within}"))
    return left.join(r, near, "left").drop("_key")


def followed_live(left: DataFrame, right: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """The streaming twin of `followed` for feeds in which events come late, by up to `late`, and more than once.

    Doubled event_ids are dropped within the watermark. State on both sides is bounded by it: a left row waits for `within` and `late` at most,
    and is given with nulls once that is over, a right row goes once no left row can meet it. Events behind the watermark are dropped.
    """
    once = lambda df: df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return followed(once(left), once(right), key, within)


def upserts(changes: DataFrame, path: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps a ledger (sources.ledger) up to date from a feed; a batch that is run again after a failure changes nothing."""
    return push(changes, lambda batch, i: ledger.upsert(batch, i, path, key, order), checkpoint)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops; a restart goes on from the checkpoint, exactly once."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def push(df: DataFrame, deliver, checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to deliver(batch, batch_id): a detached consumer of the live feed."""
    q = df.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
