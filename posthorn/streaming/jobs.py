"""Long-running behaviour as Structured Streaming.

Each builder takes a streaming DataFrame and returns one, so the same code runs continuously or
as ``availableNow`` micro-batches under an external scheduler.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from posthorn.plans.scratch import materialise, new_path


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet folder as a stream; the checkpoint keeps its offsets."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(events: DataFrame, key: str = "event_id", at: str = "ts", ttl: str = "7 days") -> DataFrame:
    """The first arrival of a key within ``ttl``; older keys leave the state."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: counts of event-time windows, closed when the watermark has passed."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select("w.start", "w.end", kind, "n", "value")
    )


def limiter(events: DataFrame, user: str = "user_id", at: str = "ts", window_s: int = 60, allowed: int = 120, late: str = "10 minutes") -> DataFrame:
    """Exact sliding-window limiter; only allowed requests count.

    State: at most ``allowed`` times of the last window; it goes when the watermark (``late`` behind the newest
    event) has passed the window. All of a user's requests of a trigger are put in order before they are judged; one
    that comes in a later trigger is judged then. Times count in whole seconds, rounded to the nearest, a half to the
    even one. Requests without a user or a time are refused.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        asked = [(t, int(e)) for pdf in batches for e, t in zip(pdf["event_id"], pdf["sec"], strict=True)]
        rows = [(e, key[0], False) for t, e in asked if pd.isna(key[0]) or pd.isna(t)]
        for t, event_id in sorted((int(t), e) for t, e in asked if not (pd.isna(key[0]) or pd.isna(t))):
            times = [x for x in times if x > t - window_s]
            ok = len(times) < allowed
            if ok:
                times.append(t)
            rows.append((event_id, key[0], ok))
        state.update((times,))
        state.setTimeoutTimestamp(max((max(times, default=0) + window_s) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["event_id", "user_id", "allowed"]).astype({"user_id": "Int64"})

    keyed = events.select("event_id", F.col(user).alias("user_id"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    keyed = keyed.select("event_id", "user_id", "at", F.rint(F.unix_micros("at") / 1e6).cast("long").alias("sec"))
    return keyed.groupBy("user_id").applyInPandasWithState(run, "event_id long, user_id long, allowed boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def new_signals(messages: DataFrame, thread: str = "conv_id", key: str = "turn", text: str = "text", at: str | None = None, ttl: str = "90 days") -> DataFrame:
    """For each message of a thread the number of words that the thread hasn't had yet.

    State: the thread's words. With a time column ``at`` it goes when the watermark has passed the thread's last
    message by ``ttl``; messages without a time can't expire anything. All of a thread's messages of a trigger are
    put in order before they are counted.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        rows, last = [], 0
        for pdf in batches:
            last = max([last, *(int(x.timestamp() * 1000) for x in pdf["at"])]) if at else 0
            rows += [(int(k), w) for k, w in zip(pdf["k"], pdf["words"], strict=True)]
        out = []
        for k, words in sorted(rows, key=lambda x: x[0]):
            fresh = set(words) - seen
            seen |= fresh
            out.append((group[0], k, len(fresh)))
        state.update((sorted(seen),))
        if at:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["thread", "k", "new_signals"])

    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda w: w != ""))
    columns = [F.col(thread).alias("thread"), F.col(key).alias("k"), words.alias("words")]
    keyed = messages.select(*columns, F.col(at).cast("timestamp").alias("at")).withWatermark("at", ttl) if at else messages.select(*columns)
    timeout = GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.NoTimeout
    return keyed.groupBy("thread").applyInPandasWithState(run, "thread long, k long, new_signals long", "words array<string>", "append", timeout)


_OUTBOX = "key string, payload string, status string, attempts int, response_status int, last_error string, next_attempt_at timestamp, batch long"


def outbox_state(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The last outcome of every delivery in ``table``; ``before`` leaves out batches from that number on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], _OUTBOX)
    rows = spark.read.schema(_OUTBOX).parquet(table)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), F.struct("attempts", "batch")).alias("r")).select("r.*")


def attempt(deliveries: DataFrame, post: Callable[[str, dict[str, str]], int], secret: bytes, now: str | None = None) -> DataFrame:
    """Send deliveries (key, payload, attempts so far) once; their outcome.

    What fails waits for 1 m, 5 m, 15 m, 1 h and 6 h, and after MAX_ATTEMPTS attempts is ``failed`` for good.
    """
    from posthorn.sources.exports import MAX_ATTEMPTS, backoff, deliver

    sent = materialise(deliver(deliveries, post, secret), "outbox")  # sent once, however often it is read
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    ok = F.coalesce(F.col("response_status").between(200, 299), F.lit(False))
    tried = (F.col("attempts") + 1).cast("int")
    status = F.when(ok, "delivered").when(tried >= MAX_ATTEMPTS, "failed").otherwise("pending")
    wait = F.make_dt_interval(secs=backoff(tried).cast("decimal(18,6)"))
    out = sent.join(deliveries.select("key", "payload", "attempts"), "key")
    return out.select("key", "payload", status.alias("status"), tried.alias("attempts"), "response_status", "last_error", F.when(status == "pending", at + wait).alias("next_attempt_at"))


def outbox_round(spark: SparkSession, new: DataFrame | None, post: Callable[[str, dict[str, str]], int], secret: bytes, table: str, number: int, now: str | None = None) -> None:
    """One batch of the outbox: new deliveries, and earlier ones whose next attempt is due. A repeated batch replaces its own outcome."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    known = outbox_state(spark, table, number)
    due = known.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= at)).select("key", "payload", "attempts")
    if new is not None:
        fresh = new.select("key", "payload").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
        due = due.unionByName(fresh.withColumn("attempts", F.lit(0)))
    attempt(materialise(due, "outbox-due"), post, secret, now).write.mode("overwrite").parquet(f"{table}/batch={number}")


def outbox(spark: SparkSession, deliveries: DataFrame, post: Callable[[str, dict[str, str]], int], secret: bytes, table: str, checkpoint: str) -> StreamingQuery:
    """Deliver new payloads of a stream and those that are due again, at least once; outcomes go to ``table``."""

    def batch(df: DataFrame, number: int) -> None:
        outbox_round(spark, df, post, secret, table, number)

    return deliveries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pipeline(stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], stream: DataFrame) -> DataFrame:
    """R2: the queue's stages chained in one streaming plan."""
    for _, stage in stages:
        stream = stage(stream)
    return stream


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run all that is there as micro-batches and return the result as a table."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-state")
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def slot_due(now: dt.datetime, hour: int, minute: int, last: dt.datetime | None) -> bool:
    """Whether today's slot has passed and has not run yet."""
    slot = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    return now >= slot and (last is None or last < slot)
