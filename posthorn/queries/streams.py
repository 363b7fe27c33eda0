"""Streaming queries over the driver's tables, run to the end of what is there (R)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthorn.plans.scratch import new_path
from posthorn.sources.tables import table
from posthorn.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of the data directory, a file or a folder of part files, as a stream of its files."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    files = spark.readStream.schema(table(spark, sf, name).schema)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return files.parquet(f"{sf}/{name}.parquet")
    return files.option("pathGlobFilter", f"{name}.parquet").parquet(sf)  # a stream's path is a folder


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_dedup(spark, sf):
    """Each event once, although the stream has it twice."""
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return jobs.run_available(jobs.once(twice)).select("event_id", "event_type")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf):
    """Extension: hourly counts, all windows at the end of the input."""
    e = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = jobs.run_available(jobs.windowed_counts(e))
    # Windows that the watermark hasn't closed yet are the batch's to count.
    closed = F.coalesce(done.agg(F.max("end").alias("e")).scalar(), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    rest = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts") >= closed)
    tail = rest.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))
    return done.select("start", "event_type", "n").unionByName(tail)


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(epoch(ts) AS BIGINT) AS sec FROM events), r AS (SELECT user_id, min(sec) AS sec FROM e GROUP BY 1
 UNION ALL SELECT user_id, nxt FROM (SELECT r.user_id, (SELECT min(e.sec) FROM e WHERE e.user_id = r.user_id AND e.sec >= r.sec + 86400) AS nxt FROM r) x WHERE nxt IS NOT NULL),
g AS (SELECT r.user_id, min(event_id) AS event_id FROM r JOIN e ON e.user_id = r.user_id AND e.sec = r.sec GROUP BY r.user_id, r.sec)
SELECT e.event_id, e.user_id, g.event_id IS NOT NULL AS allowed FROM e LEFT JOIN g ON g.event_id = e.event_id""")
def stream_limiter(spark, sf):
    """One request a user in 24 hours, so that most requests are refused."""
    return jobs.run_available(jobs.limiter(_stream(spark, sf, "events"), window_s=86_400, allowed=1))


def _post(payload: str, headers: dict[str, str]) -> int:
    """A receiver that refuses errors, fails on clicks and takes the rest if they are signed."""
    if payload == "click":
        raise OSError("down")
    return 503 if payload == "error" or len(headers["X-Signature"]) != 64 else 200


@query("""SELECT 'd' || CAST(event_id AS VARCHAR) AS key, CASE WHEN event_type IN ('error', 'click') THEN 'failed' ELSE 'delivered' END AS status, CASE WHEN event_type IN ('error', 'click') THEN 5 ELSE 1 END AS attempts,
CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN NULL ELSE 200 END AS response_status, CASE WHEN event_type = 'click' THEN 'down' END AS last_error FROM events""")
def outbox_retries(spark, sf):
    """Five rounds with rising waits; what is refused five times has failed."""
    where, e = new_path(spark, "outbox"), table(spark, sf, "events")
    new = e.select(F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("key"), F.col("event_type").alias("payload"))
    # The second round comes before the first wait is over and sends nothing.
    for n, now in enumerate(("2024-02-01 00:00:00", "2024-02-01 00:00:59", "2024-02-01 00:01:00", "2024-02-01 00:06:00", "2024-02-01 00:21:00", "2024-02-01 01:21:00", "2024-02-02 00:00:00")):
        jobs.outbox_round(spark, new if n == 0 else None, _post, b"secret", where, n, now)
    return jobs.outbox_state(spark, where).select("key", "status", "attempts", "response_status", "last_error")


@query("""WITH t AS (SELECT DISTINCT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM conversations),
f AS (SELECT conv_id, w, min(turn) AS first_turn FROM t GROUP BY 1, 2)
SELECT c.conv_id AS thread, c.turn AS k, (SELECT count(*) FROM f WHERE f.conv_id = c.conv_id AND f.first_turn = c.turn) AS new_signals FROM (SELECT DISTINCT conv_id, turn FROM conversations) c""")
def stream_thread_state(spark, sf):
    """New words of each turn, from the thread's state."""
    return jobs.run_available(jobs.new_signals(_stream(spark, sf, "conversations")))
