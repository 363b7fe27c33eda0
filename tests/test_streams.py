"""Streams over tables in several files, and limits at the edge of a second."""

import datetime as dt

import duckdb

from posthorn.queries import streams
from tests import parity

SF = "/root/testdata/sf0.001"


def test_a_table_of_part_files_is_streamed_whole(spark, tmp_path):
    names = {"conversations": "stream_thread_state", "events": "stream_dedup"}
    con = parity.connect(SF)
    for table, query in names.items():
        spark.read.parquet(f"{SF}/{table}.parquet").repartition(3).write.parquet(f"file://{tmp_path}/{table}.parquet")
        parity.compare(spark, con, f"file://{tmp_path}", streams.QUERIES[query], streams.ORACLE[query])


def test_limiter_rounds_to_the_nearest_second_as_its_sql_does(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    at = lambda s: day + dt.timedelta(seconds=s)
    # A day apart in rounded seconds only; half seconds go to the even one; no user, no time.
    rows = [(1, 1, at(0.4)), (2, 1, at(86399.6)), (3, 2, at(0.6)), (4, 2, at(86400.4)), (5, 3, at(0.5)), (6, 3, at(86400.5)), (7, 4, at(1.5)), (8, 4, at(86401.4)), (9, None, at(3)), (10, 5, None), (11, 5, at(7))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    parity.compare(spark, con, f"file://{tmp_path}", streams.QUERIES["stream_limiter"], streams.ORACLE["stream_limiter"])
