import datetime
import glob

import duckdb

from textloom.plans import streams


def test_arrivals_of_several_files_equal_the_sql(spark, tmp_path, monkeypatch):
    """Each arrival is written and read by several tasks, and the state of a path is kept without a frame for each."""
    at = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i * 97 % 20_000)
    rows = [(i, at(i), i % 7, ("click", "view")[i % 2]) for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(streams, "FILE_ROWS", 20)
    n = iter(range(9))
    got = streams.quiet_watch(spark, str(tmp_path), lambda spark, name: f"{tmp_path}/{name}-{next(n)}").select("arrival", "path", "seq", "n_matches", "late", "previous").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(streams.quiet_sql()).fetchall(), key=str)
    assert len(glob.glob(f"{tmp_path}/quiet-0/log/*.parquet")) > 2 * streams.ARRIVALS
