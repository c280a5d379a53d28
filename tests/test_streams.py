"""Streams: windows that are open at the end are given, rows may come in any order within the delay, the first copy stays."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sightline.streaming import jobs

SCHEMA = "ts timestamp, user string, value long"


def arrivals(spark, path, rows, files):
    """Rows written as so many files, one after the other, each a batch of its own."""
    for n in range(files):
        spark.createDataFrame(rows[n::files] if files == 1 else rows[n * len(rows) // files : (n + 1) * len(rows) // files], "s long, user string, value long").select(
            F.timestamp_seconds("s").alias("ts"), "user", "value"
        ).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def out_of_order(rng, n, delay):
    rows = [(10_000 + rng.randint(0, 3000), rng.choice("abc"), i) for i in range(n)]
    return sorted(rows, key=lambda r: r[0] + rng.randint(0, delay))


def test_all_windows_and_sessions_are_given(spark, tmp_path):
    rows = out_of_order(random.Random(2), 300, 50)
    stream = arrivals(spark, str(tmp_path / "in"), rows, 6)
    static = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for job in (
        lambda df: jobs.window_counts(df, "ts", "60 seconds", "100 seconds", ["user"], score="value"),
        lambda df: jobs.window_counts(df, "ts", "60 seconds", "100 seconds", ["user"], slide="50 seconds"),
        lambda df: jobs.session_groups(df, "ts", "60 seconds", "40 seconds", ["user"]),
        lambda df: jobs.first_copies(df, ["user"], "ts", "200 seconds", "60 seconds", ["value"]),
    ):
        got = sorted(map(repr, jobs.run_to_end(stream, "ts", job, "end").collect()))
        assert got == sorted(map(repr, job(static).collect())) and got


def test_first_copy_of_each_window(spark, tmp_path):
    rows = out_of_order(random.Random(4), 200, 50)
    stream = arrivals(spark, str(tmp_path / "in"), rows, 4)
    found = jobs.run_to_end(stream, "ts", lambda df: jobs.first_copies(df, ["user"], "ts", "200 seconds", "60 seconds", ["value"]), "first").collect()
    want = {}
    for s, user, value in rows:
        place = user, s // 200
        want[place] = min(want.get(place, (s, value)), (s, value))
    assert sorted((r["user"], int(r["ts"].timestamp()), r["value"]) for r in found) == sorted((user, s, v) for (user, _), (s, v) in want.items())


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert jobs.run_to_end(stream, "ts", lambda df: jobs.window_counts(df, "ts", "1 second", "5 seconds", ["user"]), "none").collect() == []
