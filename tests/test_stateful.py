"""Keyed state: many batches equal one, a broken run goes on where it was, late rows are dropped."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from folioscope.streaming import events as ops
from folioscope.streaming import stateful

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "group long, id long, at long, ts timestamp, question string, vector array<double>"


def rows(spec):
    """(group, id, seconds, question, vector) to rows."""
    return [(g, i, int((START + timedelta(seconds=s)).timestamp() * 1000), START + timedelta(seconds=s), q, v) for g, i, s, q, v in spec]


def put(spark, folder, name, spec):
    spark.createDataFrame(rows(spec), SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(folder)


def result(spark, out, columns):
    return sorted(tuple(r) for r in spark.read.parquet(out).select(*columns).collect())


def test_answers_over_batches_with_ttl_and_capacity(spark, tmp_path):
    one = [(1, 1, 0, "a", [1.0, 0.0]), (1, 2, 5, "a", [1.0, 0.0]), (1, 3, 6, "b", [0.99, 0.01]), (2, 4, 6, "a", None), (1, 5, 7, "c", [0.0, 1.0]), (1, 6, 8, "d", [-1.0, 0.0])]
    two = [(1, 7, 9, "a", [1.0, 0.0]), (1, 8, 100, "a", [1.0, 0.0]), (2, 9, 20, "a", []), (2, 10, 66, "a", None), (1, 11, 101, "e", [2.0, 0.0])]
    put(spark, f"{tmp_path}/in", "1", one)
    out = lambda: stateful.cached_answers(stream(spark, f"{tmp_path}/in"), 60_000, 2, 0.93, "1 day")
    stateful.run_to_files(out(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    put(spark, f"{tmp_path}/in", "2", two)
    stateful.run_to_files(out(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    # 6 pushed out 1, the oldest of two; at 100 s all are over; a hit (2) made nothing live longer.
    expected = {1: ("miss", 1), 2: ("exact", 1), 3: ("semantic", 1), 4: ("miss", 4), 5: ("miss", 5), 6: ("miss", 6), 7: ("miss", 7), 8: ("miss", 8), 9: ("exact", 4), 10: ("miss", 10), 11: ("semantic", 8)}
    assert {i: (k, s) for _, i, k, s in result(spark, f"{tmp_path}/out", ["group", "id", "kind", "source"])} == expected


def test_heartbeats_over_batches(spark, tmp_path):
    put(spark, f"{tmp_path}/in", "1", [(1, 1, 0, "", None), (1, 2, 1, "", None), (2, 3, 0, "", None)])
    out = lambda: stateful.heartbeats(stream(spark, f"{tmp_path}/in"), 2_000, 3, "1 second")
    stateful.run_to_files(out(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    put(spark, f"{tmp_path}/in", "2", [(1, 4, 6, "", None), (3, 5, 30, "", None)])
    stateful.run_to_files(out(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    ms = int(START.timestamp() * 1000)
    got = [(g, a, b, (at - ms) // 1000) for g, a, b, at in result(spark, f"{tmp_path}/out", ["group", "after", "beat", "at"])]
    # Group 1 is silent from 1 to 6, group 2 and then 1 to the watermark at 29, three beats at most; nothing beats twice.
    assert got == [(1, 2, 1, 3), (1, 2, 2, 5), (1, 4, 1, 8), (1, 4, 2, 10), (1, 4, 3, 12), (2, 3, 1, 2), (2, 3, 2, 4), (2, 3, 3, 6)]


def test_a_broken_run_goes_on_where_it_was(spark, tmp_path):
    """The second batch fails; started again the files hold every row once, as an undisturbed run gives them."""
    flag = f"{tmp_path}/break"
    for n in range(4):
        put(spark, f"{tmp_path}/in", str(n), [(g, 100 * n + g, 100 * n + g, f"q{g}", [1.0]) for g in range(5)])

    @F.udf("long")
    def shaky(i):
        if os.path.exists(flag) and i >= 200:
            raise ValueError("broken")
        return i

    out = lambda: stateful.cached_answers(stream(spark, f"{tmp_path}/in").withColumn("id", shaky("id")), 3_600_000, 16, 2.0)
    open(flag, "w").close()
    with pytest.raises(Exception, match="broken"):
        stateful.run_to_files(out(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    half = len(result(spark, f"{tmp_path}/out", ["id"]))
    os.remove(flag)
    stateful.run_to_files(out(), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    stateful.run_to_files(out(), f"{tmp_path}/whole", f"{tmp_path}/check2").awaitTermination()
    columns = ["group", "id", "kind", "source"]
    assert half < 20 and result(spark, f"{tmp_path}/out", columns) == result(spark, f"{tmp_path}/whole", columns) and len(result(spark, f"{tmp_path}/out", ["id"])) == 20


def test_late_rows_and_windows_in_append_mode(spark, tmp_path):
    event = lambda i, s: (i, START + timedelta(seconds=s), 1, "view", 1.0)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for n, part in enumerate(([event(1, 0), event(2, 7300)], [event(3, 3700), event(4, 10), event(5, 20_000)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        stateful.run_to_files(ops.windowed(source, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    # 4 comes after the watermark has passed its window, 3 does not; the last window is still open.
    got = sorted((int(r["start"].replace(tzinfo=timezone.utc).timestamp() - START.timestamp()) // 3600, r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 1), (1, 1), (2, 1)]
