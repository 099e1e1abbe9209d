"""Places, closed lines and sessions, against values worked out by hand."""

import math
import tempfile

from pyspark.sql import functions as F

from strideline.operators import spatial
from strideline.streaming.sessions import sessions

DATA = "/root/testdata/sf0.001"


def test_grid_join_matches_all_pairs(spark):
    rows = [(i, 48.0 + (i * 37 % 23) / 3000.0, 11.0 + (i * 53 % 29) / 3000.0) for i in range(120)] + [(900, None, 11.0), (901, 48.0, None)]
    p = spark.createDataFrame(rows, "id long, lat double, lon double")
    got = {(r.a, r.b) for r in spatial.grid_join(p, p, 100.0).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect()}

    def metres(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * spatial.EARTH_M * math.asin(math.sqrt(h))

    assert got == {(a[0], b[0]) for a in rows[:120] for b in rows[:120] if metres(a, b) <= 100}


def test_roundness_of_square_and_line(spark):
    p = spark.createDataFrame([("s", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])] + [("l", 0, 0.0, 0.0), ("l", 1, 1.0, 0.0), ("p", 0, 2.0, 2.0)], "k string, i int, x double, y double")
    got = {r.k: r.roundness for r in spatial.roundness(p, "k", "x", "y", "i").collect()}
    assert abs(got["s"] - math.pi / 4) < 1e-12 and got["l"] == 0 and got["p"] is None


def test_sessions_of_a_stream_are_those_of_the_table(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    with tempfile.TemporaryDirectory() as d:
        events.write.parquet(f"{d}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{d}/in")
        q = sessions(stream, late="60 days").writeStream.format("memory").queryName("sessions_seen").outputMode("complete").option("checkpointLocation", f"{d}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    key = lambda r: (r.user_id, r.start, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("sessions_seen").collect())) == sorted(map(key, sessions(events).collect()))
