"""Activity-shaped views over the star-schema tables, so that every operator can run on any volume of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """activity_id, athlete_id, squad, day, dist_m, moving_s, elapsed_s, gain_m: an order is an activity as long as its quantities."""
    dist = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("activity_id")).agg((F.sum("l_quantity") * 100).cast("long").alias("dist_m"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("activity_id"), F.col("o_custkey").alias("athlete_id"), (F.col("o_custkey") % 25).alias("squad"), F.to_date("o_orderdate").alias("day"))
    a = o.join(dist, "activity_id")
    k = F.col("activity_id")
    a = a.withColumn("moving_s", F.floor(F.col("dist_m") * (240 + k % 240) / 1000))
    a = a.withColumn("elapsed_s", F.col("moving_s") + F.floor(F.col("moving_s") * (k % 4) / 10))
    return a.withColumn("gain_m", (k % 50) * F.floor(F.col("dist_m") / 1000))


ACTIVITIES_SQL = """
activity AS (
  SELECT o_orderkey AS activity_id, o_custkey AS athlete_id, o_custkey % 25 AS squad, CAST(o_orderdate AS DATE) AS day, dist_m, moving_s,
         moving_s + CAST(floor(moving_s * (o_orderkey % 4) / 10) AS BIGINT) AS elapsed_s,
         (o_orderkey % 50) * CAST(floor(dist_m / 1000) AS BIGINT) AS gain_m
  FROM (SELECT o_orderkey, o_custkey, o_orderdate, dist_m, CAST(floor(dist_m * (240 + o_orderkey % 240) / 1000) AS BIGINT) AS moving_s
        FROM orders JOIN (SELECT l_orderkey, CAST(sum(l_quantity) * 100 AS BIGINT) AS dist_m FROM lineitem GROUP BY 1) q ON o_orderkey = l_orderkey) x)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """athlete_id, i, epoch, step_m, d, hr, lat, lon: an athlete's events as the samples of one recording."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("athlete_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"), "event_id", F.col("value").cast("decimal(18,2)").alias("step_m"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type",
    )
    w = W.partitionBy("athlete_id").orderBy("epoch", "event_id")
    return e.select(
        "athlete_id", F.row_number().over(w).alias("i"), "epoch", "step_m", F.sum("step_m").over(w).alias("d"), (60 + F.col("k")).alias("hr"),
        ((F.col("k") % 40) / 1000.0).alias("lat"), ((F.col("athlete_id") % 40) / 1000.0).alias("lon"), "event_type",
    )


RECORDS_SQL = """
record AS (
  SELECT athlete_id, row_number() OVER w AS i, epoch, step_m, sum(step_m) OVER w AS d, 60 + k AS hr, (k % 40) / 1000.0 AS lat, (athlete_id % 40) / 1000.0 AS lon, event_type
  FROM (SELECT user_id AS athlete_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, event_id, CAST(value AS DECIMAL(18,2)) AS step_m, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events) e
  WINDOW w AS (PARTITION BY athlete_id ORDER BY epoch, event_id))"""


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities as an export's CSV has them: every column text, with blank, malformed and zero cells among them."""
    k = F.col("activity_id")
    at = F.col("day").cast("timestamp") + F.make_dt_interval(secs=(k * 37 % 86400).cast("decimal(18,6)"))
    text = lambda c: F.col(c).cast("string")
    return activities(spark, sf_dir).select(
        k.cast("string").alias("Activity ID"),
        F.when(k % 23 == 0, "").when(k % 29 == 0, "Foo 45, 2001").otherwise(F.date_format(at, "MMM d, yyyy, h:mm:ss a")).alias("Activity Date"),
        F.concat(F.lit("Run "), (k % 50).cast("string")).alias("Activity Name"),
        F.element_at(F.array(*map(F.lit, ("Run", "Trail Run", "Ride", "run", "Walk", "Running"))), (k % 6 + 1).cast("int")).alias("Activity Type"),
        F.when(k % 4 == 0, F.concat(F.lit("activities/"), k.cast("string"), F.lit(".fit.gz"))).when(k % 4 == 1, F.concat(F.lit("activities/"), k.cast("string"), F.lit(".fit"))).otherwise("").alias("Filename"),
        F.when(k % 31 == 0, "").when(k % 37 == 0, "n/a").when(k % 41 == 0, "0").otherwise(text("dist_m")).alias("Distance"),
        text("moving_s").alias("Moving Time"), text("elapsed_s").alias("Elapsed Time"), text("gain_m").alias("Elevation Gain"),
        F.when(k % 5 == 0, "").when(k % 7 == 0, "300").otherwise((110 + k % 60).cast("string")).alias("Average Heart Rate"),
        F.when(k % 5 == 0, "").otherwise((150 + k % 90).cast("string")).alias("Max Heart Rate"),
    )


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the recordings of two thirds of the activities gave: sport, times, heart rate and how many samples have one."""
    k = F.col("activity_id")
    return activities(spark, sf_dir).where(k % 3 != 0).select(
        k.cast("string").alias("fit_file"), F.when(k % 2 == 0, "cycling").otherwise("running").alias("fit_sport"), F.col("elapsed_s").alias("fit_elapsed_s"), F.col("moving_s").alias("fit_timer_s"),
        (15 + k % 260).alias("fit_avg_hr"), (k % 11).alias("hr_pts"), F.lit(10).cast("long").alias("stream_pts"), (k % 4 != 0).alias("has_gps"),
    )


EXPORT_SQL = """
export AS (SELECT CAST(activity_id AS VARCHAR) AS "Activity ID",
  CASE WHEN activity_id % 23 = 0 THEN '' WHEN activity_id % 29 = 0 THEN 'Foo 45, 2001' ELSE strftime(CAST(day AS TIMESTAMP) + to_seconds(CAST(activity_id * 37 % 86400 AS BIGINT)), '%b %-d, %Y, %-I:%M:%S %p') END AS "Activity Date",
  'Run ' || CAST(activity_id % 50 AS VARCHAR) AS "Activity Name", list_extract(['Run', 'Trail Run', 'Ride', 'run', 'Walk', 'Running'], CAST(activity_id % 6 + 1 AS INT)) AS "Activity Type",
  CASE WHEN activity_id % 4 = 0 THEN 'activities/' || activity_id || '.fit.gz' WHEN activity_id % 4 = 1 THEN 'activities/' || activity_id || '.fit' ELSE '' END AS "Filename",
  CASE WHEN activity_id % 31 = 0 THEN '' WHEN activity_id % 37 = 0 THEN 'n/a' WHEN activity_id % 41 = 0 THEN '0' ELSE CAST(dist_m AS VARCHAR) END AS "Distance",
  CAST(moving_s AS VARCHAR) AS "Moving Time", CAST(elapsed_s AS VARCHAR) AS "Elapsed Time", CAST(gain_m AS VARCHAR) AS "Elevation Gain",
  CASE WHEN activity_id % 5 = 0 THEN '' WHEN activity_id % 7 = 0 THEN '300' ELSE CAST(110 + activity_id % 60 AS VARCHAR) END AS "Average Heart Rate",
  CASE WHEN activity_id % 5 = 0 THEN '' ELSE CAST(150 + activity_id % 90 AS VARCHAR) END AS "Max Heart Rate" FROM activity),
parsed AS (SELECT CAST(activity_id AS VARCHAR) AS fit_file, CASE WHEN activity_id % 2 = 0 THEN 'cycling' ELSE 'running' END AS fit_sport, elapsed_s AS fit_elapsed_s, moving_s AS fit_timer_s,
  15 + activity_id % 260 AS fit_avg_hr, activity_id % 11 AS hr_pts, 10 AS stream_pts, activity_id % 4 <> 0 AS has_gps FROM activity WHERE activity_id % 3 <> 0)"""
