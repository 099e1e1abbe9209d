"""Queries over places, age factors, nested time buckets and sessions; registered with those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideline.operators import spatial
from strideline.plans.catalog import ACT, REC, query, r, rounded
from strideline.sources.views import activities, records, table
from strideline.streaming.sessions import sessions

HAVERSINE = "2 * 6371008.8e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"


@query(f"""{REC}, place AS (SELECT lat, lon, count(*) AS n FROM record GROUP BY 1, 2)
SELECT {r('a.lat')} AS lat, {r('a.lon')} AS lon, a.n, CAST(sum(b.n) AS BIGINT) AS near FROM place a JOIN place b ON {HAVERSINE} <= 120 GROUP BY a.lat, a.lon, a.n""")
def grid_join(spark, sf):
    places = records(spark, sf).groupBy("lat", "lon").agg(F.count("*").alias("n"))
    near = spatial.grid_join(places, places, 120.0).groupBy(F.col("l.lat").alias("lat"), F.col("l.lon").alias("lon"), F.col("l.n").alias("n")).agg(F.sum("r.n").alias("near"))
    return rounded(near, "lat", "lon")


@query(f"""{REC}, s AS (SELECT athlete_id, CAST(hr AS DOUBLE) AS x, CAST(step_m AS DOUBLE) AS y, i FROM record),
e AS (SELECT athlete_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS u, coalesce(lead(y) OVER w, first_value(y) OVER w) AS v FROM s WINDOW w AS (PARTITION BY athlete_id ORDER BY i)),
g AS (SELECT athlete_id, abs(sum(x * v - u * y)) / 2 AS a, sum(sqrt(pow(u - x, 2) + pow(v - y, 2))) AS p FROM e GROUP BY 1)
SELECT athlete_id, {r('CASE WHEN p > 0 THEN 4 * pi() * a / (p * p) END')} AS roundness FROM g""")
def roundness(spark, sf):
    return rounded(spatial.roundness(records(spark, sf), "athlete_id", "hr", "step_m", "i"), "roundness")


@query(f"""{ACT}, aged AS (SELECT squad, dist_m, max(day) OVER (PARTITION BY squad) - day AS age FROM activity),
b AS (SELECT squad, '90d' AS bucket, dist_m FROM aged WHERE age < 90 UNION ALL SELECT squad, '1y', dist_m FROM aged WHERE age < 365 UNION ALL SELECT squad, 'all', dist_m FROM aged)
SELECT squad, bucket, count(*) AS runs, {r('sum(dist_m) / 1000.0e0')} AS km FROM b GROUP BY 1, 2""")
def heat_bucket_union(spark, sf):
    """The newest day per squad is a small aggregate; each row then goes to the one to three buckets that hold it."""
    a = activities(spark, sf).select("squad", "day", "dist_m")
    age = F.date_diff(F.col("newest"), F.col("day"))
    buckets = F.array_compact(F.array(F.when(age < 90, F.lit("90d")), F.when(age < 365, F.lit("1y")), F.lit("all")))
    rows = a.join(a.groupBy("squad").agg(F.max("day").alias("newest")), "squad").select("squad", F.explode(buckets).alias("bucket"), "dist_m")
    return rounded(rows.groupBy("squad", "bucket").agg(F.count("*").alias("runs"), (F.sum("dist_m") / 1000.0).alias("km")), "km")


AGES = (5, 100)


@query(f"""{ACT}, f AS (SELECT a AS age, 1.0e0 - 0.0001e0 * (a - 28) * (a - 28) AS factor FROM range({AGES[0]}, {AGES[1] + 1}) t(a))
SELECT activity_id, CAST(age AS BIGINT) AS age, {r('factor * 800000.0e0 / moving_s * dist_m / 5000.0e0')} AS pct FROM activity JOIN f ON age = greatest({AGES[0]}, least({AGES[1]}, athlete_id % 110)) WHERE moving_s > 0""")
def age_grade_lookup(spark, sf):
    """A factor by clamped age: the table has a row for each age, built from a rule, so it is always small enough to send."""
    factors = spark.range(AGES[0], AGES[1] + 1).select(F.col("id").alias("age"), (1.0 - 0.0001 * (F.col("id") - 28) * (F.col("id") - 28)).alias("factor"))
    a = activities(spark, sf).where("moving_s > 0").withColumn("age", F.greatest(F.lit(AGES[0]), F.least(F.lit(AGES[1]), F.col("athlete_id") % 110)))
    return rounded(a.join(F.broadcast(factors), "age").select("activity_id", "age", (F.col("factor") * 800000.0 / F.col("moving_s") * F.col("dist_m") / 5000.0).alias("pct")), "pct")


@query(f"""WITH s AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
g AS (SELECT user_id, ts, value, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n, {r('sum(value)', 2)} AS total FROM g GROUP BY user_id, k""")
def event_sessions(spark, sf):
    return rounded(sessions(table(spark, sf, "events")).select("user_id", F.unix_seconds("start").alias("start_s"), "n", "total"), "total", digits=2)
