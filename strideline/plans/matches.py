"""Queries that match runs, lines and places, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.operators import lines, ordered
from strideline.operators import summaries as sm
from strideline.plans.catalog import CURVE, K, _points, query, r, rounded
from strideline.plans.geometry import _NEAR, SEG, TRACK, A, efforts, track
from strideline.plans.running import TYPED, _usable
from strideline.sources.views import table


@query(f"""{TYPED}, u AS (SELECT activity_id, CAST(activity_id AS BIGINT) % 25 AS owner, epoch(start)::BIGINT AS e, dist_m / moving_s AS v, dist_m FROM usable WHERE moving_s > 0),
g AS (SELECT a.activity_id, floor((b.e - a.e) / 86400.0e0) AS off, b.v FROM u a JOIN u b ON a.owner = b.owner AND b.dist_m >= 5000), w AS (SELECT activity_id, max(v) AS peak, max(v) FILTER (abs(off) <= 60) AS w1, max(v) FILTER (abs(off) <= 120) AS w2, max(v) FILTER (abs(off) <= 240) AS w4, max(v) FILTER (abs(off) <= 480) AS w8 FROM g GROUP BY 1)
SELECT u.activity_id, {r('coalesce(w1, w2, w4, w8) / peak')} AS era FROM u LEFT JOIN w USING (activity_id)""")
def era_threshold(spark, sf):
    """The best 5 km around each run as a part of the best of all: within 60 days, else 120, 240 or 480. Whole days are counted
    down, so a window of n days reaches from n days before to just under n + 1 days after."""
    u = _usable(spark, sf).where("moving_s > 0").select("activity_id", (F.col("activity_id").cast("long") % 25).alias("owner"), F.col("epoch").alias("e"), F.when(F.col("dist_m") >= 5000, F.col("dist_m") / F.col("moving_s")).alias("v"))
    times = u.groupBy("owner", "e").agg(F.max("v").alias("v"))  # a row a start goes through the windows
    near = ordered.best_around(times, "owner", "e", "v", (60, 120, 240, 480))
    peak = times.groupBy("owner").agg(F.max("v").alias("peak"))
    era = near.join(peak, "owner").select("owner", "e", (F.col("best") / F.col("peak")).alias("era"))
    return rounded(u.select("activity_id", "owner", "e").join(era, ["owner", "e"]).select("activity_id", "era"), "era")


LAPS = f"{TRACK}, lap AS (SELECT athlete_id, i // 20 AS lap, avg(lat) AS lat, avg(lon) AS lon, max(d) - min(d) + athlete_id % 7 * 60 AS len FROM track GROUP BY 1, 2), loop AS (SELECT athlete_id AS id, avg(lat) AS lat, avg(lon) AS lon, 600.0e0 AS len FROM track WHERE athlete_id % 5 = 0 GROUP BY 1)"


@query(f"{LAPS} SELECT a.athlete_id, a.lap, min_by(b.id, (round({_NEAR}, 6), b.id)) AS loop FROM lap a JOIN loop b ON {_NEAR} <= 120 AND a.len > 0 AND greatest(a.len, b.len) / least(a.len, b.len) <= 1.35e0 GROUP BY 1, 2")
def laps_of_loops(spark, sf):
    """The nearest loop of each lap within 120 m whose length is within a factor of 1.35."""
    s = track(spark, sf)
    lap = s.groupBy(A, F.floor(F.col("i") / 20).alias("lap")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), (F.max("d") - F.min("d")).alias("len")).withColumn("len", F.col("len") + F.col(A) % 7 * 60)
    loop = s.where(f"{A} % 5 = 0").groupBy(F.col(A).alias("id")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).withColumn("len", F.lit(600.0))
    alike = lambda p, q: F.greatest(p["len"], q["len"]) / F.least(p["len"], q["len"]) <= 1.35
    range_ = loop.agg((F.min("len") / 1.351).alias("lo"), (F.max("len") * 1.351).alias("hi"))  # one row; laps that no loop can be alike don't ask
    lap = lap.where("len > 0").crossJoin(F.broadcast(range_)).where("len between lo and hi").select(F.struct(A, "lap").alias("id"), "lat", "lon", "len")
    near = lines.nearest(lap, loop.withColumn("first", -F.col("id")), 120.0, "id", "first", alike, ("len",))
    return near.select(f"id.{A}", "id.lap", F.col("r.id").alias("loop"))


@query(f"{TRACK} SELECT athlete_id, min_by(i, (abs(d - 555), i)) AS by_x, min_by(i, (round(pow(d - 555, 2) + pow(hr - 100, 2), 6), i)) AS by_xy FROM track GROUP BY 1 HAVING min(pow(d - 555, 2) + pow(hr - 100, 2)) <= 1000000")
def nearest_samples(spark, sf):
    """The sample nearest to a pointer on one axis, and on both, if any is near enough."""
    s = track(spark, sf).withColumn("m", F.pow(F.col("d") - 555, F.lit(2)) + F.pow(F.col("hr") - 100, F.lit(2)))
    g = s.groupBy(A).agg(F.min_by("i", F.struct(F.abs(F.col("d") - 555), F.col("i"))).alias("by_x"), F.min_by("i", F.struct(F.round("m", 6), F.col("i"))).alias("by_xy"), F.min("m").alias("m"))
    return g.where("m <= 1000000").select(A, "by_x", "by_xy")


WAVES = "('A', 5000.0e0, 1400, 1500), ('B', 10000.0e0, 3300, 3000), ('C', 21097.5e0, 6000, 7600)"


@query(f"""{CURVE}, w(name, d, a0, b0) AS (VALUES {WAVES}), p AS (SELECT squad, name, d, least(a0, b0) AS fast, greatest(a0, b0) AS slow, a * pow(d, b) AS pred FROM curve, w) SELECT squad, name, CASE WHEN pred <= slow THEN 'green' ELSE 'amber' END AS status, CASE WHEN pred > slow THEN 'over wave' WHEN pred < fast THEN 'ahead of wave' ELSE 'inside wave' END AS gap, {r('CASE WHEN pred > slow THEN pred - slow WHEN pred < fast THEN fast - pred ELSE 0 END', 2)} AS seconds, CAST(greatest(0, least(100, round_even((slow - pred) / (d / 1000) / 120 * 100 + 50, 0))) AS INT) AS bar FROM p""")
def wave_cards(spark, sf):
    """Predictions against a range of times, measured from its slow end."""
    w = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(d).alias("d"), F.lit(float(min(x, y))).alias("fast"), F.lit(float(max(x, y))).alias("slow")) for n, d, x, y in (("A", 5000.0, 1400, 1500), ("B", 10000.0, 3300, 3000), ("C", 21097.5, 6000, 7600)))))
    c = sm.power_curve(_points(spark, sf), K).withColumn("w", w).select(K, "w.*", (F.col("a") * F.pow(F.col("w.d"), F.col("b"))).alias("pred"))
    over, ahead = F.col("pred") > F.col("slow"), F.col("pred") < F.col("fast")
    bar = F.greatest(F.lit(0), F.least(F.lit(100), F.bround((F.col("slow") - F.col("pred")) / (F.col("d") / 1000) / 120 * 100 + 50))).cast("int")
    seconds = F.when(over, F.col("pred") - F.col("slow")).when(ahead, F.col("fast") - F.col("pred")).otherwise(0.0)
    return rounded(c.select(K, "name", F.when(over, "amber").otherwise("green").alias("status"), F.when(over, "over wave").when(ahead, "ahead of wave").otherwise("inside wave").alias("gap"), seconds.alias("seconds"), bar.alias("bar")), "seconds", digits=2)


@query(f"{SEG}, s AS (SELECT seg, max(kind) AS kind, count(*) AS attempts, count(DISTINCT run) AS runs, date_diff('day', min(day), max(day)) AS span, min_by(run, (time_s, run)) AS best_run, min(time_s) AS best_s, max(dist_m) AS len FROM effort GROUP BY 1) SELECT seg, kind, attempts, runs, span AS span_days, best_run, best_s FROM s WHERE runs >= 2 AND span >= 14 AND len >= CASE kind WHEN 'segment' THEN 400 WHEN 'climb' THEN 150 ELSE 350 END")
def segment_records(spark, sf):
    """Segments of two runs and 14 days or more that are long enough for their kind, with their best."""
    g = efforts(spark, sf).groupBy("seg").agg(
        F.max("kind").alias("kind"), F.count("*").alias("attempts"), F.count_distinct("run").alias("runs"), F.datediff(F.max("day"), F.min("day")).cast("long").alias("span_days"),
        F.min_by("run", F.struct("time_s", "run")).alias("best_run"), F.min("time_s").alias("best_s"), F.max("dist_m").alias("len"),
    )
    floor = F.when(F.col("kind") == "segment", 400).when(F.col("kind") == "climb", 150).otherwise(350)
    return g.where((F.col("runs") >= 2) & (F.col("span_days") >= 14) & (F.col("len") >= floor)).drop("len")


@query("SELECT o_orderkey AS id, round(o_totalprice, 2) AS ms FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def slowest_parses(spark, sf):
    return rounded(table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("ms")), "ms", digits=2)


@query(f"{SEG}, c AS (SELECT seg, count(DISTINCT run) AS runs, max(dist_m) AS len FROM effort GROUP BY 1 HAVING count(DISTINCT run) >= 3) SELECT seg, runs FROM c ORDER BY runs DESC, len DESC, seg LIMIT 25")
def anchor_candidates(spark, sf):
    """The 25 places with the most runs, of those with three or more."""
    g = efforts(spark, sf).groupBy("seg").agg(F.count_distinct("run").alias("runs"), F.max("dist_m").alias("len")).where("runs >= 3")
    return g.orderBy(F.desc("runs"), F.desc("len"), "seg").limit(25).select("seg", "runs")


@query(f"{TRACK}, e AS (SELECT athlete_id, CAST(floor(d / 1000) AS BIGINT) + 1 AS km, elev - lag(elev) OVER (PARTITION BY athlete_id ORDER BY i) AS x FROM track WHERE elev IS NOT NULL) SELECT athlete_id, km, CAST(round_even(coalesce(sum(greatest(x, 0)), 0), 0) AS BIGINT) AS gain_m, CAST(round_even(coalesce(sum(greatest(-x, 0)), 0), 0) AS BIGINT) AS loss_m FROM e GROUP BY 1, 2")
def km_climb_refilled(spark, sf):
    """Climb and descent of each km, the first being 1, from heights alone: samples without one are passed over."""
    e = track(spark, sf).where("elev is not null").withColumns(lines.before(A, "i", "elev")).withColumn("x", F.col("elev") - F.col("p_elev"))
    up = lambda c: F.bround(F.coalesce(F.sum(F.when(c > 0, c).otherwise(0.0)), F.lit(0.0))).cast("long")
    return e.groupBy(A, (F.floor(F.col("d") / 1000) + 1).alias("km")).agg(up(F.col("x")).alias("gain_m"), up(-F.col("x")).alias("loss_m"))
